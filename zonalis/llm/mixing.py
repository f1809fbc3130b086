"""Mixing sources to target weights by fitting each source's word budget with whole documents.

Documents are counted by exact length within each source. A source's budget is whole passes over
the source and a rest; the rest takes the same share of every length, rounded down, then the
longest documents that still fit, and the last words by bounded-knapsack dynamic programming over the
counts that are left, over as many words as it takes to come nearest. Only then are documents named: within a length, those
with the smallest seeded hash. Nothing but counts meets in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, load, stored, tokens


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds target to (key, source, source_size), one row for each source.

    Sources in code point order, null last, weigh weights[0], weights[1] ... repeating and share
    `share` times all words; none gets more than cap times its own, and what is over goes to the
    others by weight. That is one level L with target = min(cap * size, L * weight); with sources in
    order of cap * size / weight, L is the largest of the levels at which all sources before are full.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("full", F.col("source_size") * float(cap))
    before = Window.orderBy(F.col("full") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    s = s.withColumn("at", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max("at").over(everything))
    return s.select("key", "source", "source_size", F.least(F.col("full"), F.col("level") * F.col("w")).alias("target"))


def reachable(items: list[tuple[int, int]], top: int, wanted: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each sum up to top the step that first reaches it (0 for the empty sum, -1 if none does), and the steps.

    items are lengths and how often each may be taken; a step takes k documents of a length or none. Ends
    once the wanted sum is reached.
    """
    first = np.full(top + 1, -1, dtype=np.int32)
    first[0] = 0
    steps, high = [(0, 0)], 0
    for n, count in items:
        left, part = min(count, top // n), 1
        while left > 0 and first[wanted] < 0:
            k = min(part, left)
            steps.append((n, k))
            to = min(high + n * k, top)
            new = (first[: to + 1 - n * k] >= 0) & (first[n * k : to + 1] < 0)
            first[n * k : to + 1][new] = len(steps) - 1
            high = to
            left -= k
            part *= 2
    return first, steps


def fit_budget(counts: dict[int, int], budget: int, dp_words: int = 1 << 16) -> dict[int, int]:
    """How many documents of each length to take so that their words come nearest to the budget.

    What exceeds dp_words, or the longest document if that is more, is shared out in proportion and
    filled from the longest lengths down; dynamic programming over the documents that are left does the
    rest. If that misses the nearest multiple of the lengths' common divisor, the nearest sum there can be, the
    programme takes over four times as much of the budget, in the end all of it: no choice of documents
    comes nearer. It holds 4 bytes for each word that it takes over, over that divisor. The sum may be above the budget.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not counts:
        return {}
    if budget >= total:
        return counts
    unit = math.gcd(*counts)
    order = sorted(counts, reverse=True)
    last = max(dp_words, order[0])
    while True:
        share = max(0, budget - last)
        take = {n: c * share // total for n, c in counts.items()}
        rest = budget - sum(n * c for n, c in take.items())
        for n in order:
            more = min(counts[n] - take[n], max(0, rest - last) // n)
            take[n] += more
            rest -= n * more
        near = (rest + unit // 2) // unit  # in units, a multiple nearest to the rest
        top = (rest + min(rest, order[0])) // unit  # a sum above may be nearer
        first, steps = reachable([(n // unit, counts[n] - take[n]) for n in order], top, min(near, top))
        sums = np.flatnonzero(first >= 0)
        off = np.abs(sums * unit - rest)
        best = int(sums[off.argmin()])
        if share == 0 or off.min() <= abs(near * unit - rest):
            break
        last *= 4
    while best:
        n, k = steps[first[best]]
        take[n * unit] += k
        best -= n * k
    return {n: c for n, c in take.items() if c}


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        seed: int = 0, dp_words: int = 1 << 16, bucket_docs: int = 5000) -> DataFrame:
    """One row for each row of docs: doc_id, size, source, source_size, target, copies, taken.

    size is the number of words of the whole text, 0 for null; copies times size is taken. A
    document is taken at most ceil(cap) times, and with cap 2 never for more than twice its size.
    Null sources are one source, the last. Repeated rows are documents of their own; equal ones are
    interchangeable. Documents without words are never taken. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    size = F.size(tokens(F.col("text"), SPACES)).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = stored(docs.select("doc_id", "source", key.alias("key"), size.alias("size"), draw.alias("draw")))
    counts = sized.groupBy("key", "source", "size").count()
    per = targets(counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, share, cap)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        words, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = int(target // words) if words else 0
        have = dict(zip(group["size"].tolist(), group["count"].tolist(), strict=True))
        extra = fit_budget(have, round(target - passes * words), dp_words)
        out = group[["key", "size", "count", "source_size", "target"]].copy()
        out["passes"] = passes
        out["extra"] = [extra.get(n, 0) for n in out["size"]]
        return out

    planned = counts.join(per.drop("source"), "key").groupBy("key").applyInPandas(
        plan, "key string, size long, count long, source_size long, target double, passes long, extra long")
    # A length with many documents is cut into ranges of the hash, so that no one task ranks it alone.
    parts = F.greatest(F.ceil(F.col("count") / bucket_docs), F.lit(1))
    u = F.shiftrightunsigned(F.col("draw"), 12) / float(1 << 52)
    rows = sized.join(planned, ["key", "size"]).withColumn("part", F.least(F.floor(u * parts), parts - 1))
    by = ["key", "size", "part"]
    filled = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("here"), F.first("extra").alias("extra"))
    ahead = F.coalesce(F.sum("here").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = filled.select(*by, F.greatest(F.least(F.col("extra") - ahead, F.col("here")), F.lit(0)).alias("quota"))
    rows = rows.join(quota, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("draw", "doc_id")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "draw")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
