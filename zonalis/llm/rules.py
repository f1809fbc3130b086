"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Random trees split the rule statistics at random values; documents that are cut off after few
splits are unlike the rest. The forest sees by how far each rule's rate lies outside the range of
labelled good rows, since the languages differ inside it. The score above which a document goes is
calibrated on labelled rows too: the best separation of good and bad ones that still keeps nearly
all good ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored

_SYMBOLS = dict.fromkeys(map(ord, "#*$%&|<>"))
WINDOW = 8


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one whole text."""
    # Words end at a space or a control from tab to return, and at nothing else.
    words = [w for w in text.translate(_TO_SPACE).split(" ") if w]
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.translate(_TO_SPACE).strip(" "):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), dup, repeat_words(words)


_TO_SPACE = dict.fromkeys(range(9, 14), " ")


def repeat_words(words: list[str]) -> int:
    """Words inside 8-word windows that stand twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    grams = list(zip(*(ids[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered, total = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return total


def statistics(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, text: str) -> list[float]:
    """The raw rate of each rule: mean word length, shares of symbols, equal lines, repeated words, capitals and exclamation marks.

    Rates do not depend on length, and those of short texts are drawn toward the usual, so that a
    single sign in a few words is no anomaly.
    """
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    lines, chars = text.count("\n") + 1, len(text) + 50
    return [(word_chars + 110) / (n_words + 20), n_symbols / chars, n_dup_lines / (lines + 10), n_repeat_words / (n_words + 200), upper / chars, text.count("!") / chars]


class UsualRanges:
    """For each rate the middle of good rows, and the distance from it within which all but a few of them lie."""

    def __init__(self, good: np.ndarray, share: float):
        self.middle = np.median(good, axis=0)
        self.reach = np.quantile(np.abs(good - self.middle), share, axis=0)

    @classmethod
    def of_all(cls, good: DataFrame, share: float) -> UsualRanges:
        """The same from all rows of a column x, which stay where they are."""
        out = cls.__new__(cls)
        rates = good.select(F.posexplode("x").alias("f", "v"))
        out.middle = quantiles(rates, 0.5)
        out.reach = quantiles(rates.select("f", F.abs(F.col("v") - F.get(F.array(*map(F.lit, out.middle.tolist())), F.col("f"))).alias("v")), share)
        return out

    def excess(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.abs(x - self.middle) - self.reach)


def quantiles(values: DataFrame, share: float, bins: int = 256) -> np.ndarray:
    """The quantile of v for each f (0, 1, ...), exactly, as numpy interpolates it, over all rows (f, v).

    Ranks are found by counting between bounds that close in on them; a pass sends bins of counts only.
    """
    ends = values.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    found, todo = {}, {}
    for r in ends:
        at = share * (r["n"] - 1)
        for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
            todo[r["f"], rank] = (r["low"], r["high"], 0)
    while todo:
        found |= {k: low for k, (low, high, _) in todo.items() if low == high}
        todo = {k: x for k, x in todo.items() if k not in found}
        if not todo:
            break
        bounds = values.sparkSession.createDataFrame([(*k, *x[:2]) for k, x in todo.items()], "f int, rank long, low double, high double")
        near = values.join(F.broadcast(bounds), "f").where("v >= low and v <= high")
        rows = near.groupBy("f", "rank", F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("from"), F.max("v").alias("to")).collect()
        for (f, rank), (_, _, below) in list(todo.items()):
            for r in sorted((r for r in rows if (r["f"], r["rank"]) == (f, rank)), key=lambda r: r["bin"]):
                if below + r["n"] > rank:
                    todo[f, rank] = (r["from"], r["to"], below)
                    break
                below += r["n"]
    out = []
    for r in sorted(ends, key=lambda r: r["f"]):
        at = share * (r["n"] - 1)
        low, high = found[r["f"], int(at)], found[r["f"], min(int(at) + 1, r["n"] - 1)]
        out.append(low + (high - low) * (at - int(at)))
    return np.array(out)


class Forest:
    """Isolation trees as arrays: split feature, split value, left child (right is next to it), path length of leaves."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        drawn = [sample[rng.choice(len(sample), self.size, replace=False)] for _ in range(trees)]
        one = np.ones(self.size, dtype=np.int64)
        self._grow(trees, int(np.ceil(np.log2(max(self.size, 2)))), rng, lambda first: [(t, *s) for t in range(trees) for s in self.spans(t, first[t], drawn[t], one)])

    @classmethod
    def of_all(cls, vectors: DataFrame, trees: int = 100, depth: int = 8, seed: int = 0) -> Forest:
        """Trees over all rows (e array<double>, n bigint), n equal rows each: every level's ranges and counts are one aggregate."""
        forest = cls.__new__(cls)
        forest.size, width = vectors.agg(F.sum("n"), F.max(F.size("e"))).first()
        sides = [f"{side}{i}" for side in ("low", "high") for i in range(width)]

        def spans(first: list[int]) -> list[tuple]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    e, n = np.array(batch.column("e").to_pylist(), dtype=float).reshape(-1, width), np.array(batch.column("n"))
                    rows = [(t, node, count, *low, *high) for t in range(trees) if len(n) for node, count, low, high in forest.spans(t, first[t], e, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * (3 + 2 * width), [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 2 * width], strict=True)],
                                                     names=["tree", "node", "n", *sides])

            found = vectors.mapInArrow(run, "tree int, node int, n bigint, " + ", ".join(f"{c} double" for c in sides))
            found = found.groupBy("tree", "node").agg(F.sum("n").alias("n"), *((F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides))
            return [(r["tree"], r["node"], r["n"], np.array(r[3:3 + width]), np.array(r[3 + width:])) for r in found.collect()]

        forest._grow(trees, depth, np.random.default_rng(seed), spans)
        return forest

    def _grow(self, trees: int, depth: int, rng: np.random.Generator, spans: Callable[[list[int]], list[tuple]]) -> None:
        """Level by level; spans gives (tree, node, rows, least, greatest) for the nodes of each tree from a number on."""
        grown = [([0], [np.inf], [-1], [0.0]) for _ in range(trees)]
        first = [0] * trees
        for level in range(depth + 1):
            self.trees = [tuple(map(np.array, t)) for t in grown]
            nodes = sorted(spans(first), key=lambda s: s[:2])
            first = [len(t[0]) for t in grown]
            for tree, node, n, low, high in nodes:
                feature, value, child, length = grown[tree]
                wide = np.flatnonzero(high > low)
                if level == depth or not len(wide):
                    length[node] = level + average_path(int(n))
                    continue
                f = int(rng.choice(wide))
                feature[node], value[node], child[node] = f, float(rng.uniform(low[f], high[f])), len(feature)
                feature += [0, 0]
                value += [np.inf, np.inf]
                child += [-1, -1]
                length += [0.0, 0.0]
            if first == [len(t[0]) for t in grown]:
                break
        self.trees = [tuple(map(np.array, t)) for t in grown]

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        feature, value, child, _ = self.trees[tree]
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := child[at] >= 0).any():
            at = np.where(inner, child[at] + (x[rows, feature[at]] > value[at]), at)
        return at

    def spans(self, tree: int, first: int, x: np.ndarray, n: np.ndarray) -> list[tuple]:
        """(node, rows, least, greatest of each feature) of the nodes from first on where rows end."""
        at = self.leaves(tree, x)
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], first):]
        if not len(order):
            return []
        nodes, begin = np.unique(at[order], return_index=True)
        x = x[order]
        return list(zip(nodes.tolist(), np.add.reduceat(n[order], begin).tolist(), np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin), strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, low for the usual."""
        total = np.zeros(len(x))
        for tree, (_, _, _, length) in enumerate(self.trees):
            total += length[self.leaves(tree, x)]
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.size), 1e-9))


def average_path(n: int) -> float:
    """Mean path of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, seen = [], []
        for t in batch.column("text").to_pylist():
            c = rule_counts(t or "")
            counts.append(c)
            seen.append(statistics(*c, t or ""))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(seen, pa.list_(pa.float64()))],
                                         names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])


def judge(docs: DataFrame, labels: DataFrame, max_sample: int | None = None, keep_good: float = 0.995, usual: float = 0.999, seed: int = 0) -> DataFrame:
    """One row for each row of docs: the counts, anomaly score, base_failed and kept.

    Everything is learned from all rows: the forest from all that pass the base rule, the usual ranges (a share
    `usual` of good rows) and the threshold from all of them that are labelled. Equal rates of one id count once.
    Where max_sample is given, only so many ids are learned from, chosen by a hash. Without labels of both kinds, or
    where no threshold parts them, only base_failed decides. Null and empty texts have no words and fail the
    base rule; a null doc_id is judged like any other; equal rows get equal answers.
    """
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, x array<double>"
    c = stored(docs.select("doc_id", "text").mapInArrow(_count, schema))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    c = c.withColumn("base_failed", failed)
    seen = c.where("not base_failed").select("doc_id", "x").distinct()
    if max_sample is not None:
        seen = seen.join(F.broadcast(seen.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)), "doc_id")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    seen = stored(seen.join(known, "doc_id", "left").select("x", "good"))
    if seen.where("good").isEmpty():
        return c.select("*", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept")).drop("x")
    ranges = UsualRanges.of_all(seen.where("good"), usual)
    beyond = F.array(*(F.greatest(F.lit(0.0), F.abs(F.get("x", F.lit(i)) - float(m)) - float(r)) for i, (m, r) in enumerate(zip(ranges.middle, ranges.reach, strict=True))))
    vectors = stored(seen.groupBy(beyond.alias("e")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    forest = Forest.of_all(vectors.select("e", "n"), seed=seed)

    def score(column: str, excess: Callable[[np.ndarray], np.ndarray]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(column).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
                yield batch.append_column("anomaly", pa.array(np.round(forest.scores(excess(x)), DECIMALS) if len(x) else [], pa.float64()))
        return run

    rated = vectors.where("good + bad > 0").mapInArrow(score("e", lambda e: e), "e array<double>, n bigint, good bigint, bad bigint, anomaly double")
    rated = rated.groupBy("anomaly").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("anomaly").collect()
    threshold = calibrated(*(np.array([r[k] for r in rated]) for k in ("anomaly", "good", "bad")), keep_good)
    out = c.mapInArrow(score("x", ranges.excess), f"{schema}, base_failed boolean, anomaly double")
    return out.drop("x").withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


#: Decimals of a score, so that the scores of any number of rows are few enough to be counted.
DECIMALS = 5


def calibrated(at: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The threshold with the best true minus false rejections among those that keep enough good rows, from ascending scores and their counts."""
    if not good.sum() or not bad.sum():
        return float("inf")
    kept, caught = good.cumsum() / good.sum(), 1 - bad.cumsum() / bad.sum()
    gain = np.where(kept >= keep_good, caught - (1 - kept), -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float("inf")
    return float((at[best] + at[best + 1]) / 2) if best + 1 < len(at) else float(at[best])


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
