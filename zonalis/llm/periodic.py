"""Periodic runs of words: suffix classes united by decreasing LCP, with ordered position sets.

For one text, the edges between neighbours of the suffix order, taken by decreasing LCP, unite classes of
suffixes that share so many words (Kruskal's order). When two classes meet at LCP l, positions i < j that
become neighbours in the united, ordered set have exactly l words in common, so the words from i to j + l
have period j - i. A run of length L >= 2 q and smallest period q shows up at its first pair (i, i + q) and
only there: a position between them with as many words in common would give a smaller period. Edges too
short for any run that counts are never needed, which leaves few edges in ordinary prose.

Suffixes are ordered by prefix doubling over a batch of texts at once; only windows that still recur are
sorted again. Memory of a batch is its words times the logarithm of the longest repeat.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, load, tokens

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Positions:
    """An ordered set of positions in blocks, so that large sets take new members in short moves."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, x: int):
        self.blocks, self.firsts, self.size = [[x]], [x], 1

    def around(self, x: int) -> tuple[int, int]:
        """The members next below and above x; -1 where there is none."""
        b = bisect(self.firsts, x) - 1
        if b < 0:
            return -1, self.firsts[0]
        block = self.blocks[b]
        i = bisect(block, x)
        if i < len(block):
            return block[i - 1], block[i]
        return block[i - 1], self.firsts[b + 1] if b + 1 < len(self.firsts) else -1

    def add(self, x: int) -> None:
        b = max(bisect(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > 1024:
            self.blocks[b:b + 1] = block[:512], block[512:]
            self.firsts.insert(b + 1, block[512])

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of 1, 2, 4, ... words, until all differ; equal ranks are equal windows.

    A trailing -1 stands for the end. Texts share no ids, so a window over the end of one has no equal.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    levels, key, alive, base, step = [], ids[order], order, np.zeros(n, dtype=np.int64), 0
    rank = np.append(np.zeros(n, dtype=np.int32), np.int32(-1))
    while True:
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, dtype=np.int64)
        # Groups keep their place: where the old group began, and how far into it the new one begins.
        old = np.append(True, base[1:] != base[:-1]) if len(base) else new
        began = np.maximum.accumulate(np.where(old, np.arange(len(base)), 0)) if len(base) else start
        rank = rank.copy()
        rank[alive] = base + start - began
        levels.append(rank)
        last = np.append(new[1:], True) if len(new) else new
        more = ~(new & last)
        if not more.any():
            return levels
        alive = alive[more]
        step = step * 2 or 1
        key = rank[alive].astype(np.int64) * (n + 1) + rank[np.minimum(alive + step, n)] + 1
        o = np.argsort(key, kind="stable")
        alive, key = alive[o], key[o]
        base = rank[alive].astype(np.int64)


def lcp_edges(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lcp, a, b) of neighbours in suffix order that share at least `least` words, by decreasing LCP."""
    n = len(levels[0]) - 1
    order = np.argsort(levels[-1][:n], kind="stable")
    a, b = order[:-1], order[1:]
    floor = levels[min(least.bit_length() - 1, len(levels) - 1)]
    same = floor[a] == floor[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        lcp += np.where((levels[k][i] == levels[k][j]) & (i < n) & (j < n), 1 << k, 0)
    long = lcp >= least
    a, b, lcp = a[long], b[long], lcp[long]
    o = np.argsort(-lcp, kind="stable")
    return lcp[o], a[o], b[o]


def runs_of(ids: np.ndarray, min_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs in a sequence of ids with length >= max(min_length, exponent * period)."""
    if exponent < 2:
        raise ValueError("runs of less than two periods are not found by neighbours")
    if len(ids) < 2:
        return []
    least = min(max((exponent - 1) * q, min_length - q) for q in range(1, max(min_length, 1) + 1))
    edges = lcp_edges(suffix_ranks(ids), max(least, 1))
    sets: dict[int, Positions] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    runs = []
    for lcp, a, b in zip(*(e.tolist() for e in edges), strict=True):
        a, b = root(a), root(b)
        large, small = sets.get(a) or Positions(a), sets.get(b) or Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        fresh, members = [], list(small)
        for k, x in enumerate(members):
            below, above = large.around(x)
            if below >= 0 and (k == 0 or members[k - 1] < below):
                fresh.append((below, x))
            if above >= 0 and (k + 1 == len(members) or members[k + 1] > above):
                fresh.append((x, above))
        for i, j in fresh:
            q = j - i
            if lcp >= (exponent - 1) * q and lcp + q >= min_length and (i == 0 or ids[i - 1] != ids[j - 1]):
                runs.append((i, lcp + q, q))
        for x in members:
            large.add(x)
        parent[b] = a
        sets[a] = large
        sets.pop(b, None)
    return runs


def _batches(min_length: int, exponent: int, chunk: int):
    def many(texts: list[list[str]]) -> Iterator[tuple[list[dict], int, str]]:
        """All texts of a chunk in one suffix order."""
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        flat = [w for words in texts for w in words]
        codes, _ = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, dtype=np.int64), None)
        ids = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * (len(flat) + 1) + codes
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, period in runs_of(ids, min_length, exponent):
            doc = int(np.searchsorted(begins, start, side="right")) - 1
            found.setdefault(doc, []).append((start - int(begins[doc]), length, period))
        for doc, words in enumerate(texts):
            runs = sorted(found.get(doc, ()), key=lambda r: (r[0], r[2]))
            if runs:
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for start, length, period in runs:
                    cover[start + period] += 1
                    cover[start + length] -= 1
                words = [w for w, c in zip(words, np.cumsum(cover)[:-1].tolist(), strict=True) if not c]
            yield [{"start": s, "length": n, "period": q} for s, n, q in runs], int(sizes[doc]), " ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, waiting = 0, 0, []
            column = batch.column(1)
            for i in range(batch.num_rows + 1):
                if waiting and (size >= chunk or i == batch.num_rows):
                    rows = list(many(waiting))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.list_(_RUN)), pa.array([r[2] for r in rows], pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"])
                    at, size, waiting = i, 0, []
                if i < batch.num_rows:
                    waiting.append(_WORD.findall(column[i].as_py() or ""))
                    size += len(waiting[-1])

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4, chunk: int = 200_000) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row for each row of docs (doc_id bigint, text; other columns are ignored).

    runs: array of (start, length, period), ordered by start, then period; start counts words from 0. A run is a
    stretch with smallest period q of at least max(min_length, exponent * q) words that cannot be extended.
    collapsed: the words that no run covers after its first period, joined by one space. A null or empty text has
    no words, no runs and an empty collapsed text; a null doc_id is kept; equal rows give equal rows; a text of
    any length is taken whole (chunk only says after how many words texts are no longer put together).
    """
    return docs.select("doc_id", "text").mapInArrow(_batches(min_length, exponent, chunk), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id asks for it repeat their own words from some word on; a null doc_id asks for nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, tokens(F.col("text"), SPACES)).alias("w"))
    n = F.size("w").cast("long")
    d = d.select("doc_id", "text", "g", "w", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a"))
    d = d.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)

    def word(i: Column) -> Column:
        return F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    whole = F.concat(F.slice("w", 1, F.col("a").cast("int")), F.transform(F.sequence("a", F.col("n") - 1), word))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = periodic_runs(with_planted_period(load(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return r.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
