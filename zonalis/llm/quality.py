"""Quality by hierarchical empirical Bayes: a document's own evidence with its host's and path's record.

A logistic classifier on text statistics gives each document a probability. Grouped aggregation
turns these into posteriors of hosts, shrunk toward the global mean, and of paths within hosts,
shrunk toward their host; how strongly is estimated from the spread between groups. The
document's final odds are its own, moved by how far the other documents of its path stand from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, fresh, load, stored

FEATURES = ("long_word", "upper", "symbols", "pipes", "bangs", "digits", "repeats", "variety", "lines", "short")
_KIND = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>{}~^\\", b"|", b"!", b"0123456789"), 1):
    _KIND[np.frombuffer(_chars, dtype=np.uint8)] = _i


def text_statistics(text: str) -> list[float]:
    """FEATURES of one whole text; all finite, and defined for the empty text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6)
    words = text.split()
    n, chars = max(len(words), 1), max(len(raw), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [min(chars / n, 50.0) / 10, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[5] / chars,
            repeats / n, len(set(words)) / n ** 0.7, (text.count("\n") + 1) / n, 1.0 / n]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [text_statistics(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "host", "path")), pa.array(x, pa.list_(pa.float64()))],
                                         names=["doc_id", "text_hash", "host", "path", "x"])


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled ids, chosen by a hash of the id; an id with two labels takes the larger."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def one_of_each_id(rows: DataFrame, *columns: str, by: str = "text_hash") -> DataFrame:
    """doc_id and the columns of one row of each id, the one of the least hash: rows that share an id are not all collected."""
    least = rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), by).alias("row"))
    return least.select("doc_id", *(f"row.{c}" for c in columns))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; works on the raw features, penalised on their own scale."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def shrinkage(groups: DataFrame, mean: float) -> float:
    """Prior strength in documents, by moments: the spread of group means beyond what their sizes explain.

    groups has n, s (sum of probabilities) and q (sum of squares). A spread of no more than chance
    gives the largest strength, 1e6: all groups then keep the prior.
    """
    m = F.col("s") / F.col("n")
    noise = F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)) / F.col("n")
    r = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (m - mean) ** 2).alias("between"), F.sum(F.col("n") * noise).alias("noise")).first()
    if not r["n"]:
        return 1e6
    spread = (r["between"] - r["noise"]) / r["n"]
    inside = mean * (1 - mean)
    return float(min(max(inside / spread - 1, 1.0), 1e6)) if spread > 1e-12 and inside > 0 else 1e6


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_train: int = 20_000,
                  broadcast_mb: float = 32, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, own, host_rate, path_rate, quality, keep), one row for each row of docs.

    labels (doc_id, quality 0/1) may hold any number of rows; the classifier is fitted on at most
    max_train ids of them. Without usable labels of both kinds every document is kept at 0.5.
    Null hosts and paths are groups like any other; null and empty texts are scored by the
    statistics of the empty text. Repeated rows get equal answers, an empty table no rows.
    """
    x = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    x = stored(x.mapInArrow(_statistics, "doc_id bigint, text_hash bigint, host string, path string, x array<double>"))
    train = one_of_each_id(x.select("doc_id", "text_hash", "x").join(F.broadcast(labelled_sample(labels, "quality", max_train)), "doc_id"), "x", "label").collect()
    y = np.array([float(r["label"] > 0) for r in train])
    if len(set(y)) == 2:
        w, b = fit_logistic(np.array([r["x"] for r in train]), y)
    else:
        w, b = np.zeros(len(FEATURES)), 0.0
    score = F.lit(b)
    for i, v in enumerate(w):
        score = score + F.get("x", F.lit(i)) * float(v)
    own = 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0))))
    x = x.select("doc_id", "text_hash", "host", "path", own.alias("own"))

    paths = cut(x.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") ** 2).alias("q")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))
    all_of = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = all_of["s"] / all_of["n"] if all_of["n"] else 0.5
    k_host, k_path = shrinkage(hosts, mean), shrinkage(paths, mean)
    rates = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    rates = paths.join(rates, F.col("host").eqNullSafe(F.col("h"))).select(
        F.col("host").alias("h"), F.col("path").alias("p"), "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_rate",
        ((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))
    rates = cut(rates)
    size = F.lit(64) + F.coalesce(F.octet_length("h"), F.lit(0)) + F.coalesce(F.octet_length("p"), F.lit(0))
    small = fits_broadcast(rates, size, broadcast_mb)
    x = x.join(F.broadcast(rates) if small else rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    # A document's own evidence counts once: it is left out of the record of its host and path.
    host_of_others = (F.col("host_s") - F.col("own") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    path_of_others = (F.col("path_s") - F.col("own") + k_path * host_of_others) / (F.col("path_n") - 1 + k_path)
    odds = _logit(F.col("own")) + _logit(path_of_others) - _logit(F.lit(mean))
    x = x.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return x.select("doc_id", "text_hash", "own", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, broadcast_mb: float = 32, **options) -> DataFrame:
    """The documents that are kept, columns unchanged; rows that are equal in id and text go or stay together."""
    gone = score_quality(docs, labels, host, path, broadcast_mb=broadcast_mb, **options).where("not keep")
    i, h = fresh(docs, "id_of", "hash_of")
    gone = cut(gone.select("doc_id", "text_hash").distinct().toDF(i, h))
    small = fits_broadcast(gone, F.lit(32), broadcast_mb)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def site(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of the documents table: its source, and the language section within it."""
    return docs["source"], docs["lang"]


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_quality(docs, load(spark, sf_dir, "labels"), *site(docs)).drop("text_hash")
