"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters differ in kind: short fixed lexicons by theme, lexicons of whole words, of word beginnings and
of word endings induced from the learning rows, patterns of characters and lines, an address next to
a word of contempt, and a count of hits. A generative model of the votes, fitted by expectation
maximisation without looking at single labels, estimates each voter's accuracy; voters that still
agree within a class beyond chance are correlated and share their weight. The posteriors it gives the
learning rows are the targets of a linear classifier on words and word beginnings, which then scores
every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .quality import one_of_each_id

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Letters of a word ending.
ENDING = 4
#: Log-odds above which a part enters a lexicon, and above which a whole word enters the stronger one.
ODDS, STRONG = 2.5, 4.5
#: Words of three themes, in a few languages; a start for texts that no label has shown yet.
THEMES = {
    "folly": "blockhead blödmann bobo crétin dumb dummkopf estúpido fool idiot idiota idioten imbécil imbécile loser moron perdedor stupid stupide trottel tonto versager",
    "contempt": "abschaum asqueroso basura dreck escoria filth garbage inútil minable ordure pathetic patético scum trash vermin wertlos worthless",
    "threat": "crève hang kill mata muere shoot stirb strangle tuer umbringen",
}
THEMES = {k: frozenset(v.split()) for k, v in THEMES.items()}
#: Voters on characters, lines and neighbours; each sees the whole text.
PATTERNS = (
    re.compile(r"\b(?:you|you're|they|such)\b[^.!?\n]{0,40}[!]", re.IGNORECASE),
    re.compile(r"\b[^\W\d_a-z]{4,}[!?]{1,}"),
    re.compile(r"\b[^\W\d_]+[*@#$]{2,}[^\W\d_]*|[@#$%&*!]{4,}"),
    re.compile(r"([^\W\d_])\1{3,}"),
    re.compile(r"(?m)^[^\n]{1,60}!{2,}\s*$"),
    re.compile(r"\b(?:you|tu|eres|du|ihr|vous|like|como|wie|with)\s+(?:an?\s+|un[ae]?\s+|ein\s+)?(?:" + "|".join(sorted(THEMES["folly"] | THEMES["contempt"])) + r")\b", re.IGNORECASE),
)


def parts(text: str) -> list[str]:
    """The distinct words of a text, and their beginnings with a hyphen."""
    words = set(WORD.findall(text.lower()))
    starts = {w[:n] + "-" for w in words if len(w) > min(PREFIXES) for n in PREFIXES if len(w) > n}
    return [*words, *starts]


def endings(words: list[str]) -> set[str]:
    """Last letters of the words among parts, after a hyphen."""
    return {"-" + w[-ENDING:] for w in words if len(w) > ENDING and not w.endswith("-")}


class Voters:
    """Lexicon voters by kind of part; a vote is 1 (toxic), -1 (clean) or 0 (none)."""

    def __init__(self, lists: list[frozenset]):
        self.lists = lists

    @classmethod
    def induced(cls, sets: list[list[str]], y: np.ndarray, weight: np.ndarray, most: int = 400) -> Voters:
        """Strong words, weaker words, beginnings by length, endings: parts that toxic rows hold far more often, by smoothed log-odds."""
        toxic, clean = Counter(), Counter()
        for s, t, w in zip(sets, y, weight.tolist(), strict=True):
            of = toxic if t else clean
            for p in (*s, *endings(s)):
                of[p] += w
        n1, n0 = float(weight @ y), float(weight @ (1 - y))
        odds = {p: np.log((c + 0.5) / (n1 + 1)) - np.log((clean[p] + 0.5) / (n0 + 1)) for p, c in toxic.items() if c >= max(4, 0.01 * n1)}

        def strongest(kind) -> frozenset:
            found = sorted((p for p in odds if odds[p] > ODDS and kind(p)), key=lambda p: (-odds[p] * toxic[p] ** 0.5, p))
            return frozenset(found[:most])

        return cls([
            strongest(lambda p: "-" not in p and odds[p] > STRONG),
            strongest(lambda p: "-" not in p and odds[p] <= STRONG),
            *(strongest(lambda p, n=n: p.endswith("-") and len(p) == n + 1) for n in PREFIXES),
            strongest(lambda p: p.startswith("-")),
        ])

    def votes(self, seen: list[str]) -> list[int]:
        """One vote of each list and each theme, and one on how many lists hit."""
        have = {*seen, *endings(seen)}
        hits = [not x.isdisjoint(have) for x in (*self.lists, *THEMES.values())]
        return [*map(int, hits), 1 if sum(hits) > 1 else -1 if not any(hits) else 0]


class LabelModel(NamedTuple):
    """posterior: of toxic, for each row; table: class x voter x vote (-1, 0, 1) probabilities; shared: voter x voter correlation within a class."""

    posterior: np.ndarray
    table: np.ndarray
    shared: np.ndarray


def label_model(votes: np.ndarray, prior: float, steps: int = 50) -> LabelModel:
    """Posterior of toxic for each row, from the votes alone.

    Each voter has a table of vote probabilities in either class; expectation maximisation starts
    from the sum of votes. Then what two voters agree on within a class beyond independence is
    their correlation, and each voter's evidence is divided by one plus what it shares with others.
    """
    n, m = votes.shape
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    total = votes.sum(axis=1)
    # The share that the prior expects, by the sum of votes, starts as toxic.
    cut = np.quantile(total, 1 - prior) if n else 0
    post = np.where(total > max(cut, total.min() if n else 0), 0.9, 0.1)
    share, shared = np.ones(m), np.zeros((m, m))
    for step in range(steps):
        table = np.stack([np.einsum("n,nmv->mv", p, one_hot) + 0.5 for p in (1 - post, post)])
        table /= table.sum(axis=2, keepdims=True)
        evidence = np.einsum("nmv,mv->nm", one_hot, np.log(table[1]) - np.log(table[0]))
        if step == steps // 2:
            for p in (1 - post, post):
                centred = votes - np.average(votes, axis=0, weights=p + 1e-9)
                cov = (centred * p[:, None]).T @ centred / max(p.sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                shared += np.abs(cov / sd[:, None] / sd) / 2
            np.fill_diagonal(shared, 0)
            share = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
        odds = evidence @ share + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return LabelModel(post, table, shared)


def fit_linear(sets: list[list[str]], target: np.ndarray, weight: np.ndarray, most: int = 6000, epochs: int = 60, rate: float = 0.5) -> tuple[dict[str, float], float]:
    """Logistic regression on the parts that speak for the positive class; returns weights and intercept.

    Only parts that are several times as frequent there, beyond chance, get a weight, and none below
    zero: long clean texts do not add up noise, and clean words do not excuse toxic ones.
    """
    n, mass = Counter(), Counter()
    for s, t, u in zip(sets, target.tolist(), weight.tolist(), strict=True):
        for p in s:
            n[p] += u
            mass[p] += u * t
    mean = float(np.average(target, weights=weight)) if len(target) else 0.0
    least = max(4.0, 0.01 * float(weight @ target))
    z = {p: (mass[p] - c * mean) / (c * mean * (1 - mean) + 1e-9) ** 0.5 for p, c in n.items() if mass[p] >= least and mass[p] > 0.5 * c}
    chosen = sorted((p for p in z if z[p] > 5), key=lambda p: (-z[p], p))[:most]
    number = {p: i for i, p in enumerate(chosen)}
    rows, cols = [], []
    for i, s in enumerate(sets):
        for p in s:
            if p in number:
                rows.append(i)
                cols.append(number[p])
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    w, b = np.zeros(len(chosen)), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    seen = np.bincount(cols, weights=weight[rows], minlength=len(chosen)) + 1.0
    for _ in range(epochs):  # full-batch steps, each part scaled by how often it stands
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, weights=w[cols], minlength=len(sets)), -30, 30)))
        g = (target - p) * weight
        w += rate * (np.bincount(cols, weights=g[rows], minlength=len(chosen)) / seen * 4 - 0.01 * w)
        w = np.maximum(w, 0)
        b += rate * float(g.mean()) * 4
    return {p: float(w[i]) for p, i in number.items()}, b


#: Longest lines of a text by which copies are told.
N_LINES = 5


def signs(text: str) -> list[int]:
    """The votes of the patterns, and hashes of the longest lines."""
    lines = [zlib.crc32(x.encode()) >> 1 for x in sorted(set(text.split("\n")), key=lambda x: (-len(x), x))[:N_LINES]]
    return [*(int(bool(p.search(text))) for p in PATTERNS), *lines, *[0] * (N_LINES - len(lines))]


def copy_weights(lines: np.ndarray) -> np.ndarray:
    """One over the most rows with which a row shares a long line: a group of copies counts about once."""
    shared = Counter(lines[lines > 0].tolist())
    return np.array([1.0 / max([1, *(shared[x] for x in row if x)]) for row in lines.tolist()])


def learning_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, label) of at most max_train labelled ids whose crc32 is not divisible by 5."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(known), "doc_id")
    return one_of_each_id(rows, "text", "label")


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> tuple[dict[str, float], float]:
    """Weights of parts and intercept; without rows of both kinds no part has a weight."""

    def distinct_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array([sorted(parts(t)) for t in texts], pa.list_(pa.string())),
                                              pa.array([signs(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "label", "parts", "signs"])

    got = learning_rows(docs, labels, max_train).mapInArrow(distinct_parts, "doc_id bigint, label int, parts array<string>, signs array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    y = np.array([int(v > 0) for v in got["label"].to_pylist()])
    if len(set(y.tolist())) < 2:
        return {}, -3.0
    sets, seen = got["parts"].to_pylist(), np.array(got["signs"].to_pylist())
    weight = copy_weights(seen[:, len(PATTERNS):])
    return fit_linear(sets, label_model(cast_votes(sets, seen, y, weight), float(np.average(y, weights=weight))).posterior, weight)


def cast_votes(sets: list[list[str]], seen: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Votes of all voters (columns) on the learning rows."""
    voters = Voters.induced(sets, y, weight)
    return np.array([[*voters.votes(s), *p] for s, p in zip(sets, seen[:, :len(PATTERNS)].tolist(), strict=True)])


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of docs.

    Learns from at most max_train labelled ids, none with crc32(doc_id) divisible by 5; scores use
    the text alone. Null and empty texts get the intercept's score; equal rows equal scores; a null
    doc_id is scored but not held out; an empty table gives no rows.
    """
    weights, intercept = train(docs, labels, max_train)
    starts = {p[:-1]: w for p, w in weights.items() if p.endswith("-")}
    words = {p: w for p, w in weights.items() if not p.endswith("-")}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, tuple[str, ...]]] = {}

        def known(w: str) -> tuple[float, tuple[str, ...]]:
            if len(cache) > 1 << 18:
                cache.clear()
            cache[w] = found = (words.get(w, 0.0), tuple(w[:n] for n in PREFIXES if len(w) > n and w[:n] in starts))
            return found

        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                total, begun = intercept, set()
                for w in set(WORD.findall((t or "").lower())):
                    weight, prefixes = cache.get(w) or known(w)
                    total += weight
                    begun.update(prefixes)
                # Sorted, so that equal texts add up in equal order.
                out.append(round(1 / (1 + np.exp(-min(max(total + sum(starts[p] for p in sorted(begun)), -30.0), 30.0))), 9))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
