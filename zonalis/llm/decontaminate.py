"""Benchmark decontamination: documents scanned for the benchmark's word windows.

Native: DataFrame functions only. The windows of the benchmark are a small hashed table,
broadcast when a check of its size allows it and joined by shuffle beyond. Each window is
filed under its longest word: a document's words are hashed one by one against those anchors,
and where one is met, the whole window around it is compared word for word. One cheap probe
for each word replaces a hash of thirteen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fits_broadcast, fresh, load, tokens

#: What separates words: ASCII without digits and letters. Other characters belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return tokens(ascii_lower(text), SEPARATORS)


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """(gram, len, key, items): each distinct window of the benchmark and the items that hold it.

    An item shorter than the window, but with words, is one window. Items without an id still
    give windows; they are not listed.
    """
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(window)))
    b = b.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    b = b.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
    return (b.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))
            .withColumn("anchor", -longest["i"]).withColumn("key", F.xxhash64(F.get("gram", F.col("anchor")))))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_mb: float = 64) -> DataFrame:
    """(doc_id, text_hash, hits, items) for documents with a hit.

    hits: sorted 0-based positions of words inside any occurrence; items: sorted ids.
    Rows with equal id and text count as one document here; the caller joins them back.
    """
    grams = cut(window_table(benchmark, window))
    at = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    small = fits_broadcast(grams, F.lit(64) + F.length(F.concat_ws(" ", "gram")) + 16 * F.size("items"), broadcast_mb)
    keep = ["doc_id", "text_hash", *["w"] * small]
    whole = at.select("doc_id", "text_hash", "w").distinct() if not small else None
    at = at.select(*keep, F.posexplode("w").alias("at", "word")).withColumn("key", F.xxhash64("word"))
    at = at.join(F.broadcast(grams) if small else grams, "key").withColumn("start", F.col("at") - F.col("anchor"))
    if not small:  # the words come back only to places where an anchor was met
        whole = whole.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        at = at.join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    at = at.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("w")))
    at = at.where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("gram"))
    found = at.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    return found.select("doc_id", "text_hash", F.array_sort(F.array_distinct(covered)).alias("hits"),
                        F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "flag", window: int = 13, percent: int = 5) -> DataFrame:
    """Marks, cleans or drops documents that hold passages of the benchmark.

    mode "flag" adds n_words, hits (word positions), items and contaminated; "drop" returns the
    documents that are not contaminated; "cut" returns all documents, each hit span removed from
    its text. A document is contaminated if hits are at least `percent` of its words, and any.

    Null or empty texts have no words and are never contaminated. Repeated rows each get the same
    answer; a null doc_id is an id like any other. An empty benchmark marks nothing. Input columns
    named like a result are replaced; others are kept.
    """
    i, h, at, of = fresh(docs, "id_of", "hash_of", "hits_of", "items_of")
    found = find_hits(docs, benchmark, window).select("doc_id", "text_hash", "hits", "items").toDF(i, h, at, of)
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    n = F.size(tokens(F.col("text"), SEPARATORS_ANY_CASE))
    out = out.withColumns({
        "n_words": n.cast("long"), "hits": F.coalesce(at, F.array().cast("array<int>")),
        "items": F.coalesce(of, F.array().cast("array<string>"))}).drop(i, h, at, of)
    hit = F.size("hits").cast("long")
    out = out.withColumn("contaminated", (hit > 0) & (hit * 100 >= F.col("n_words") * percent))
    if mode == "flag":
        return out
    if mode == "drop":
        return out.where(~F.col("contaminated")).select(docs.columns)
    return out.withColumn("text", F.when(hit > 0, without_words(F.col("text"), F.col("hits"))).otherwise(F.col("text"))).select(docs.columns)


def without_words(text: Column, hits: Column) -> Column:
    """The text without the words at these sorted positions, nor what stands between two of them."""
    spans = F.arrays_zip(
        F.filter(hits, lambda x, i: (i == 0) | (F.try_element_at(hits, i) < x - 1)).alias("lo"),
        F.filter(hits, lambda x, i: F.coalesce(F.try_element_at(hits, i + 2) > x + 1, F.lit(True))).alias("hi"))
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    first_is_word = F.when(text.rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0).otherwise(1)
    # Words and separators alternate: piece i is word (i - shift) / 2, or stands after word floor of that.
    keep = F.filter(pieces, lambda p, i: ~F.exists(
        spans, lambda s: (i >= 2 * s["lo"] + first_is_word) & (i <= 2 * s["hi"] + first_is_word)))
    return F.array_join(keep, "")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    out = decontaminate(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT p.rid, p.i, p.n, g.item FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
