"""Spelling variants: words one edit apart, found as equal pairs of trie nodes.

The nodes of a trie of the words and of one of the reversed words have numbers. Word w split before
position i is the pair (node of w[:i], node of w[i:]); w without position i is (node of w[:i], node of
w[i+1:]). Two words with the same pair of the second kind differ by a replacement at i; one pair of the
first kind equal to one of the second is a deletion. A pair names one word of the first kind, and at most
as many words of the second kind as there are letters, so no group grows with the vocabulary, and sums
and maxima over a group need no pairs of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, load, stored
from .graph import forest_roots

#: Longest piece of a word that stands in a node's key as it is.
PIECE = 64


def vocabulary(docs: DataFrame, least_points: int = 6, least_n: int = 5, slips: int = 199) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; a run whose checksum `slips` divides has lost one code point.

    Null texts have no runs. In a text without doc_id no run loses a code point. slips = 0 switches the losses off.
    """
    run = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if slips:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % slips == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length("run")))).otherwise(word)
    return run.select(word.alias("word")).where(F.length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _key(piece: Column, n: Column, whole: Column) -> Column:
    """A string that stands for the first n code points of `whole`: short, whatever n is; piece: those beyond the last full PIECE."""
    return F.when(n < PIECE, piece).otherwise(F.concat(F.sha2(F.substring(whole, F.lit(1), (n - n % PIECE).cast("int")), 256), F.lit(":"), piece))


def trie_nodes(words: DataFrame) -> DataFrame:
    """(id, depth, node) for each prefix of each word (id, word), the empty one and the word itself included; equal prefixes have equal numbers."""
    p = words.select("id", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    d = F.col("depth")
    p = p.select("id", "depth", _key(F.substring("word", (d - d % PIECE + 1), (d % PIECE)), d, F.col("word")).alias("key"))
    # The empty prefix and the sentinel number need no dictionary: all words have it.
    number = cut(p.where("depth > 0").select("key").distinct().select("key", (F.monotonically_increasing_id() + 1).alias("node")))
    return p.where("depth > 0").join(number, "key").select("id", "depth", "node").unionByName(words.select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node")))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many other words are one edit away, and (-n, id) of the one with the largest n, ties by id.

    words: (id, word, n), words distinct. Words without neighbours have no row.
    """
    forward = trie_nodes(words).withColumnRenamed("node", "prefix")
    back = trie_nodes(words.select("id", F.reverse("word").alias("word"))).withColumnRenamed("node", "suffix")
    nodes = forward.select("id", F.struct("depth", "prefix").alias("f"), F.lit(None).cast("struct<depth:int,suffix:bigint>").alias("b")).unionByName(
        back.select("id", F.lit(None).cast("struct<depth:int,prefix:bigint>").alias("f"), F.struct("depth", "suffix").alias("b")))
    # The nodes of one word, by depth: as many as it has letters.
    each = nodes.groupBy("id").agg(F.array_sort(F.collect_list("f")).alias("f"), F.array_sort(F.collect_list("b")).alias("b"))
    each = each.join(words, "id").withColumn("len", F.length("word"))

    def prefix(i: Column) -> Column:
        return F.get("f", i)["prefix"]

    def suffix(i: Column) -> Column:
        return F.get("b", F.col("len") - i)["suffix"]

    def letter(i: Column) -> Column:
        return F.substring("word", i + 1, F.lit(1))

    # Of equal letters in a row, only the first stands for the loss of one.
    skip = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct(prefix(i).alias("p"), suffix(i + 1).alias("s"), F.lit(True).alias("skip"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first")))
    split = F.transform(F.sequence(F.lit(0), F.col("len")), lambda i: F.struct(prefix(i).alias("p"), suffix(i).alias("s"), F.lit(False).alias("skip"), F.lit(False).alias("first")))
    pairs = each.select(F.struct((-F.col("n")).alias("m"), F.col("id").alias("id")).alias("w"), F.inline(F.concat(skip, split)))
    met = pairs.groupBy("p", "s").agg(
        F.sort_array(F.collect_list(F.when(F.col("skip"), F.struct("w.m", "w.id", "first")))).alias("skips"), F.max(F.when(~F.col("skip"), F.col("w"))).alias("split"))
    met = met.where((F.size("skips") > 1) | (F.col("split").isNotNull() & F.exists("skips", lambda x: x["first"])))

    def plain(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["id"].alias("id"))

    firsts = F.filter("skips", lambda x: x["first"])
    top, second = plain(F.get("skips", F.lit(0))), F.when(F.size("skips") > 1, plain(F.get("skips", F.lit(1))))

    def of_skip(x: Column) -> Column:
        other = F.when(x["id"] == F.get("skips", F.lit(0))["id"], second).otherwise(top)
        shorter = F.when(x["first"], F.col("split"))
        n = F.size("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
        return F.struct(x["id"].alias("id"), n.cast("long").alias("n_near"), F.least(other, shorter).alias("best"))

    of_split = F.when(F.col("split").isNotNull() & (F.size(firsts) > 0), F.array(F.struct(F.col("split.id").alias("id"), F.size(firsts).cast("long").alias("n_near"), plain(F.get(firsts, F.lit(0))).alias("best"))))
    one = met.select(F.explode(F.concat(F.transform("skips", of_skip), F.coalesce(of_split, F.array().cast("array<struct<id:bigint,n_near:bigint,best:struct<m:bigint,id:bigint>>>")))).alias("x")).select("x.*").where("n_near > 0")
    return one.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n); other columns are ignored.

    n_near counts the words exactly one inserted, deleted or replaced code point away. form is the one of them with
    the largest n (ties: smallest in code-point order) if that is at least ratio * n, else null; root is the end of
    the chain of forms, the word itself if it has none. Rows with a null or empty word are left out, rows of one word
    are added up (a null n counts 0); an empty table gives no rows; words of any length are taken whole.
    """
    if ratio < 2:
        raise ValueError("chains of forms must grow")
    clean = words.where("word is not null and word <> ''").groupBy("word").agg(F.sum(F.coalesce(F.col("n").cast("long"), F.lit(0))).alias("n"))
    # Numbers in the order of the words, so that ties are settled by number.
    named = stored(clean.orderBy("word").select("word", "n", F.monotonically_increasing_id().alias("id")))
    near = stored(neighbours(named))
    form = named.join(near, "id", "left").select("id", "n", "n_near", F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    # A word that no one has seen has no form, or its chain could go round.
    form = cut(form.select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("n") > 0, F.col("best.id")).alias("form_id")))
    root = forest_roots(form.where("form_id is not null"), "id", "form_id").withColumnsRenamed({"node": "id", "component": "root_id"})
    out = form.join(root, "id", "left").withColumn("root_id", F.coalesce("root_id", "id")).join(named.select("id", "word"), "id")
    out = out.join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id", "left")
    out = out.join(named.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(load(spark, sf_dir, "documents")))
