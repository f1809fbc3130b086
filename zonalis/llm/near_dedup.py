"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, grouping.

Texts with one and the same shingle set collapse first, so a hot group of copies is one set from then
on. Sets that share a band are candidates. Each is first verified against one leader, the most central
of those that it shares most bands with; what that connects needs no further test, so a large group of
near copies costs one test for each member. Sets that are still in different components are then
paired, but for those of crowded bands that cannot be similar: a set knows how many shingles no
other one has, how many of its leader's it lacks, and how many of its own that the leader lacks stand in
another set of the same leader. No link between different texts is given up for that.
Bands are rows of 8 out of 504 values: at a similarity of 0.8 a pair shares none of the 63 bands
with a probability of 9 in a million, at 0.85 of 1 in a hundred million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, load, shuffles_freed, stored
from .graph import forest_roots, merged
from .shingles import gram_batches, overlap_batches, signature_batches

#: Bands with more unconnected sets than this are looked at closely before pairs are made; results do not depend on it.
CROWD = 8


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 63, rows: int = 8, crowd: int = CROWD, broadcast_mb: float = 8) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked when their sets of word shingles have a Jaccard similarity of percent/100
    or more; component_id is the smallest doc_id reachable over links, itself included; kept marks it.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a
    doc_id are one node, whatever their texts. Rows without a doc_id still count their shingles, but are
    linked with nothing and kept, their component being null. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    made = stored(docs.mapInArrow(signature_batches(words, bands, rows), "doc_id bigint, hash bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>"))
    key = ["key1", "key2", "n_shingles"]
    full = made.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy(*key).agg(F.min(F.struct("doc_id", "hash")).alias("rep"))
    sets = stored(sets.select(F.monotonically_increasing_id().alias("set"), F.col("rep.doc_id").alias("rep"), F.col("rep.hash").alias("hash"), *key))

    def hinted(df: DataFrame) -> DataFrame:
        """Broadcast if it is small: every table here has a few numbers in a row."""
        return F.broadcast(df) if fits_broadcast(df, F.lit(16 * len(df.columns)), broadcast_mb) else df

    docs = one_row_each(docs, full, sets, hinted)
    one = full.join(hinted(sets.select("set", F.col("rep").alias("doc_id"), "hash", *key)), ["doc_id", "hash", *key]).dropDuplicates(["set"])
    w = Window.partitionBy("band")
    shared = one.select("set", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("band"))
    shared = stored(shared.withColumn("met", F.count(F.lit(1)).over(w)).where("met > 1"))

    def overlaps(pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, both): the sizes of two sets and of what they have in common, from the texts."""
        at = sets.select("set", F.col("rep").alias("doc_id"), "hash")
        left = cut(at.withColumnRenamed("set", "a").join(pairs.select("a").distinct(), "a"))
        right = cut(at.withColumnRenamed("set", "b").join(pairs.select("a", "b"), "b"))
        left = docs.join(hinted(left), ["doc_id", "hash"]).select("a", F.col("text").alias("text_a"))
        right = docs.join(hinted(right), ["doc_id", "hash"]).select("a", "b", F.col("text").alias("text_b"))
        return cut(right.join(left, "a").mapInArrow(overlap_batches(words), "a bigint, b bigint, n_a int, n_b int, both int").distinct())

    similar = F.col("both") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))

    # One leader for each set: of those it shares bands with, the one that meets most others.
    hub = shared.groupBy("set").agg(F.sum("met").alias("hub"))
    led = shared.join(hub, "set").withColumn("lead", F.max(F.struct("hub", (-F.col("set")).alias("l"))).over(w))
    votes = led.where(F.col("lead.l") != -F.col("set")).groupBy("set", "lead").agg(F.count(F.lit(1)).alias("count"))
    first = votes.groupBy("set").agg(F.max(F.struct("count", "lead.hub", "lead.l")).alias("x"))
    tested = overlaps(cut(first.select(F.col("set").alias("b"), (-F.col("x.l")).alias("a"))))
    # A leader comes before those that it leads in the order of hubs, so links to leaders are a forest.
    component = forest_roots(tested.where(similar), "b", "a")

    # Sets of one doc_id are one node.
    several = full.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("doc_id")
    several = full.join(several, "doc_id").join(sets.drop("hash"), key).select("doc_id", "set").distinct()
    several = several.join(several.groupBy("doc_id").agg(F.min("set").alias("a")), "doc_id").where("a <> set").select("a", F.col("set").alias("b"))

    # Then every candidate pair that is not connected yet and that can be similar.
    named = shared.join(component.withColumnRenamed("node", "set"), "set", "left").select("band", "set", "n", F.coalesce("component", "set").alias("c"))
    mixed = named.withColumns({"lo": F.min("c").over(w), "hi": F.max("c").over(w)}).where("lo <> hi").select("band", "set", "n", "c")
    mixed = stored(mixed.withColumn("crowd", F.count(F.lit(1)).over(w)))
    size = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    few = mixed.where(F.col("crowd") <= crowd).select("band", F.col("set").alias("a"), "n", "c")
    cold = few.join(few.toDF("band", "b", "n2", "c2"), "band").where((F.col("c") < F.col("c2")) & size).select("a", "b")
    cold = cold.join(cold_tested(tested), ["a", "b"], "left_anti")

    many = mixed.where(F.col("crowd") > crowd)
    facts = known(many.select("set", "n", "c").distinct(), tested, sets, docs, hinted, words)
    # Not enough left without the shingles that no other has: similar to none.
    facts = stored(facts.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent))
    side = {c: f"{c}2" for c in facts.columns if c != "lead"}
    alone = (((F.col("n") - F.col("own")) * 100 >= (F.col("n") + F.col("own2")) * percent) & ((F.col("n2") - F.col("own2")) * 100 >= (F.col("n2") + F.col("own")) * percent))
    # Of one leader: what both have of it, and what they have besides in common, at most.
    most = F.col("n_lead") - F.greatest("lacks", "lacks2") + F.least("extra", "extra2")
    bound = (100 + percent) * most >= percent * (F.col("n") + F.col("n2"))
    together = facts.join(facts.withColumnsRenamed(side), "lead").where((F.col("c") < F.col("c2")) & size & alone & bound).select(F.col("set").alias("a"), F.col("set2").alias("b"))
    at = many.select("band", "set").join(facts, "set").select("band", "set", "n", "c", "lead", "own")
    at = at.withColumns({"l1": F.min("lead").over(w), "l2": F.max("lead").over(w)}).where("l1 <> l2").drop("l1", "l2")
    apart = at.join(at.withColumnsRenamed({c: f"{c}2" for c in at.columns if c != "band"}), "band")
    apart = apart.where((F.col("c") < F.col("c2")) & (F.col("lead") != F.col("lead2")) & size & alone).select(F.col("set").alias("a"), F.col("set2").alias("b"))
    rest = cold.unionByName(together).unionByName(apart).distinct()
    more = overlaps(cut(rest)).where(similar).select("a", "b").unionByName(several)
    for end in ("a", "b"):
        more = more.join(component.toDF(end, f"c{end}"), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    component = merged(component, more, "a", "b")

    group = sets.join(component.withColumnRenamed("node", "set"), "set", "left").select(*key, "rep", F.coalesce("component", "set").alias("c"))
    least = group.groupBy("c").agg(F.min("rep").alias("least"))
    out = made.select("doc_id", *key).join(group.join(least, "c").select(*key, "least"), key, "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    # A doc_id that stands on texts without words too is in the component of its other texts.
    empty = out.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    empty = out.where("n_shingles > 0").join(empty, "doc_id").groupBy("doc_id").agg(F.min("least").alias("of"))
    out = out.join(hinted(empty), "doc_id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, c).otherwise(F.coalesce("of", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_row_each(docs: DataFrame, full: DataFrame, sets: DataFrame, hinted) -> DataFrame:
    """docs, with one row for each representative's text that stands on several equal rows.

    Texts are fetched by (doc_id, hash); without this, pairs of repeated rows would be compared in the square.
    """
    twice = full.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    twice = cut(sets.select(F.col("rep").alias("doc_id"), "hash").distinct().join(twice, ["doc_id", "hash"]))
    if twice.isEmpty():
        return docs
    twice = hinted(twice)
    once = stored(docs.join(twice, ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("text").alias("text")))
    return docs.join(twice, ["doc_id", "hash"], "left_anti").unionByName(once)


def cold_tested(tested: DataFrame) -> DataFrame:
    """The pairs that were tested, both ways."""
    return tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))


def known(hot: DataFrame, tested: DataFrame, sets: DataFrame, docs: DataFrame, hinted, words: int) -> DataFrame:
    """(set, n, c, own, lead, n_lead, lacks, extra) for the sets of crowded bands.

    own: shingles that no other of these sets has, nor one of their leaders. lacks: shingles of the leader
    that the set has not. extra: its shingles that the leader has not, but another set of that leader has.
    A set that no leader was found for is its own.
    """
    of = tested.select(F.col("b").alias("set"), F.col("a").alias("lead"), F.col("n_a").alias("n_lead"), (F.col("n_a") - F.col("both")).alias("lacks"), (F.col("n_b") - F.col("both")).alias("besides"))
    hot = cut(hot.join(of, "set", "left").select("set", "n", "c", F.coalesce("lead", "set").alias("lead"), F.coalesce("n_lead", "n").alias("n_lead"), F.coalesce("lacks", F.lit(0)).alias("lacks"), F.coalesce("besides", F.lit(0)).alias("besides")))
    # Leaders count among those that they lead, too; such rows say nothing about the leader itself.
    led = hot.select("set", "lead", F.lit(False).alias("guest"))
    guests = hot.select(F.col("lead").alias("set")).distinct().join(hot.where("set = lead").select("set"), "set", "left_anti")
    led = led.unionByName(guests.select("set", F.col("set").alias("lead"), F.lit(True).alias("guest")))
    led = cut(led.join(sets.select("set", F.col("rep").alias("doc_id"), "hash"), "set"))
    text = docs.join(hinted(led), ["doc_id", "hash"]).select("set", "lead", "guest", "text")
    grams = text.mapInArrow(gram_batches(words), "set bigint, lead bigint, guest boolean, gram bigint")
    grams = grams.groupBy("gram", "lead").agg(F.min("set").alias("set"), F.max("set").alias("last"), F.bool_or("guest").alias("guest"))
    total = Window.partitionBy("gram")
    grams = grams.withColumns({"lo": F.min("set").over(total), "hi": F.max("last").over(total)}).where("set = last and not guest")
    own = grams.groupBy("set").agg(F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("own"), F.count(F.lit(1)).alias("own_here"))
    out = hot.join(own, "set", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "own_here": F.coalesce("own_here", F.lit(0))})
    return out.select("set", "n", "c", "own", "lead", "n_lead", "lacks", F.greatest(F.col("besides") - F.col("own_here"), F.lit(0)).alias("extra"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked with a smaller doc_id, columns unchanged."""
    with shuffles_freed(docs.sparkSession):
        gone = cut(near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), words=4)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.node, u.b FROM t JOIN u ON u.a = t.reach),
r AS (SELECT node, min(reach) AS c FROM t GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.node = d.doc_id
"""
