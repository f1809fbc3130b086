"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are one. Each table's bucket puts forward its smallest id as a leader; a vector joins the first
leader within half the threshold's angle. Any two members of such a ball are linked for certain, so a crowd of
near copies is counted by its size and never as pairs. What remains are pairs of balls that meet in a bucket:
leaders too far apart for any link between their members go, and the members of the others are compared
exactly. Links are counted for each vector; balls with a link between them are one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored
from .graph import connected_components

#: Standard deviations of the sign count beyond the expected ones at which a pair is put aside without a look at its vectors.
SIGMAS = 6.0


def table_count(bits: int, cosine: float, recall: float) -> int:
    """Tables of `bits` signs each in which a pair of this cosine meets at least once with probability `recall`."""
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def _sign_batches(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            bucket = np.zeros((batch.num_rows, tables), dtype=np.int64)
            words = -(-bits * tables // 64)
            sketch = np.zeros((batch.num_rows, words), dtype=np.int64)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = flat[starts[rows][:, None] + np.arange(d)].astype(np.float64)
                # Large and tiny components alike: only the direction counts.
                x /= np.abs(x).max(axis=1, keepdims=True)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                signs = x @ planes[d] >= 0
                bucket[rows] = signs.reshape(len(rows), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                packed = np.zeros((len(rows), words * 8), dtype=np.uint8)
                bytes_ = np.packbits(signs, axis=1)
                packed[:, : bytes_.shape[1]] = bytes_
                sketch[rows] = packed.view(np.int64)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), lists(bucket), lists(sketch)], names=["rep", "buckets", "sketch"])

    return run


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _apart(a: Column, b: Column) -> Column:
    """Signs in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, v: s + v)


def vector_links(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.9999, bits: int | None = None, seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors (vec_id bigint, embedding array, label); other columns are ignored.

    Rows are linked if their labels are equal and not null, their vectors have the same length and their cosine is
    least `cosine`. n_links counts the other rows linked with a row, equal ones and rows of the same vec_id among them.
    component_id is the smallest vec_id reachable. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, nor does a row without a vec_id (its component_id is null and it is kept).

    No pair below the threshold is linked; a pair at it is found with probability `recall`, closer ones more surely.
    bits: signs of a table; by default as many as the logarithm of the number of vectors, so that unrelated vectors
    stay few in a bucket at any size; the number of tables follows from bits and recall.
    """
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # Adding zero makes a negative zero a zero.
    rows = vectors.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("v"))
    rows = rows.withColumn("good", F.coalesce(ok & finite, F.lit(False)))
    reps = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("w"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()))
    n = reps.count()
    bits = bits or min(60, max(10, math.ceil(math.log2(n + 1)) - 1))
    tables = table_count(bits, cosine, recall)
    total, theta = bits * tables, math.acos(cosine)

    signs = reps.select("rep", F.col("v").alias("vector")).mapInArrow(_sign_batches(bits, tables, seed), "rep bigint, buckets array<bigint>, sketch array<bigint>")
    signs = stored(signs.join(reps.select("rep", "label", F.size("v").alias("dim")), "rep"))
    at = signs.select("rep", "label", "dim", F.posexplode("buckets").alias("table", "bucket"))
    place = ["label", "dim", "table", "bucket"]

    def far(limit: Column) -> Column:
        """More signs apart than pairs within the angle `limit` ever are."""
        p = F.least(limit / math.pi, F.lit(0.5))
        return F.col("apart") > total * p + SIGMAS * F.sqrt(total * p * (1 - p)) + 1

    # Scaled by a power of two, which changes no cosine and keeps squares finite.
    top = F.array_max(F.transform("v", F.abs))
    values = reps.select("rep", F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(top)))).alias("v"))
    sketches = signs.select("rep", "sketch")

    def measured(pairs: DataFrame, limit: Column) -> DataFrame:
        """pairs (a, b, ...) with angle and cosine, without those surely farther apart than `limit`."""
        p = pairs.join(sketches.toDF("a", "_sa"), "a").join(sketches.toDF("b", "_sb"), "b").withColumn("apart", _apart(F.col("_sa"), F.col("_sb")))
        p = p.where(~far(limit)).drop("_sa", "_sb", "apart")
        p = p.join(values.toDF("a", "_va"), "a").join(values.toDF("b", "_vb"), "b").withColumn("cos", cosine_of(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")
        return p.withColumn("angle", F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))))

    # Balls: the first leader within half the angle, less a hair for rounding.
    half = theta / 2 - 1e-9
    leaders = at.groupBy(*place).agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    near = at.join(leaders, place).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    near = measured(near, F.lit(half)).where(F.col("angle") <= half)
    led = near.groupBy(F.col("b").alias("rep")).agg(F.min(F.struct("a", "angle")).alias("m")).select("rep", F.col("m.a").alias("ball"), F.col("m.angle").alias("radius"))
    ball = reps.select("rep", "w", "least_id").join(led, "rep", "left").select("rep", "w", "least_id", F.coalesce("ball", "rep").alias("ball"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    ball = stored(ball)
    size = stored(ball.groupBy("ball").agg(F.sum("w").alias("weight"), F.max("radius").alias("reach"), F.min("least_id").alias("least")))

    # Pairs of balls that meet in a bucket and whose leaders are near enough for a link between members.
    held = at.join(ball.select("rep", "ball"), "rep").select(*place, "ball").distinct()
    meet = held.join(held.withColumnRenamed("ball", "ball2"), place).where("ball < ball2").select("ball", "ball2").distinct()
    reach = size.select("ball", "reach")
    meet = meet.join(reach, "ball").join(reach.toDF("ball2", "reach2"), "ball2").select(F.col("ball").alias("a"), F.col("ball2").alias("b"), (F.col("reach") + F.col("reach2")).alias("reach"))
    limit = F.col("reach") + theta + 1e-9
    close = stored(measured(meet, limit).where(F.col("angle") <= limit).select(F.col("a").alias("ball"), F.col("b").alias("ball2"), F.col("angle").alias("between")))

    # Their members, compared exactly.
    own = ball.select("ball", "rep", "w", "radius")
    cross = close.join(own.withColumnsRenamed({"rep": "a", "w": "wa", "radius": "ra"}), "ball").join(own.toDF("ball2", "b", "wb", "rb"), "ball2")
    # A leader's own ball counts it only if it is a member, so distances to leaders bound those between members.
    cross = cross.where(F.col("between") <= F.col("ra") + F.col("rb") + theta + 1e-9)
    links = stored(measured(cross.select("a", "b", "wa", "wb", "ball", "ball2"), F.lit(theta)).where(F.col("cos") >= cosine).select("a", "b", "wa", "wb", "ball", "ball2"))
    more = links.select(F.col("a").alias("rep"), F.col("wb").alias("more")).unionByName(links.select(F.col("b").alias("rep"), F.col("wa").alias("more"))).groupBy("rep").agg(F.sum("more").alias("more"))

    component = connected_components(links, "ball", "ball2")
    of = size.join(component.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("ball", "weight", "component_id")
    out = ball.join(of, "ball").join(more, "rep", "left").select("rep", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = reps.select("label", "v", "rep").join(out, "rep").drop("rep")
    linked = rows.where("good").join(out, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(load(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93e0),
t(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.node, u.b FROM t JOIN u ON u.a = t.reach),
r AS (SELECT node, min(reach) AS c FROM t GROUP BY node),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.c AS component_id, vec_id = r.c AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.node = vec_id
"""
