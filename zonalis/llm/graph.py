"""Connected components by repeated contraction, and roots of forests; edges and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits_broadcast


def forest_roots(pointers: DataFrame, child: str, parent: str, broadcast_mb: float = 8) -> DataFrame:
    """One row (node, component) for each node of a forest; component is the root of its tree.

    Every child has one pointer, and pointers have no cycle. Each round doubles how far they reach.
    """
    p = cut(pointers.select(F.col(child).alias("node"), F.col(parent).alias("p")))
    small = fits_broadcast(p, F.lit(32), broadcast_mb)
    while True:
        up = p.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        step = cut(p.join(F.broadcast(up) if small else up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            break
        p = step.select("node", "p")
    return p.select("node", F.col("p").alias("component")).unionByName(p.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", broadcast_mb: float = 8) -> DataFrame:
    """One row (node, component) for each node with an edge; component is the smallest node id reachable.

    Each round points every node at the neighbour (or itself) that comes first in an order drawn anew by
    hash, follows the pointers once more and contracts the edges, so chains shrink by a constant share
    whatever their ids; a round reads and writes only what is still unsettled. The smallest id of each
    contracted group is found at the end. Null ends and loops are ignored; an empty input gives no rows.
    """
    e = (edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = cut(e)
    labels, turn, left = None, 0, e.count()
    while left:
        turn += 1
        # Pointers number twice the edges at most.
        hint = F.broadcast if left * 64 <= broadcast_mb * 1e6 else (lambda x: x)

        def rank(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))

        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), "m")["id"].alias("p")))
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(hint(up), "p").select("node", F.col("pp").alias("p")))
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            moved = parent.select(F.col("node").alias("component"), F.col("p").alias("to"))
            labels = cut(labels.join(hint(moved), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        pa, pb = hint(parent.toDF("a", "pa")), hint(parent.toDF("b", "pb"))
        e = cut(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
        left = e.count()
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("component").agg(F.least(F.min("node"), F.min("component")).alias("to"))
    return labels.join(least, "component").select("node", F.col("to").alias("component"))


def merged(component: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) after edges between components; a node without a row is a component of its own."""
    edges = cut(edges.select(src, dst).distinct())
    to = cut(connected_components(edges, src, dst)).toDF("component", "to")
    new = to.select(F.col("component").alias("node")).join(component, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(component.unionByName(new).join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
