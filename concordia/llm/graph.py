"""Connected components of an edge table, by alternating large-star and small-star steps.

Only DataFrame operations; every round is cut by a reliable checkpoint. No round gathers a node's neighbours in one row: a
group minimum is a partial aggregate, and it returns to the edges through a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b. Large: every neighbour above a node moves to the node's least neighbour. Small: every
    neighbour below it, and the node itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    seen = both.join(least, "a")
    moved = seen.where(F.col("b") > F.col("a")) if large else seen.where(F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, of one orderable type); component is the least node.

    Null ends and loops are ignored: a node that has only loops is not returned. An empty table gives an empty table.
    """
    x, y = edges.columns[:2]
    e = edges.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    e = lasting(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        e = lasting(_star(_star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("connected components did not converge")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
