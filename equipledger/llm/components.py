"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipledger.llm.common import saved

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component_id)`` for every node of an edge; component_id is the smallest node.

    Each round maps every node's larger neighbours to its smallest one (large star), then does the same among
    the smaller neighbours (small star); both are a min per node (partial aggregation) and a join on the node.
    Rounds grow with the logarithm of the longest chain. Self loops, null ends and repeated edges are harmless;
    no edges give no rows. A graph that hasn't settled after ``MAX_ROUNDS`` rounds raises.
    """
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = saved(e, "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        e = saved(_small_star(_large_star(e)), "edges")
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        mark = now
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                    F.col("m").alias("v")).distinct())
