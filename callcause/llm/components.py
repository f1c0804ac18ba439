"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callcause.llm.common import Kept


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours move to the least node among a node and its neighbours.

    Large star (upward) moves the greater neighbours, small star the smaller ones and the node itself.
    Least nodes come from an aggregate and meet the edges in a join, so no node's
    neighbours are ever gathered in one place.
    """
    if upward:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, kept: Kept) -> DataFrame:
    """For every node of the edges (u, v) that is not the least of its component: u and that least node v."""
    current = kept.keep(edges.filter("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        after = kept.keep(_star(_star(current, True), False), "edges")
        kept.drop(current)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return after
        before, current = tuple(mark), after
