"""Connected components by alternating large and small stars, one stored table a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.session import store_once


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node (the larger ones, or the smaller ones and itself) to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    # Least neighbours are combined before the shuffle, so a node with many links is no hot group.
    least = both.groupBy("u").agg(F.min("v").alias("_least")).withColumn("m", F.least("u", "_least")).drop("_least")
    met = both.join(least, "u")
    if large:
        linked = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the least node of its component, for every node that isn't the least itself.

    ``edges`` has columns u and v; loops and repeats do no harm. Ends when a pass changes nothing.
    """
    now = store_once(edges.filter("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        now = store_once(_star(now, large=True), "stars")
        now = store_once(_star(now, large=False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now
        before = state
