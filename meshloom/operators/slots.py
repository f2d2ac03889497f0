"""Numbered slots: which of them are still free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def free_slots(used: DataFrame, wanted: DataFrame, stream: str, n: str, block: int = BLOCK) -> DataFrame:
    """The first ``n`` unused slots of every stream: gaps between used slots before fresh ones.

    ``used``: (stream, slot), repeats allowed; ``wanted``: (stream, n), a row a stream. Returns
    (stream, slot). Slots are looked at in blocks: a block's used slots are one array of at
    most ``block`` values, and one row a block (not a slot) is summed along a stream. The
    first n free slots lie below n + the number of used slots, so only blocks up to there are read.
    """
    known = used.where(F.col("slot") >= 0).select(
        stream, F.floor(F.col("slot") / block).alias("_block"), F.pmod("slot", F.lit(block)).cast("int").alias("_at")
    )
    taken = known.groupBy(stream, "_block").agg(F.collect_set("_at").alias("_taken"))
    totals = taken.groupBy(stream).agg(F.sum(F.size("_taken")).alias("_used"))
    last = F.floor((F.col(n) + F.coalesce("_used", F.lit(0)) - 1) / block)
    blocks = (
        wanted.where(F.col(n) > 0)
        .join(totals, stream, "left")
        .select(stream, n, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
        .join(taken, [stream, "_block"], "left")
        .withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    )
    along = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    open_blocks = (
        blocks.withColumn("_before", F.coalesce(F.sum(F.lit(block) - F.size("_taken")).over(along), F.lit(0)))
        .where(F.col("_before") < F.col(n))
        # Blocks of one stream are spread out before they become rows.
        .repartition(stream, "_block")
    )
    free = F.array_except(F.sequence(F.lit(0), F.lit(block - 1)), F.col("_taken"))
    return (
        open_blocks.select(stream, n, "_block", "_before", F.posexplode(free).alias("_rank", "_at"))
        .where(F.col("_before") + F.col("_rank") < F.col(n))
        .select(stream, (F.col("_block") * block + F.col("_at")).cast("bigint").alias("slot"))
    )
