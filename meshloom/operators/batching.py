"""Batches of graphs with block-diagonal node offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.uniform import shuffle_key
from meshloom.operators.ranking import ranged_rank


def assign_batches(
    samples: DataFrame,
    batch_size: int,
    epoch: int = 0,
    seed: int = 42,
    shuffled: str = "train",
    rows_a_range: int = 100_000,
    stage: bool = True,
) -> DataFrame:
    """Add position, batch_id and node_offset within each split.

    ``samples``: (split, sample_id, node_count). The ``shuffled`` split follows
    a digest of (seed, epoch, id); the others keep id order. Rows are ranked in
    ranges of about ``rows_a_range`` rows, so ids may look like anything. ``stage`` is for samples that are
    costly to compute; a stored table need not be stored again.
    """
    digest = shuffle_key(seed, "sample_id", f"epoch{epoch}")
    mixed = F.col("split") == shuffled
    order = F.when(mixed, digest).otherwise(F.col("sample_id").cast("string"))
    ranked = ranged_rank(
        samples.withColumn("_order", order),
        ["split"],
        ["_order", "sample_id"],
        rank="position",
        rows_a_range=rows_a_range,
        stage=stage,
    )
    batched = ranked.withColumn(
        "batch_id", F.floor((F.col("position") - 1) / F.lit(batch_size)).cast("bigint")
    )
    # A batch holds ``batch_size`` graphs, so this window is bounded.
    before = (
        Window.partitionBy("split", "batch_id")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return batched.withColumn(
        "node_offset", F.coalesce(F.sum("node_count").over(before), F.lit(0)).cast("bigint")
    ).drop("_order")


def batch_edges(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """Shift each graph's edges by its node offset inside the batch.

    ``edges`` endpoints must be 0-based positions within their sample.
    """
    offsets = batches.select("sample_id", "split", "batch_id", "node_offset")
    return edges.join(offsets, "sample_id").select(
        "split",
        "batch_id",
        (F.col("src") + F.col("node_offset")).alias("src"),
        (F.col("dst") + F.col("node_offset")).alias("dst"),
    )
