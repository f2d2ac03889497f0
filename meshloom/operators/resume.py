"""Completed ids and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_ids(manifest: DataFrame) -> DataFrame:
    """Distinct base ids; falls back to sample ids, then to nothing."""
    for name in ("base_sample_id", "sample_id"):
        if name in manifest.columns:
            return manifest.select(F.col(name).alias("base_sample_id")).distinct()
    return manifest.sparkSession.createDataFrame([], "base_sample_id string")


def completed_count(manifest: DataFrame) -> DataFrame:
    return completed_ids(manifest).agg(F.count(F.lit(1)).alias("completed"))


def remaining(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned bases that are not completed."""
    return plan.join(completed.select("base_sample_id"), "base_sample_id", "left_anti")
