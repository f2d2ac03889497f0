"""Normalisation statistics as a one-row JSON table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.normalize import TARGETS

STATS_COLUMNS = [f"{kind}_{t}" for t in TARGETS for kind in ("mean", "std")]


def save_stats(stats: DataFrame, path: str) -> None:
    stats.select(*STATS_COLUMNS).coalesce(1).write.mode("overwrite").json(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Vector statistics come back as float32, the scalar ones as double."""
    schema = ", ".join(f"{c} double" for c in STATS_COLUMNS)
    stored = spark.read.schema(schema).json(path)
    return stored.select(
        *[F.col(c) if c.endswith("von_mises") else F.col(c).cast("float").alias(c) for c in STATS_COLUMNS]
    )


def cached_stats(
    spark: SparkSession, given: DataFrame | None, path: str | None, compute: Callable[[], DataFrame]
) -> DataFrame:
    """Given statistics win, then stored ones, else compute and store."""
    if given is not None:
        return given
    if path is None:
        return compute()
    try:
        return load_stats(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    save_stats(compute(), path)
    return load_stats(spark, path)
