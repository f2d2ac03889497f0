"""Exact ranks and running offsets without pulling a group into one task.

A window partitioned by a coarse key (a stratum, a split, nothing at all) sorts
a whole group in one task. Here rows are first cut into small ordered bins; only
the bin counts are accumulated per group, and rows are ranked inside their bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.session import store_once


def binned_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bin_of: Column,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` by ``order``.

    ``bin_of`` must be non-decreasing along ``order`` so that all rows of a lower
    bin precede those of a higher one. ``total`` optionally names a column
    for the size of the group. Key columns must not be null.
    """
    keys = list(keys)
    binned = df.withColumn("_bin", bin_of)
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bin from here on, never one per input row.
    bins = Window.partitionBy(*keys)
    before = bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(bins).alias(total)] if total else []),
    )
    within = Window.partitionBy(*keys, "_bin").orderBy(*order)
    return (
        binned.join(offsets, [*keys, "_bin"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(within))
        .drop("_bin", "_offset")
    )


def shuffle_rank(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    tie: str,
    rank: str = "rank",
    total: str | None = None,
    bin_digits: int = 3,
) -> DataFrame:
    """Rank by a hex digest column: its leading digits are evenly filled bins.

    ``bin_digits`` hex digits give 16**bin_digits bins per group.
    """
    return binned_rank(
        df,
        keys,
        [F.col(digest), F.col(tie)],
        F.substring(digest, 1, bin_digits),
        rank,
        total,
    )


def cut_in_ranges(
    df: DataFrame, order: Sequence[str], rows_a_range: int = 100_000, most: int = 4096, name: str = "_range", stage: bool = True
) -> DataFrame:
    """``df`` stored with the number of its range along ``order``: ranges ascend and hold about equally many rows.

    The bounds come from Spark's sample of the order's values, so ranges follow counts whatever the
    values look like; with at most ``most`` ranges the sample on the driver stays small. Ranges
    are numbered where rows are written, so every later step sees the same ones. Only rows
    equal in all of ``order`` can't be parted. ``df`` is read three times, so it is stored first unless ``stage`` is off.
    """
    staged = store_once(df, "to-rank") if stage else df
    ranges = max(1, min(most, -(-staged.count() // rows_a_range)))
    placed = staged.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id())
    return store_once(placed, "ranges")


def ranged_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
    total: str | None = None,
    rows_a_range: int = 100_000,
    stage: bool = True,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` by ``order``, whatever the values' distribution.

    For orders that no cheap expression cuts evenly; ``binned_rank`` needs no stored table
    where one does. Key columns must not be null. Nulls in ``order`` come first.
    """
    cut = cut_in_ranges(df, [*keys, *order], rows_a_range, stage=stage)
    ranked = binned_rank(cut, keys, [F.col(c) for c in order], F.col("_range"), rank, total)
    return ranked.drop("_range")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (a top-k: each task keeps at most ``n``)."""
    return df.orderBy(*order).limit(n)
