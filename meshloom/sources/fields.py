"""Node and element tables on parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.filters import accepted


def read_nodes(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named fields: the scan reads no other column."""
    return spark.read.parquet(path).select("sample_id", "node_id", *columns)


def graph_connectivity(elements: DataFrame, mode: str) -> DataFrame:
    """Pick ``nodes``: quadratic connectivity if asked for and present, else linear."""
    linear = F.col("nodes4")
    nodes = F.coalesce(F.col("nodes10"), linear) if mode == "tet10" else linear
    return elements.select("sample_id", "elem_id", nodes.alias("nodes"))


def read_elements(spark: SparkSession, path: str, mode: str) -> DataFrame:
    return graph_connectivity(spark.read.parquet(path), mode)


def with_fields_only(manifest: DataFrame, fields: DataFrame, key: str = "sample_id") -> DataFrame:
    """Manifest rows whose sample has stored fields."""
    return manifest.join(fields.select(key), key, "left_semi")


def write_sample_fields(fields: DataFrame, manifest: DataFrame, path: str, keys: Sequence[str] = ("sample_id",)) -> None:
    """Store the field rows of accepted variants, partitioned by scale bucket.

    ``keys`` may name what the sample belongs to besides: rows that lie together by it are not moved.
    """
    kept = accepted(manifest).select(*keys, "scale_bucket")
    fields.join(kept, list(keys)).write.mode("append").partitionBy("scale_bucket").parquet(path)
