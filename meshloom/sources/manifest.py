"""Manifest storage: explicit schema, parquet or CSV, append and tolerant reads."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _REAL, _WHOLE, _FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

# The manifest contract, in storage order.
_COLUMNS = {
    "base_sample_id": _TEXT,
    "sample_id": _TEXT,
    "geometry_family": _TEXT,
    "characteristic_length": _REAL,
    "scale_bucket": _TEXT,
    "mesh_size": _REAL,
    "fixed_face": _TEXT,
    "load_face": _TEXT,
    "load_dir_x": _REAL,
    "load_dir_y": _REAL,
    "load_dir_z": _REAL,
    "governing_thickness": _REAL,
    "radius_ratio": _REAL,
    "fillet_radius": _REAL,
    "target_safety_factor": _REAL,
    "scale_factor": _REAL,
    "node_count": _WHOLE,
    "element_count": _WHOLE,
    "graph_diameter": _WHOLE,
    "peak_von_mises": _REAL,
    "p95_von_mises": _REAL,
    "max_displacement": _REAL,
    "coherence_pass": _FLAG,
    "coherence_error": _REAL,
    "linearity_gate_pass": _FLAG,
    "linearity_gate_type": _TEXT,
    "rejection_reason": _TEXT,
    "solve_time_s": _REAL,
    "has_multihot_nodes": _FLAG,
    "has_tet10": _FLAG,
    "split": _TEXT,
}
MANIFEST_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _COLUMNS.items()])


def conform(rows: DataFrame) -> DataFrame:
    """Cast to the contract; missing columns become null."""
    return rows.select(
        *[
            (F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n)
            for n, t in _COLUMNS.items()
        ]
    )


BAD = "_bad_row"


def _csv_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a CSV manifest by their header line: a few texts, as families differ in columns."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # The start of a file is read by one task, which numbers its lines in order.
    starts = lines.where("file_block_start = 0").withColumn("line", F.monotonically_increasing_id())
    first = starts.groupBy("file_path").agg(F.min_by("value", "line").alias("header"))
    grouped = first.groupBy("header").agg(F.collect_list("file_path").alias("files"))
    return {row["header"]: row["files"] for row in grouped.collect()}


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV manifest by column name, as text, with the line of those that don't fit in ``_bad_row``."""
    parts = []
    for files in _csv_headers(spark, path).values():
        names = spark.read.csv(files[0], header=True).columns
        if not set(names) & set(_COLUMNS):  # no header of a manifest: every line is a bad one
            lines = spark.read.text(files).select(F.col("value").alias(BAD))
            parts.append(lines.select(BAD, *[F.lit(None).cast(_TEXT).alias(n) for n in _COLUMNS]))
            continue
        schema = T.StructType([T.StructField(n, _TEXT) for n in [*names, BAD]])
        # Without all columns the parser can't see that a line is short.
        reader = spark.read.schema(schema).option("columnPruning", False)
        read = reader.csv(files, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
        parts.append(read.select(BAD, *[F.col(f"`{n}`") if n in names else F.lit(None).cast(_TEXT).alias(n) for n in _COLUMNS]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(n, _TEXT) for n in [BAD, *_COLUMNS]]))
    return reduce(DataFrame.unionByName, parts)


def _misfit() -> Column:
    """Rows that don't parse: a broken line, no sample id, or a value that isn't of its column's type."""
    wrong = [F.col(n).isNotNull() & F.col(n).try_cast(t).isNull() for n, t in _COLUMNS.items() if t != _TEXT]
    return reduce(Column.__or__, wrong, F.col(BAD).isNotNull() | F.col("sample_id").isNull())


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of a manifest. CSV files are read by the names in their header, whatever their order;
    missing columns are null. Lines that don't parse are left to ``bad_rows``.
    """
    if fmt == "csv":
        good = _csv_rows(spark, path).where(~_misfit())
        return good.select(*[F.col(n).cast(t) for n, t in _COLUMNS.items()])
    return spark.read.schema(MANIFEST_SCHEMA).format(fmt).load(path)


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a CSV manifest that ``read_manifest`` leaves out; count them before trusting it."""
    whole = F.concat_ws(",", *[F.col(n) for n in _COLUMNS])
    return _csv_rows(spark, path).where(_misfit()).select(F.coalesce(BAD, whole).alias("line"))


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a Parquet manifest that can't be read, or hold no row."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    readable = (
        spark.read.schema(MANIFEST_SCHEMA).option("ignoreCorruptFiles", True).parquet(path)
        .select(F.col("_metadata.file_path").alias("path")).distinct()
    )
    return files.join(readable, "path", "left_anti")


def read_manifest_or_empty(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An absent path is an empty manifest. A damaged Parquet file is passed over: see ``damaged_files``."""
    try:
        if fmt == "csv":
            return read_manifest(spark, path, fmt)
        return spark.read.schema(MANIFEST_SCHEMA).option("ignoreCorruptFiles", True).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def read_manifests(spark: SparkSession, paths: Iterable[str], fmt: str = "parquet") -> DataFrame:
    parts = [read_manifest_or_empty(spark, p, fmt) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def append_manifest(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append variants, rejected ones included."""
    writer = conform(rows).write.mode("append")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)
