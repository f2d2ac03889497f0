"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A per-sample join followed by a per-sample aggregate shares one exchange;
    # this lets a skewed partition still be split there.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that lie together by sample (or base) are joined by finer keys where they lie,
    # instead of being moved again by all keys.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Size estimates miss the growth of exploded rows, so nothing is broadcast on an
    # estimate: only measured shuffle sizes (or an explicit bounded hint) allow it.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # HotSpot never compiles a method above 8000 bytes; beyond that, split expressions
    # outside whole-stage code run far faster than one interpreted giant.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


#: Small samples a task holds at once, some 80,000 elements.
SAMPLES_A_TASK = 2000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings the operators rely on."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and restart its plan there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sample_parts(spark: SparkSession, samples: int) -> int:
    """Partitions of a table that lies by sample: the same number for all of one count of samples, so that none is moved to meet
    another."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-samples // SAMPLES_A_TASK))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    For an expensive table that several later steps read: it is computed once, later
    reads prune columns, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stored_for_now(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """:func:`store_once` for the time of the block, then deleted: what is made of it must be stored within the block."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def store_placed(df: DataFrame, name: str, key: str, parts: int, lies: bool = False) -> DataFrame:
    """:func:`store_once` in ``parts`` buckets by ``key``: joins and groups by it (or finer) move nothing.

    Rows whose tasks are such buckets already, which Spark doesn't know after a step in Arrow batches, are written as they ``lie``. The catalog's entry is dropped at once; files and the returned frame stay.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"meshloom_{uuid.uuid4().hex}"
    placed = df if lies else df.repartition(parts, key)
    placed.write.bucketBy(parts, key).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored
