"""Incremental manifest: ingest once, follow progress and stratum fill.

Each stage is a file-source stream with its own checkpoint that processes what is
available and stops, so it can be rerun after any interruption.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_rows(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stored_rows(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    """The ingested table with its folders ``run`` and ``batch``; empty before the first batch."""
    plain = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*plain.fields, *StructType.fromDDL("run string, batch long").fields])
    return spark.read.schema(whole).parquet(table) if run_ids(spark, table) else spark.createDataFrame([], whole)


def run_ids(spark: SparkSession, table: str) -> list[str]:
    """The runs (one a checkpoint) that have stored rows in a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return [n.removeprefix("run=") for n in names if n.startswith("run=")]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of streams started within the block lies in RocksDB, of which a batch uploads what it changed."""
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Rows that are sorted at once at least; before the shuffle a task reduces its rows in windows of about so many.
WINDOW_ROWS = 100_000


def earliest_rows(key: str, event_time: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that keeps of each key the row of the earliest time (null last) of all batches, or of each window if not
    ``whole``; rows without a key pass.

    Rows are sorted when as many have come as are kept, so each is sorted a few times, however many batches a task gets.
    The function holds all it calls: workers need not import this module.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, rows = 0, [], 0
        for batch in batches:
            own = pa.Table.from_batches([batch])
            none = pc.is_null(own[key])
            yield from own.filter(none).to_batches()
            waiting.append(own.filter(pc.invert(none)))
            rows += len(waiting[-1])
            if rows < max(WINDOW_ROWS, 2 * kept):
                continue
            first = first_rows(pa.concat_tables(waiting))
            if whole:
                kept, waiting, rows = len(first), [first], len(first)
            else:
                waiting, rows = [], 0
                yield from first.to_batches()
        if rows:
            yield from first_rows(pa.concat_tables(waiting)).to_batches()

    def first_rows(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(key, "ascending"), (event_time, "ascending")], null_placement="at_end")
        table = table.take(order)
        if len(table) < 2:
            return table
        keys = table[key].combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
        return table.filter(pa.concat_arrays([pa.array([True]), new]))

    return reduce


def earliest_of_batch(rows: DataFrame, key: str, event_time: str) -> DataFrame:
    """Of each key the row of the earliest time (null last) in a batch; rows without a key all stay.

    Keys of a task are reduced before and after the shuffle, so a key delivered very often is one row a window there.
    """
    once = rows.mapInArrow(earliest_rows(key, event_time, whole=False), rows.schema)
    return once.repartition(F.col(key)).mapInArrow(earliest_rows(key, event_time, whole=True), rows.schema)


def store_new(rows: DataFrame, table: str, checkpoint: str, key: str, event_time: str) -> None:
    """Append a stream to a parquet table, each key once: the first delivery, however late it comes.

    A key is remembered in the state of the stream, without watermark, for good; a batch reads its own rows and the state of
    their keys, nothing that was stored before, and within it the earliest row counts. A batch
    overwrites its own folder, so a retried one repeats itself. Rows without a key can't be told apart and are all kept. ``run``
    is the id of the stream: a new checkpoint on an old table starts a new run with an empty state, whose batches
    leave out the keys of the runs before.
    """
    spark = rows.sparkSession
    first = earliest_of_batch(rows, key, event_time)
    # A row without a key gets one of its own, so that the state can't take it for a repeat.
    named = first.withColumn("_none", F.when(F.col(key).isNull(), F.uuid()))
    fresh = named.dropDuplicates([key, "_none"]).drop("_none")

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if [r for r in run_ids(session, table) if r != run]:
            known = stored_rows(session, table, batch.schema).where(F.col("run") != run)
            batch = batch.join(known.select(key), key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{table}/run={run}/batch={batch_id}")

    with keyed_state(spark):
        query: StreamingQuery = (
            fresh.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def ingest_manifest(
    spark: SparkSession,
    incoming: str,
    schema: StructType | str,
    table: str,
    checkpoint: str,
    key: str = "sample_id",
    event_time: str = "ts",
    files_per_trigger: int | None = None,
) -> None:
    rows = stream_rows(spark, incoming, schema, files_per_trigger)
    store_new(rows, table, checkpoint, key, event_time)


def run_running_totals(totals: DataFrame, path: str, checkpoint: str) -> None:
    """Write the groups of a running aggregate that a batch changed.

    Each batch goes to its own folder, so a repeated batch overwrites itself.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with keyed_state(totals.sparkSession):
        query = (
            totals.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def latest_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each group the row of the last batch that changed it."""
    stored = spark.read.parquet(path)
    row = F.struct(*[c for c in stored.columns if c != "batch"])
    return stored.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row")).select("_row.*")


def progress(rows: DataFrame, event_time: str, width: str, passed: Column) -> DataFrame:
    """Done, passed and rejected counts per tumbling window, with the done rate."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return (
        rows.groupBy(F.window(event_time, width).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("done"),
            F.count_if(passed).alias("passed"),
            F.count_if(~passed).alias("rejected"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "done",
            "passed",
            "rejected",
            (F.col("done") / seconds).alias("per_second"),
        )
    )


def stratum_fill(bases: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """Running distinct bases per stratum (input already one row per base)."""
    return bases.groupBy(*keys).agg(F.count(F.lit(1)).alias("base_samples")).withColumn(
        "shortfall", F.greatest(F.lit(floor) - F.col("base_samples"), F.lit(0))
    )
