"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash into buckets small enough for memory. Pass two
shuffles each bucket (Spark's ``shuffle`` is an inside-out Fisher-Yates) and lays the
buckets end to end; shard ``s`` holds an equal run of the resulting positions, so shards
differ by one row at most.

Every record takes part, with nulls, empty texts and repeats: equal rows are separate
records. Only rows equal in every column share a hash, so no hot key can fill a bucket
unless whole rows repeat. An empty table gives no rows. Column names are kept; those that
the operator adds (``shard``, ``slot``) replace columns of these names. Columns must be
orderable (no maps): a bucket is sorted before it is shuffled, and bucket b is partition b, whose number
the draws of ``shuffle`` depend on. So a retried task, a rerun and a table in another layout find the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import prefix_sums, row_hash, table, text_of

LAW = "rows"


def record_bytes(df: DataFrame):
    """Estimated bytes of a record: its strings and binaries, and 16 for each other column."""
    wide = {"string", "binary"}
    return sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if kind in wide else F.lit(16) for c, kind in df.dtypes),
        F.lit(32),
    ).cast("long")


def shuffle_into_shards(
    df: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) in a seeded random order."""
    df = df.drop("shard", "slot")
    totals = df.select(record_bytes(df).alias("b")).agg(F.sum("b"), F.count(F.lit(1))).first()
    total, rows = totals[0] or 0, totals[1]
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = df.select(
        F.pmod(row_hash(df, seed), F.lit(buckets)).cast("int").alias("_bucket"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_record"),
    )
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = prefix_sums(counts, "_bucket", ["n"]).select("_bucket", "n_before")
    # A bucket's offset travels as one more row of the bucket, so that its records move once.
    moved = scattered.unionByName(offsets, allowMissingColumns=True)
    position = F.col("n_before") + F.col("_at")
    shard = F.expr(f"(_position * {shards}) div {max(rows, 1)}")
    return (
        moved.repartitionById(buckets, F.col("_bucket"))
        .groupBy("_bucket")
        .agg(F.array_sort(F.collect_list("_record")).alias("_records"), F.max("n_before").alias("n_before"))
        .select("n_before", F.posexplode(F.shuffle("_records", seed)).alias("_at", "_record"))
        .withColumn("_position", position)
        .withColumn("shard", shard.cast("int"))
        .select(
            *[F.col(f"_record.c{i}").alias(c) for i, c in enumerate(df.columns)],
            "shard",
            F.expr(f"_position - (cast(shard as bigint) * {rows} + {shards - 1}) div {shards}").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; a bucket holds neighbouring positions, so it writes to few shards."""
    sharded.write.partitionBy("shard").parquet(path)


def op8_external_shuffle(spark, sf_dir):
    sharded = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
