"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_hash(df: DataFrame, seed: int, columns: Sequence[str] | None = None) -> Column:
    """A seeded 64-bit hash of a row: equal rows agree, whatever the layout of the table."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns or df.columns])


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def numbered_copies(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 among rows equal in every column.

    Copies are counted before they move, so a row that makes up a third of the table is
    one row a task in the shuffle; a hash of row and number then spreads them.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    return counted.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"`{name}`") - 1)))


#: Id lists up to this many rows may be broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def by_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined with stored ``ids``: broadcast if they are few, else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Python workers get batches of at most ``rows`` texts, so that a worker needs little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def set_aside(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], list[Column]]:
    """``df`` with its columns named c0, c1, …, so that an operator's own names can't clash with them.

    Also gives the column of an original name, and all columns under their original names.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain, lambda name: F.col(f"c{names.index(name)}"), [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], block: int = 4096) -> DataFrame:
    """Add ``<value>_before``: the sum of ``value`` over rows of a smaller integer ``order``.

    Rows are summed in blocks of ``order`` and only block totals meet in one task, so a
    table of n rows sends n / ``block`` rows there. ``order`` is unique and not null.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    totals = cut.groupBy("_block").agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_block", *[F.coalesce(F.sum(f"_total_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values]
    )
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(totals, "_block")
        .withColumns({f"{v}_before": F.col(f"_before_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
        .drop("_block", *[f"_before_{v}" for v in values])
    )
