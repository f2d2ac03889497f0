"""Steps that take whole samples at a time, in Arrow batches, where the samples lie.

The rows of a step come from several tables with the same columns (null where a table lacks one). Samples are never split, so a step
applies only where every sample is small; others take the joins of :mod:`topology`, :mod:`strain` and :mod:`hops`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.session import sample_parts

#: Rows that a step holds at once, or those of one sample: larger samples aren't taken whole.
SWEPT_ROWS = 50_000
#: Rows of a task, which sorts them by sample.
ROWS_A_TASK = 1_000_000
#: Rows of a batch that a step returns.
BATCH_ROWS = 100_000


def whole_parts(rows: DataFrame, sizes: DataFrame | None = None) -> int:
    """Partitions by sample for ``rows`` (with ``sizes``: and for ``n`` other rows a sample), or 0 if a sample is too large to be taken
    whole."""
    counts = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    if sizes is not None:
        counts = counts.unionByName(sizes).groupBy("sample_id").agg(F.sum("n").alias("n"))
    samples, total, largest = counts.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if not samples or largest > SWEPT_ROWS:
        return 0
    return max(sample_parts(rows.sparkSession, samples), -(-total // ROWS_A_TASK))


def stacked(*tables: DataFrame) -> DataFrame:
    """The rows of all ``tables``, whose samples and other keys are known; they stay where they lie."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.where("sample_id is not null")


def are_long(*values: tuple[DataFrame, str]) -> bool:
    """Whether all these columns hold longs or arrays of them, as steps take them."""
    return all(df.schema[c].dataType.simpleString() in ("bigint", "array<bigint>") for df, c in values)


def by_sample(rows: DataFrame, parts: int, step: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` over tables of whole samples. A task's samples stay in it, though Spark no longer knows."""
    whole, size = whole_samples(SWEPT_ROWS), BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for samples in whole(batches):
            yield from step(samples.combine_chunks()).to_batches(max_chunksize=size)

    return rows.repartition(parts, "sample_id").sortWithinPartitions("sample_id").mapInArrow(run, schema)


def whole_samples(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    """A function that cuts rows in order of samples between samples, ``least`` rows at a time or more. It holds all it calls, as all
    steps do: workers need not import this module."""

    def cut_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < least:
                continue
            table = pa.concat_tables(waiting)
            cut = pc.index(table["sample_id"], table["sample_id"][-1]).as_py()  # more rows of the last sample may come
            if cut:
                yield table.slice(0, cut)
            waiting, rows = [table.slice(cut)], rows - cut
        if rows:
            yield pa.concat_tables(waiting)

    return cut_between


def mesh_places(width: int | None) -> Callable[[pa.Table], tuple]:
    """A function that numbers the nodes of a table of whole samples, from its columns sample_id, node_id and nodes (of elements; null in
    a node's row).

    It gives the samples; a row's number of its sample; which rows are nodes'; their places; a matrix of the first ``width`` places of
    each element (all if None), -1 where it has none; of each place its sample's number and its node.
    """

    def numbered(table: pa.Table) -> tuple:
        sample = table["sample_id"].combine_chunks().dictionary_encode()
        code = sample.indices.to_numpy().astype(np.int64)
        own = table["nodes"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        lists = table["nodes"].combine_chunks().filter(pa.array(~own))
        flat = lists.flatten()
        ids = pa.concat_arrays([table["node_id"].combine_chunks().filter(pa.array(own)), flat]).dictionary_encode()
        count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        known = ids.indices.is_valid().to_numpy(zero_copy_only=False)
        names = ids.dictionary.to_numpy()
        keys = np.concatenate([code[own], np.repeat(code[~own], count)]) * max(len(names), 1)
        keys += ids.indices.fill_null(0).to_numpy()
        seen = pa.array(keys[known]).dictionary_encode()
        place = np.full(len(keys), -1)
        place[known] = seen.indices.to_numpy()
        first, target = place[: own.sum()], place[own.sum() :]
        most = count.max(initial=0) if width is None else width
        if (count == most).all():
            matrix = target.reshape(-1, most)
        else:
            spot = np.arange(most)
            at = (np.cumsum(count) - count)[:, None] + spot
            held = np.append(target, -1)[np.minimum(at, len(target))]
            matrix = np.where(spot < count[:, None], held, -1)
        nodes = seen.dictionary.to_numpy()
        return sample, code, own, first, matrix, nodes // max(len(names), 1), names[nodes % max(len(names), 1)]

    return numbered


def placed_edges() -> Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the distinct edges of elements' places in both directions, ``count`` places in all, in order of their
    first end; a self-loop comes once.

    A place that an element lacks (-1) gives the other end a self-loop, as ``least`` and ``greatest`` of nulls do.
    """

    def edges(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(matrix.shape[1], 1)
        a, b = matrix[:, i].ravel(), matrix[:, j].ravel()
        if (matrix < 0).any():
            a, b = np.where(a < 0, b, a), np.where(b < 0, a, b)
            a, b = a[a >= 0], b[a >= 0]
        half = count.bit_length()
        keys = distinct(np.minimum(a, b) << half | np.maximum(a, b))
        low = (1 << half) - 1
        keys = distinct(np.append(keys, (keys & low) << half | keys >> half))
        return keys >> half, keys & low

    def distinct(keys: np.ndarray) -> np.ndarray:
        keys.sort()
        return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]

    return edges


def rows_of_places() -> Callable[..., tuple]:
    """A function that joins places to the nodes' rows that hold them (``first``, ``count`` places in all): of each match its number in
    ``wanted`` and a row for each of ``wanted``. A node of several rows gives all their combinations."""

    def met(first: np.ndarray, count: int, *wanted: np.ndarray) -> tuple:
        times = np.bincount(first, minlength=count)
        order = np.argsort(first, kind="stable")
        begin = np.cumsum(times) - times
        at, rows = np.arange(len(wanted[0])), []
        for places in wanted:
            n = times[places[at]]
            if (n != 1).any():
                again = np.repeat(np.arange(len(at)), n)
                at, rows = at[again], [r[again] for r in rows]
                shift = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            else:
                shift = 0
            rows.append(order[begin[places[at]] + shift])
        return at, *rows

    return met
