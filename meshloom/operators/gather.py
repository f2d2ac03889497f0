"""Element ↔ node movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def element_nodes(elements: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element node: (sample_id, elem_id, local, node_id, keep…)."""
    return elements.select(
        "sample_id", "elem_id", *keep, F.posexplode("nodes").alias("local", "node_id")
    )


def gather_points(
    elements: DataFrame, nodes: DataFrame, values: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Attach node values to each element as ``points``: structs in local order.

    Joined on (sample, node) and regrouped on (sample, element): both keys are fine
    enough that a single giant mesh is spread out, and a group holds one
    element (at most ten nodes). Tables that are partitioned by sample are joined and
    grouped where they lie: nothing is moved.
    """
    wanted = nodes.select("sample_id", "node_id", *values)
    return (
        element_nodes(elements, keep)
        .join(wanted, ["sample_id", "node_id"])
        .groupBy("sample_id", "elem_id", *keep)
        .agg(F.array_sort(F.collect_list(F.struct("local", *values))).alias("points"))
    )


def element_to_node(
    elements: DataFrame, nodes: DataFrame, values: Sequence[str], volume: str = "volume"
) -> DataFrame:
    """Volume-weighted average of element values on their nodes; 0 where untouched."""
    weighted = element_nodes(elements, [*values, volume])
    sums = weighted.groupBy("sample_id", "node_id").agg(
        F.sum(volume).alias("_w"),
        *[F.sum(F.col(v) * F.col(volume)).alias(f"_{v}") for v in values],
    )
    weight = F.greatest("_w", F.lit(1e-30))
    return nodes.join(sums, ["sample_id", "node_id"], "left").select(
        *nodes.columns,
        *[F.coalesce(F.col(f"_{v}") / weight, F.lit(0.0)).alias(v) for v in values],
    )
