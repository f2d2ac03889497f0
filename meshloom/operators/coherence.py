"""Coherence: stress recomputed from displacement against the solver's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.config import Material
from meshloom.functions.stress import hooke, von_mises
from meshloom.operators.strain import STRAINS, tet4_strains, tet10_strains

TINY = 1e-10


def checked_width(elements: DataFrame, width: int) -> DataFrame:
    """Fail on elements that are neither linear nor quadratic tetrahedra."""
    if width not in (4, 10):
        raise ValueError(f"elements need 4 or 10 nodes, not {width}")
    wrong = F.raise_error(F.concat(F.lit("unsupported element width "), F.size("nodes")))
    return elements.withColumn(
        "nodes", F.when(F.size("nodes") == width, F.col("nodes")).otherwise(wrong)
    )


def recomputed_von_mises(
    elements: DataFrame, nodes: DataFrame, width: int, material: Material, keep: Sequence[str] = ()
) -> DataFrame:
    """(sample_id, elem_id, keep…, volume, vm) from displacement through strain and Hooke's law."""
    strains = tet10_strains if width == 10 else tet4_strains
    solved = strains(checked_width(elements, width), nodes, keep)
    stress = hooke([F.col(e) for e in STRAINS], material)
    return solved.select("sample_id", "elem_id", *keep, "volume", von_mises(stress).alias("vm"))


def by_element(recomputed: DataFrame, solver: DataFrame, tolerance: float) -> DataFrame:
    """Element against element; ``solver`` carries (sample_id, elem_id, solver_vm)."""
    pairs = recomputed.join(solver, ["sample_id", "elem_id"])
    return by_element_pairs(pairs, tolerance)


def by_element_pairs(pairs: DataFrame, tolerance: float) -> DataFrame:
    """As :func:`by_element` for rows that already carry both ``vm`` and ``solver_vm``."""
    diff = F.abs(F.col("vm") - F.col("solver_vm"))
    share = diff / F.greatest("solver_vm", F.lit(TINY))
    sums = pairs.groupBy("sample_id").agg(
        F.sqrt(F.sum(diff * diff)).alias("_diff"),
        F.sqrt(F.sum(F.col("solver_vm") * F.col("solver_vm"))).alias("_norm"),
        F.max(share).alias("_max"),
        F.avg(share).alias("_mean"),
    )
    silent = F.col("_norm") < TINY

    def unless_silent(value: Column) -> Column:
        return F.when(silent, 0.0).otherwise(value)

    error = unless_silent(F.col("_diff") / F.col("_norm"))
    return sums.select(
        "sample_id",
        (error <= tolerance).alias("coherence_pass"),
        error.alias("coherence_error"),
        unless_silent(F.col("_max")).alias("max_element_error"),
        unless_silent(F.col("_mean")).alias("mean_element_error"),
    )


def by_nodal_mean(recomputed: DataFrame, nodal: DataFrame, tolerance: float) -> DataFrame:
    """Mean recomputed element value against the mean nodal one (``solver_vm``)."""
    element = recomputed.groupBy("sample_id").agg(F.avg("vm").alias("_mine"))
    node = nodal.groupBy("sample_id").agg(
        F.avg("solver_vm").alias("_theirs"),
        F.sqrt(F.sum(F.col("solver_vm") * F.col("solver_vm"))).alias("_norm"),
    )
    gap = F.abs(F.col("_mine") - F.col("_theirs")) / F.greatest("_theirs", F.lit(TINY))
    error = F.when(F.col("_norm") < TINY, 0.0).otherwise(gap)
    return element.join(node, "sample_id").select(
        "sample_id",
        (error <= tolerance).alias("coherence_pass"),
        error.alias("coherence_error"),
        error.alias("max_element_error"),
        error.alias("mean_element_error"),
    )
