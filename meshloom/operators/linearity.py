"""Spot-check of linear scaling against independent solves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.stress import norm3
from meshloom.functions.uniform import shuffle_key
from meshloom.operators.ranking import shuffle_rank

FLOOR = 1e-30


def verification_sample(manifest: DataFrame, rate: float, seed: int) -> DataFrame:
    """A seeded fraction (at least one) of the distinct bases."""
    bases = manifest.select("base_sample_id").distinct().withColumn(
        "_digest", shuffle_key(seed, "base_sample_id", "verify")
    )
    ranked = shuffle_rank(bases, [], "_digest", "base_sample_id", rank="_rank", total="_n")
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rate)))
    return ranked.where(F.col("_rank") <= wanted).select("base_sample_id")


def pair_fields(scaled: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line up both solves node by node: scaled_* and resolved_* columns, null where a solve lacks the node."""
    values = ("ux", "uy", "uz", "von_mises")
    left = scaled.select(*keys, *[F.col(v).alias(f"scaled_{v}") for v in values])
    right = resolved.select(*keys, *[F.col(v).alias(f"resolved_{v}") for v in values])
    return left.join(right, list(keys), "full")


def compare(pairs: DataFrame, keys: Sequence[str], tolerance: float, node: str = "node_id") -> DataFrame:
    """Largest relative error of ‖u‖ and of von Mises per ``keys``, the worst node of each and the nodes that lack a value.

    A node that one of the solves lacks, or has without a value, is a failure. The worst of equals is the
    smallest ``node``.
    """
    mine, theirs = (
        norm3(*[F.col(f"{side}_{c}") for c in ("ux", "uy", "uz")]) for side in ("scaled", "resolved")
    )
    vm, ref = F.col("scaled_von_mises"), F.col("resolved_von_mises")
    by_displacement = F.abs(mine - theirs) / F.greatest(theirs, F.lit(FLOOR))
    by_stress = F.abs(vm - ref) / F.greatest(ref, F.lit(FLOOR))

    def worst(error):
        return F.max(F.when(error.isNotNull(), F.struct(error.alias("error"), (-F.col(node)).alias("node"))))

    found = pairs.groupBy(*keys).agg(
        worst(by_displacement).alias("_u"),
        worst(by_stress).alias("_s"),
        F.count_if(by_displacement.isNull() | by_stress.isNull()).alias("missing_nodes"),
    )
    return found.select(
        *keys,
        F.col("_u.error").alias("max_displacement_error"),
        F.col("_s.error").alias("max_von_mises_error"),
        (-F.col("_u.node")).alias("worst_displacement_node"),
        (-F.col("_s.node")).alias("worst_von_mises_node"),
        "missing_nodes",
    ).withColumn(
        "passed",
        F.coalesce(
            (F.col("max_displacement_error") <= tolerance)
            & (F.col("max_von_mises_error") <= tolerance)
            & (F.col("missing_nodes") == 0),
            F.lit(False),
        ),
    )


def report(results: DataFrame, max_failure_rate: float) -> DataFrame:
    """Per family and in total (family null): counts, rate, worst errors, blocking."""
    tallied = results.rollup("geometry_family").agg(
        F.grouping("geometry_family").alias("is_total"),
        F.count(F.lit(1)).alias("checked"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.max("max_displacement_error").alias("worst_displacement_error"),
        F.max("max_von_mises_error").alias("worst_von_mises_error"),
    )
    rate = F.when(F.col("checked") > 0, F.col("failed") / F.col("checked")).otherwise(0.0)
    return tallied.withColumn("failure_rate", rate).withColumn(
        "blocking", (F.col("is_total") == 0) & (F.col("failure_rate") > max_failure_rate)
    )


def verdict(family_report: DataFrame) -> DataFrame:
    """One row: totals and whether no family blocks."""
    totals = F.col("is_total") == 1
    return family_report.agg(
        F.coalesce(F.max(F.when(totals, F.col("checked"))), F.lit(0)).alias("total_checked"),
        F.coalesce(F.max(F.when(totals, F.col("passed"))), F.lit(0)).alias("total_passed"),
        F.coalesce(F.max(F.when(totals, F.col("failed"))), F.lit(0)).alias("total_failed"),
        F.count_if("blocking").alias("blocking_families"),
        (F.count_if("blocking") == 0).alias("all_passed"),
    )


def flagged_strata(results: DataFrame) -> DataFrame:
    """Strata with at least one failed spot-check, for manual review."""
    return (
        results.where(~F.col("passed"))
        .groupBy("geometry_family", "scale_bucket")
        .agg(F.count(F.lit(1)).alias("failed_checks"))
    )


def flag_bases(bases: DataFrame, results: DataFrame) -> DataFrame:
    """All bases of a flagged stratum."""
    return bases.join(flagged_strata(results), ["geometry_family", "scale_bucket"], "left_semi")


def cross_reference(results: DataFrame, variants: DataFrame) -> DataFrame:
    """Bases that failed the spot-check, a gate, or both."""
    spot = results.where(~F.col("passed")).select("base_sample_id", F.lit(True).alias("spot")).distinct()
    gates = variants.where(~F.col("linearity_gate_pass")).groupBy("base_sample_id").agg(
        F.count(F.lit(1)).alias("gate_failures")
    )
    return spot.join(gates, "base_sample_id", "full").select(
        "base_sample_id",
        F.coalesce("spot", F.lit(False)).alias("spot_check_failed"),
        F.coalesce("gate_failures", F.lit(0)).alias("gate_failures"),
    )
