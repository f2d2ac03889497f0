"""Balance, coverage and gate reports over a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.config import BUCKETS, FAMILIES
from meshloom.operators.percentiles import percentiles_by

STRATUM = ["geometry_family", "scale_bucket"]


def _known(manifest: DataFrame, columns: Sequence[str] = STRATUM) -> DataFrame:
    for c in columns:
        manifest = manifest.where(F.col(c).isNotNull())
    return manifest


def stratum_cube(manifest: DataFrame, keys: Sequence[str] = STRATUM) -> DataFrame:
    """Row counts over every combination of ``keys`` with "All" as margin."""
    counted = _known(manifest, keys).cube(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.grouping(k).alias(f"_g_{k}") for k in keys]
    )
    return counted.select(
        *[F.when(F.col(f"_g_{k}") == 1, "All").otherwise(F.col(k)).alias(k) for k in keys], "rows"
    )


def stratum_crosstab(manifest: DataFrame, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """Family × bucket table with margins."""
    return (
        stratum_cube(manifest)
        .groupBy("geometry_family")
        .pivot("scale_bucket", [*buckets, "All"])
        .agg(F.sum("rows"))
        .na.fill(0)
    )


def base_counts(manifest: DataFrame) -> DataFrame:
    return _known(manifest).groupBy(*STRATUM).agg(
        F.count_distinct("base_sample_id").alias("base_samples")
    )


def floor_warnings(manifest: DataFrame, floor: Column | int) -> DataFrame:
    """Present strata below the floor."""
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    return base_counts(manifest).where(F.col("base_samples") < floor)


def strata_grid(spark, families=FAMILIES, buckets=BUCKETS) -> DataFrame:
    """The fixed list of strata (15 rows by default)."""
    return spark.createDataFrame(
        [(f, b) for f in families for b in buckets], "geometry_family string, scale_bucket string"
    )


def stratum_shortfalls(manifest: DataFrame, floor: Column | int) -> DataFrame:
    """Every stratum, absent ones included, with its shortfall against the floor."""
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    grid = strata_grid(manifest.sparkSession)
    counted = grid.join(base_counts(manifest), STRATUM, "left").na.fill(0, ["base_samples"])
    return counted.withColumn("shortfall", F.greatest(floor - F.col("base_samples"), F.lit(0)))


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows and distinct bases per split (a base lies in one split only)."""
    return _known(manifest, ["split"]).groupBy("split").agg(
        F.count("sample_id").alias("total_samples"),
        F.count_distinct("base_sample_id").alias("base_samples"),
    )


def split_ratios(manifest: DataFrame) -> DataFrame:
    """Achieved share of each split within a stratum, over distinct bases."""
    counts = _known(manifest, [*STRATUM, "split"]).groupBy(*STRATUM, "split").agg(
        F.count_distinct("base_sample_id").alias("base_samples")
    )
    total = counts.groupBy(*STRATUM).agg(F.sum("base_samples").alias("_n"))
    return counts.join(total, STRATUM).select(
        *STRATUM, "split", "base_samples", (F.col("base_samples") / F.col("_n")).alias("ratio")
    )


def length_distribution(manifest: DataFrame) -> DataFrame:
    length = "characteristic_length"
    moments = manifest.agg(
        F.min(length).alias("min"), F.max(length).alias("max"), F.avg(length).alias("mean"),
        F.stddev_samp(length).alias("std"),
    ).withColumn("_k", F.lit(1))
    marks = percentiles_by(manifest, [], length, {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return moments.join(marks.withColumn("_k", F.lit(1)), "_k").drop("_k")


def coverage_warnings(manifest: DataFrame, length_range: tuple[float, float]) -> DataFrame:
    """Whether the lengths stay away from either end of the configured range."""
    lo, hi = length_range
    return manifest.agg(
        F.min("characteristic_length").alias("min_length"),
        F.max("characteristic_length").alias("max_length"),
    ).select(
        "*",
        (F.col("min_length") > lo * 1.5).alias("low_end_missing"),
        (F.col("max_length") < hi * 0.7).alias("high_end_missing"),
    )


def node_count_distribution(manifest: DataFrame) -> DataFrame:
    stats = manifest.agg(
        F.min("node_count").alias("min"), F.max("node_count").alias("max"),
        F.avg("node_count").alias("mean"),
    ).withColumn("_k", F.lit(1))
    median = percentiles_by(manifest, [], "node_count", {"median": 0.5})
    return stats.join(median.withColumn("_k", F.lit(1)), "_k").drop("_k")


def gate_stats(manifest: DataFrame, *extra: str) -> DataFrame:
    keys = ["geometry_family", "linearity_gate_type", *extra]
    return _known(manifest, keys).groupBy(*keys).agg(
        F.count("sample_id").alias("total"),
        F.count_if("linearity_gate_pass").alias("passed"),
        F.count_if(~F.col("linearity_gate_pass")).alias("failed"),
    )


def gate_firings(manifest: DataFrame) -> DataFrame:
    """Which test rejected, per family, as separate counts."""
    return manifest.where(F.col("rejection_code").isNotNull()).groupBy(
        "geometry_family", "rejection_code"
    ).agg(F.count(F.lit(1)).alias("rejected"))


def bucket_health(manifest: DataFrame) -> DataFrame:
    """Coherence pass rate and solve time per scale bucket."""
    rates = manifest.groupBy("scale_bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("coherence_pass").cast("double")).alias("pass_rate"),
        F.avg("solve_time_s").alias("mean_solve_s"),
        F.max("solve_time_s").alias("max_solve_s"),
    )
    tail = percentiles_by(
        manifest, ["scale_bucket"], "solve_time_s", {"p50_solve_s": 0.5, "p95_solve_s": 0.95}
    )
    return rates.join(tail, "scale_bucket")


def diameter_report(manifest: DataFrame, hops: int) -> DataFrame:
    return _known(manifest).groupBy(*STRATUM).agg(
        F.max("graph_diameter").alias("max_diameter"),
        F.avg("graph_diameter").alias("mean_diameter"),
        F.count_if(F.col("graph_diameter") > hops).alias("beyond_receptive_field"),
    )


def run_summary(
    manifest: DataFrame, planned: DataFrame, zero_rejected: DataFrame, min_multihot: int
) -> DataFrame:
    """One row of run counters; sample-level flags are counted once per base.

    A planned base that is neither in the manifest nor rejected for a zero field failed.
    """
    lost = planned.select("base_sample_id").join(
        manifest.select("base_sample_id"), "base_sample_id", "left_anti"
    )
    dropped = zero_rejected.select(F.count(F.lit(1))).scalar()
    missing = lost.select(F.count(F.lit(1))).scalar()
    bases = manifest.groupBy("base_sample_id").agg(
        F.bool_or("has_multihot_nodes").alias("multihot"),
        F.count(F.lit(1)).alias("variants"),
        F.count_if("coherence_pass").alias("coherent"),
        F.count_if("linearity_gate_pass").alias("accepted"),
    )
    return bases.agg(
        F.count(F.lit(1)).alias("success"),
        (missing - dropped).alias("failed"),
        dropped.alias("zero_rejected"),
        F.sum("variants").alias("variants"),
        F.sum("accepted").alias("accepted"),
        F.sum("coherent").alias("coherence_pass"),
        F.count_if("multihot").alias("multihot"),
        (F.count_if("multihot") < min_multihot).alias("multihot_warning"),
    )


def global_attributes(nodes: DataFrame) -> DataFrame:
    """Total load as vector sum and as sum of norms, pinned and total node counts."""
    f = [F.col(c) for c in ("fx", "fy", "fz")]
    norm = F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2])
    sums = [F.sum(c) for c in f]
    return nodes.groupBy("sample_id").agg(
        F.sqrt(sums[0] * sums[0] + sums[1] * sums[1] + sums[2] * sums[2]).alias("total_load_vector"),
        F.sum(norm).alias("total_load_l2"),
        F.count_if("is_fixed").alias("pinned_node_count"),
        F.count(F.lit(1)).alias("total_node_count"),
    )


def slice_profile(nodes: DataFrame, slices: int, nominal: str) -> DataFrame:
    """Stress percentiles and concentration (peak/nominal) per through-thickness slice.

    ``nominal`` is a column constant within a sample.
    """
    box = nodes.groupBy("sample_id").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    depth = (F.col("z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    index = F.least(F.floor(depth * slices), F.lit(slices - 1)).cast("int")
    sliced = nodes.join(box, "sample_id").withColumn(
        "z_slice", F.when(F.col("_hi") > F.col("_lo"), index).otherwise(0)
    )
    keys = ["sample_id", "z_slice"]
    peak = sliced.groupBy(*keys).agg(
        F.max("von_mises").alias("peak"), F.max(nominal).alias("_nom")
    )
    marks = percentiles_by(sliced, keys, "von_mises", {"p90": 0.9, "p95": 0.95, "p99": 0.99})
    return peak.join(marks, keys).select(
        *keys, "peak", "p90", "p95", "p99",
        F.when(F.col("_nom") > 0, F.col("peak") / F.col("_nom")).alias("kt"),
    )


def reaction_balance(nodes: DataFrame, tolerance: float) -> DataFrame:
    """Per sample: is the sum of reactions and loads negligible against the load?"""
    gaps, sizes = [], []
    for c in ("x", "y", "z"):
        total = F.sum(F.col(f"f{c}") + F.col(f"r{c}"))
        gaps.append(total * total)
        sizes.append(F.sum(F.col(f"f{c}")) * F.sum(F.col(f"f{c}")))
    gap, size = F.sqrt(gaps[0] + gaps[1] + gaps[2]), F.sqrt(sizes[0] + sizes[1] + sizes[2])
    return nodes.groupBy("sample_id").agg(
        gap.alias("residual"), size.alias("load")
    ).withColumn("balanced", F.col("residual") <= F.lit(tolerance) * F.greatest("load", F.lit(1e-30)))


def zero_radius(manifest: DataFrame) -> DataFrame:
    """Bracket rows whose notch root has no radius (must be empty)."""
    return manifest.where(
        (F.col("geometry_family") == "l_bracket")
        & (F.coalesce("fillet_radius", F.lit(0.0)) <= 0)
    )


def held_out_in_train(manifest: DataFrame, holdout: tuple[float, float]) -> DataFrame:
    """Bracket rows of the held-out r/d range that ended up in train (must be empty)."""
    return manifest.where(
        (F.col("geometry_family") == "l_bracket")
        & F.col("radius_ratio").between(*holdout)
        & (F.col("split") == "train")
    )
