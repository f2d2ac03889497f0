"""Load variants of a linear solve and their acceptance gates.

Every field of a variant is the reference field times one factor, so peak, P95 and
largest displacement are aggregated once per base and multiplied, never
recomputed per variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.config import LinearityGate, LoadScaling, Material
from meshloom.functions.encode import fixed, load_class, one_decimal, variant_id
from meshloom.functions.stress import norm3
from meshloom.operators.percentiles import percentiles_by


def field_summary(
    fields: DataFrame, key: str, percentile: float, vm: str = "von_mises"
) -> DataFrame:
    """Per base: peak and P95 von Mises, the scaling percentile, largest displacement."""
    extremes = fields.groupBy(key).agg(
        F.max(vm).alias("ref_peak"),
        F.max(norm3(F.col("ux"), F.col("uy"), F.col("uz"))).alias("ref_max_disp"),
        F.count(F.lit(1)).alias("node_count"),
    )
    tails = percentiles_by(fields, [key], vm, {"ref_p95": 0.95, "ref_scale": percentile})
    return extremes.join(tails, key)


def nonzero_fields(bases: DataFrame, threshold: float) -> DataFrame:
    return bases.where(F.col("ref_scale") >= threshold)


def zero_fields(bases: DataFrame, threshold: float) -> DataFrame:
    """Bases dropped for a vanishing reference field, kept as a side table."""
    return bases.where(F.col("ref_scale") < threshold)


def with_safety_factors(bases: DataFrame, factors: Sequence[float]) -> DataFrame:
    """Each base once per target, by exploding a constant list (no cross join)."""
    targets = F.array(*[F.lit(float(f)) for f in factors])
    return bases.withColumn("target_safety_factor", F.explode(targets))


def scale_factor(sigma_yield: float, target: Column, reference: Column) -> Column:
    return F.when(reference < 1e-10, 0.0).otherwise(F.lit(sigma_yield) / target / reference)


def gate(
    variants: DataFrame, cap: float, rules: LinearityGate
) -> DataFrame:
    """Add gate type, rejection code and reason; the first failing test decides."""
    family = F.col("geometry_family")
    bending = F.coalesce(family.isin(*rules.bending_families), F.lit(False))
    bulk = F.coalesce(family.isin(*rules.bulk_families), F.lit(False))
    length, thickness = F.col("characteristic_length"), F.col("governing_thickness")
    disp, peak = F.col("max_displacement"), F.col("peak_von_mises")
    has_thickness = bending & thickness.isNotNull() & (thickness > 0)
    by_length = F.when(length > 0, disp / length).otherwise(0.0)
    by_thickness = F.when(has_thickness, disp / thickness)
    limit = F.when(bending, rules.bending_length_threshold).otherwise(rules.bulk_threshold)
    code = (
        F.when(peak > cap, "peak_cap")
        .when(by_length > limit, "delta_l")
        .when(by_thickness > rules.bending_thickness_threshold, "delta_t")
    )
    gated = variants.withColumn("rejection_code", code)
    label = F.when(bending, "Bending").when(bulk, "Bulk").otherwise("Default")
    shown = F.when(bending, str(rules.bending_length_threshold)).otherwise(str(rules.bulk_threshold))
    reason = (
        F.when(
            F.col("rejection_code") == "peak_cap",
            F.concat(
                F.lit("Peak VM "), one_decimal(peak), F.lit(" Pa > cap "),
                one_decimal(F.lit(float(cap))), F.lit(" Pa"),
            ),
        )
        .when(
            F.col("rejection_code") == "delta_l",
            F.concat(label, F.lit(" δ/L = "), fixed(by_length, 4), F.lit(" > "), shown),
        )
        .when(
            F.col("rejection_code") == "delta_t",
            F.concat(
                F.lit("Bending δ/t = "), fixed(by_thickness, 4), F.lit(" > "),
                F.lit(str(rules.bending_thickness_threshold)),
            ),
        )
        .otherwise("")
    )
    return gated.select(
        "*",
        reason.alias("rejection_reason"),
        F.when(has_thickness, "both").when(bending, "bending").otherwise("bulk").alias(
            "linearity_gate_type"
        ),
        F.col("rejection_code").isNull().alias("linearity_gate_pass"),
    )


def load_variants(
    bases: DataFrame, loads: LoadScaling, rules: LinearityGate, material: Material
) -> DataFrame:
    """Variants of each base that has a summary (see :func:`field_summary`)."""
    spread = with_safety_factors(bases, loads.safety_factors)
    target, factor = F.col("target_safety_factor"), F.col("scale_factor")
    scaled = spread.withColumn(
        "scale_factor", scale_factor(material.sigma_yield, target, F.col("ref_scale"))
    ).select(
        "*",
        variant_id(F.col("base_sample_id"), target).alias("sample_id"),
        load_class(target).alias("load_class"),
        (F.col("ref_peak") * factor).alias("peak_von_mises"),
        (F.col("ref_p95") * factor).alias("p95_von_mises"),
        (F.col("ref_max_disp") * factor).alias("max_displacement"),
    )
    return gate(scaled, loads.peak_stress_cap, rules)


def apply_factor(
    fields: DataFrame, variants: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Field rows of every variant, each listed column times the variant's factor; ``keep`` names variant columns that go along."""
    factors = variants.select(key, "sample_id", "scale_factor", *keep)
    scaled = [(F.col(c) * F.col("scale_factor")).alias(c) if c in columns else F.col(c)
              for c in fields.columns]
    return fields.join(factors, key).select("sample_id", "scale_factor", *keep, *scaled)


def choose_forces(nodes: DataFrame, sample: str, solver: Sequence[str], lumped: Sequence[str],
                  out: Sequence[str]) -> DataFrame:
    """Solver forces where a sample has any beyond 1e-30, else the lumped ones."""
    largest = F.greatest(*[F.abs(F.col(c)) for c in solver])
    has = nodes.groupBy(sample).agg(
        F.coalesce(F.max(largest) > 1e-30, F.lit(False)).alias("_solved")
    )
    return (
        nodes.join(has, sample)
        .select("*", *[F.when(F.col("_solved"), F.col(s)).otherwise(F.col(a)).alias(o)
                       for s, a, o in zip(solver, lumped, out)])
        .drop("_solved")
    )
