"""Von Mises, percentiles, scale factors and gates (O-27…O-29, O-64, O-74…O-79b, O-88)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import with_parts
from meshloom.config import DEFAULTS
from meshloom.functions.stress import safety_factor
from meshloom.operators import reports, scaling
from meshloom.operators.percentiles import percentiles_by
from meshloom.sources import derived as d

YIELD = DEFAULTS.material.sigma_yield


@query("gate_stats_by_safety_factor", with_parts("variants", """
SELECT geometry_family, linearity_gate_type, target_safety_factor, count(*) AS total,
       count(*) FILTER (WHERE linearity_gate_pass) AS passed,
       count(*) FILTER (WHERE NOT linearity_gate_pass) AS failed
FROM variants GROUP BY ALL"""))
def gate_stats_by_safety_factor(spark, sf):
    """Node fields → von Mises → P95 per base → variants → gates → counts."""
    return reports.gate_stats(d.variants(spark, sf), "target_safety_factor")


@query("von_mises_by_base", with_parts("nf", f"""
SELECT base_id, count(*) AS node_count, {sr('sum(von_mises)', 3, 'vm_sum')}, {sr('min(von_mises)', 3, 'vm_min')},
       {sr('max(von_mises)', 3, 'vm_max')} FROM nf GROUP BY base_id"""))
def von_mises_by_base(spark, sf):
    return d.node_fields(spark, sf).groupBy("base_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        r(F.sum("von_mises"), 3, "vm_sum"),
        r(F.min("von_mises"), 3, "vm_min"),
        r(F.max("von_mises"), 3, "vm_max"),
    )


@query("field_percentiles", with_parts("nf", f"""
SELECT base_id, {sr('quantile_cont(von_mises, 0.5)', 3, 'p50')}, {sr('quantile_cont(von_mises, 0.95)', 3, 'p95')}
FROM nf GROUP BY base_id"""))
def field_percentiles(spark, sf):
    out = percentiles_by(d.node_fields(spark, sf), ["base_id"], "von_mises", {"p50": 0.5, "p95": 0.95})
    return out.select("base_id", r("p50", 3), r("p95", 3))


@query("field_percentiles_giant_groups", with_parts("nf base", f"""
SELECT geometry_family, {sr('quantile_cont(von_mises, 0.05)', 3, 'p5')}, {sr('quantile_cont(von_mises, 0.5)', 3, 'p50')},
       {sr('quantile_cont(von_mises, 0.95)', 3, 'p95')}, {sr('quantile_cont(von_mises, 1.0)', 3, 'p100')}
FROM nf JOIN base USING (base_id) GROUP BY geometry_family"""))
def field_percentiles_giant_groups(spark, sf):
    """The selection path for groups too large for one task (forced by a low limit)."""
    rows = d.node_fields(spark, sf).join(d.bases(spark, sf).select("base_id", "geometry_family"), "base_id")
    named = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = percentiles_by(rows, ["geometry_family"], "von_mises", named, rest=1000)
    return out.select("geometry_family", *[r(n, 3) for n in named])


@query("scale_factors", with_parts("scaled", f"""
SELECT sample_id, target_safety_factor, {sr('scale_factor', 6, 'scale_factor')} FROM scaled"""))
def scale_factors(spark, sf):
    return d.variants(spark, sf).select("sample_id", "target_safety_factor", r("scale_factor", 6))


@query("scaled_fields", with_parts("scaled nf", f"""
SELECT sample_id, count(*) AS node_count, {sr('sum(n.s_xx*scale_factor)', 1, 's_xx')}, {sr('sum(n.s_xz*scale_factor)', 1, 's_xz')},
       {sr('sum(n.ux*scale_factor)', 9, 'ux')}, {sr('sum(n.von_mises*scale_factor)', 1, 'von_mises')}
FROM scaled JOIN nf n USING (base_id) GROUP BY sample_id"""))
def scaled_fields(spark, sf):
    columns = [*[f"s_{v}" for v in ("xx", "yy", "zz", "xy", "yz", "xz")], "ux", "uy", "uz", "von_mises"]
    fields = scaling.apply_factor(d.node_fields(spark, sf), d.variants(spark, sf), "base_id", columns)
    return fields.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        r(F.sum("s_xx"), 1, "s_xx"), r(F.sum("s_xz"), 1, "s_xz"), r(F.sum("ux"), 9, "ux"),
        r(F.sum("von_mises"), 1, "von_mises"),
    )


@query("variant_statistics", with_parts("scaled", f"""
SELECT sample_id, load_class, node_count, {sr('peak_von_mises', 1, 'peak_von_mises')}, {sr('p95_von_mises', 1, 'p95_von_mises')},
       {sr('max_displacement', 9, 'max_displacement')} FROM scaled"""))
def variant_statistics(spark, sf):
    return d.variants(spark, sf).select(
        "sample_id", "load_class", "node_count", r("peak_von_mises", 1), r("p95_von_mises", 1),
        r("max_displacement", 9),
    )


@query("peak_stress_cap_gate", with_parts("variants", f"""
SELECT sample_id, {sr('peak_von_mises', 1, 'peak_von_mises')}, rejection_reason FROM variants
WHERE rejection_code = 'peak_cap'"""))
def peak_stress_cap_gate(spark, sf):
    return d.variants(spark, sf).where(F.col("rejection_code") == "peak_cap").select(
        "sample_id", r("peak_von_mises", 1), "rejection_reason"
    )


@query("linearity_gate", with_parts("variants", """
SELECT sample_id, geometry_family, linearity_gate_type, linearity_gate_pass, rejection_code, rejection_reason
FROM variants WHERE rejection_code IS NULL OR rejection_code <> 'peak_cap'"""))
def linearity_gate(spark, sf):
    v = d.variants(spark, sf)
    return v.where(F.col("rejection_code").isNull() | (F.col("rejection_code") != "peak_cap")).select(
        "sample_id", "geometry_family", "linearity_gate_type", "linearity_gate_pass",
        "rejection_code", "rejection_reason",
    )


@query("load_variants", with_parts("variants", f"""
SELECT base_sample_id, sample_id, {sr('scale_factor', 6, 'scale_factor')}, linearity_gate_type, linearity_gate_pass,
       rejection_code FROM variants"""))
def load_variants(spark, sf):
    return d.variants(spark, sf).select(
        "base_sample_id", "sample_id", r("scale_factor", 6), "linearity_gate_type",
        "linearity_gate_pass", "rejection_code",
    )


@query("zero_field_gate", with_parts("basesum", f"""
SELECT base_sample_id, {sr('ref_p95', 3, 'ref_p95')}, CASE WHEN ref_p95 < 20000 THEN 'dropped' ELSE 'kept' END AS outcome
FROM basesum"""))
def zero_field_gate(spark, sf):
    """Kept bases go on; dropped ones form the side table (threshold raised to hit both)."""
    summaries, limit = d.base_summaries(spark, sf), 20000.0
    kept = scaling.nonzero_fields(summaries, limit).withColumn("outcome", F.lit("kept"))
    dropped = scaling.zero_fields(summaries, limit).withColumn("outcome", F.lit("dropped"))
    return kept.unionByName(dropped).select("base_sample_id", r("ref_p95", 3), "outcome")


@query("pointwise_safety_factor", with_parts("nf", f"""
SELECT base_id, {sr('min(420e6 / von_mises)', 3, 'min_sf')}, {sr('avg(420e6 / von_mises)', 3, 'mean_sf')}
FROM nf WHERE von_mises > 0 GROUP BY base_id"""))
def pointwise_safety_factor(spark, sf):
    factor = safety_factor(YIELD, F.col("von_mises"))
    return d.node_fields(spark, sf).groupBy("base_id").agg(
        r(F.min(factor), 3, "min_sf"), r(F.avg(factor), 3, "mean_sf")
    )


@query("gate_statistics", with_parts("variants", """
SELECT geometry_family, linearity_gate_type, count(*) AS total, count(*) FILTER (WHERE linearity_gate_pass) AS passed,
       count(*) FILTER (WHERE NOT linearity_gate_pass) AS failed FROM variants GROUP BY ALL"""))
def gate_statistics(spark, sf):
    return reports.gate_stats(d.variants(spark, sf))


@query("gate_firings", with_parts("variants", """
SELECT geometry_family, rejection_code, count(*) AS rejected FROM variants
WHERE rejection_code IS NOT NULL GROUP BY ALL"""))
def gate_firings(spark, sf):
    return reports.gate_firings(d.variants(spark, sf))
