"""Reports and checks over manifests and fields (O-80…O-94, S-01…S-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.split_queries import split_manifest
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import with_parts
from meshloom.config import DEFAULTS
from meshloom.operators import reports, topology
from meshloom.operators.gather import element_to_node
from meshloom.operators.scaling import load_variants, nonzero_fields, zero_fields
from meshloom.session import sample_parts, store_once, store_placed
from meshloom.sources import derived as d


@query("stratum_crosstab", with_parts("variants", """
SELECT coalesce(geometry_family, 'All') AS geometry_family, count(*) FILTER (WHERE scale_bucket = 'small') AS small,
       count(*) FILTER (WHERE scale_bucket = 'medium') AS medium, count(*) FILTER (WHERE scale_bucket = 'large') AS large,
       count(*) AS "All" FROM variants GROUP BY ROLLUP (geometry_family)"""))
def stratum_crosstab(spark, sf):
    return reports.stratum_crosstab(d.variants(spark, sf))


@query("stratum_safety_factor_cube", with_parts("variants", """
SELECT CASE WHEN grouping(geometry_family) = 1 THEN 'All' ELSE geometry_family END AS geometry_family,
       CASE WHEN grouping(scale_bucket) = 1 THEN 'All' ELSE scale_bucket END AS scale_bucket,
       CASE WHEN grouping(load_class) = 1 THEN 'All' ELSE load_class END AS load_class, count(*) AS rows
FROM variants GROUP BY CUBE (geometry_family, scale_bucket, load_class)"""))
def stratum_safety_factor_cube(spark, sf):
    """Counts per tier and over all family × bucket × tier cells, with margins."""
    return reports.stratum_cube(
        d.variants(spark, sf), ["geometry_family", "scale_bucket", "load_class"]
    )


@query("base_counts", with_parts("variants", """
SELECT geometry_family, scale_bucket, count(DISTINCT base_sample_id) AS base_samples FROM variants GROUP BY ALL"""))
def base_counts(spark, sf):
    return reports.base_counts(d.variants(spark, sf))


_ALMOST_FULL = "(SELECT max(n) * 8 // 10 FROM (SELECT count(*) AS n FROM base GROUP BY geometry_family, scale_bucket))"


def _floor(bases):
    """Four fifths of the fullest stratum."""
    return reports.base_counts(bases).select(F.floor(F.max("base_samples") * 8 / 10)).scalar()


@query("floor_warnings", with_parts("base", f"""
SELECT geometry_family, scale_bucket, count(*) AS base_samples FROM base GROUP BY ALL HAVING count(*) < {_ALMOST_FULL}"""))
def floor_warnings(spark, sf):
    bases = d.bases(spark, sf)
    return reports.floor_warnings(bases, _floor(bases))


@query("strata_floor_verification", with_parts("base", f"""
WITH grid AS (SELECT f AS geometry_family, b AS scale_bucket FROM
  (VALUES ('block_with_holes'), ('l_bracket'), ('elongated_bar'), ('plate_3d'), ('block_with_fillet')) x(f),
  (VALUES ('small'), ('medium'), ('large')) y(b)),
c AS (SELECT geometry_family, scale_bucket, count(*) AS n FROM base WHERE NOT (geometry_family = 'plate_3d' AND scale_bucket = 'small') GROUP BY ALL)
SELECT geometry_family, scale_bucket, coalesce(n, 0) AS base_samples, greatest({_ALMOST_FULL} - coalesce(n, 0), 0)::BIGINT AS shortfall
FROM grid LEFT JOIN c USING (geometry_family, scale_bucket)"""))
def strata_floor_verification(spark, sf):
    """One stratum is removed, so an absent one shows up with count 0."""
    bases = d.bases(spark, sf)
    absent = (F.col("geometry_family") == "plate_3d") & (F.col("scale_bucket") == "small")
    out = reports.stratum_shortfalls(bases.where(~absent), _floor(bases))
    return out.orderBy("geometry_family", "scale_bucket")


@query("split_counts", with_parts("splitmani", """
SELECT split, count(*) AS total_samples, count(DISTINCT base_sample_id) AS base_samples FROM splitmani GROUP BY split"""))
def split_counts(spark, sf):
    return reports.split_counts(split_manifest(spark, sf))


@query("split_ratios", with_parts("splitmani", f"""
WITH c AS (SELECT geometry_family, scale_bucket, split, count(DISTINCT base_sample_id) AS base_samples FROM splitmani GROUP BY ALL)
SELECT *, {sr('base_samples / sum(base_samples) OVER (PARTITION BY geometry_family, scale_bucket)', 9, 'ratio')} FROM c"""))
def split_ratios(spark, sf):
    out = reports.split_ratios(split_manifest(spark, sf))
    return out.select("geometry_family", "scale_bucket", "split", "base_samples", r("ratio", 9))


_LEN = "characteristic_length"


@query("length_distribution", with_parts("base", f"""
SELECT {sr(f'min({_LEN})', 8, 'min')}, {sr(f'max({_LEN})', 8, 'max')}, {sr(f'avg({_LEN})', 8, 'mean')}, {sr(f'stddev_samp({_LEN})', 8, 'std')},
       {sr(f'quantile_cont({_LEN}, 0.05)', 8, 'p5')}, {sr(f'quantile_cont({_LEN}, 0.5)', 8, 'median')}, {sr(f'quantile_cont({_LEN}, 0.95)', 8, 'p95')}
FROM base"""))
def length_distribution(spark, sf):
    out = reports.length_distribution(d.bases(spark, sf))
    return out.select(*[r(c, 8) for c in ("min", "max", "mean", "std", "p5", "median", "p95")])


@query("coverage_warnings", with_parts("base", f"""
SELECT {sr(f'min({_LEN})', 9, 'min_length')}, {sr(f'max({_LEN})', 9, 'max_length')}, min({_LEN}) > 0.02::DOUBLE * 1.5::DOUBLE AS low_end_missing,
       max({_LEN}) < 2.0::DOUBLE * 0.7::DOUBLE AS high_end_missing FROM base"""))
def coverage_warnings(spark, sf):
    out = reports.coverage_warnings(d.bases(spark, sf), DEFAULTS.scale.length_range)
    return out.select(r("min_length", 9), r("max_length", 9), "low_end_missing", "high_end_missing")


@query("node_count_distribution", with_parts("summ", f"""
SELECT min(node_count) AS min, max(node_count) AS max, {sr('avg(node_count)', 8, 'mean')}, {sr('quantile_cont(node_count::DOUBLE, 0.5)', 8, 'median')} FROM summ"""))
def node_count_distribution(spark, sf):
    out = reports.node_count_distribution(d.base_summaries(spark, sf))
    return out.select("min", "max", r("mean", 8), r("median", 8))


_MONITOR = f"""
SELECT scale_bucket, count(*) AS rows, {sr('avg(CASE WHEN coherence_pass THEN 1.0 ELSE 0.0 END)', 9, 'pass_rate')},
       {sr('avg(solve_time_s)', 9, 'mean_solve_s')}, {sr('max(solve_time_s)', 9, 'max_solve_s')},
       {sr('quantile_cont(solve_time_s, 0.5)', 9, 'p50_solve_s')}, {sr('quantile_cont(solve_time_s, 0.95)', 9, 'p95_solve_s')}
FROM base GROUP BY scale_bucket"""


@query("bucket_health", with_parts("base", _MONITOR))
def bucket_health(spark, sf):
    out = reports.bucket_health(d.bases(spark, sf))
    numbers = [c for c in out.columns if c not in ("scale_bucket", "rows")]
    return out.select("scale_bucket", "rows", *[r(c, 9) for c in numbers])


@query("diameter_report", with_parts("base", f"""
SELECT geometry_family, scale_bucket, max(graph_diameter) AS max_diameter, {sr('avg(graph_diameter)', 9, 'mean_diameter')},
       count(*) FILTER (WHERE graph_diameter > 15) AS beyond_receptive_field FROM base GROUP BY ALL"""))
def diameter_report(spark, sf):
    out = reports.diameter_report(d.bases(spark, sf), DEFAULTS.checks.receptive_field_hops)
    return out.select(
        "geometry_family", "scale_bucket", "max_diameter", r("mean_diameter", 9),
        "beyond_receptive_field",
    )


@query("run_summary", with_parts("variants", """
WITH b AS (SELECT base_sample_id, bool_or(has_multihot_nodes) AS m, count(*) AS v, count(*) FILTER (WHERE coherence_pass) AS c,
                  count(*) FILTER (WHERE linearity_gate_pass) AS a FROM variants WHERE ref_scale >= 20000 GROUP BY 1),
z AS (SELECT count(*) AS n FROM basesum WHERE ref_scale < 20000)
SELECT count(*) AS success, (SELECT count(*) FROM base) - count(*) - (SELECT n FROM z) AS failed, (SELECT n FROM z) AS zero_rejected, sum(v)::BIGINT AS variants, sum(a)::BIGINT AS accepted, sum(c)::BIGINT AS coherence_pass,
       count(*) FILTER (WHERE m) AS multihot, count(*) FILTER (WHERE m) < 50 AS multihot_warning FROM b"""))
def run_summary(spark, sf):
    """Bases without fields failed; those below the raised zero-field limit were rejected."""
    summaries = store_once(d.base_summaries(spark, sf), "summaries")
    manifest = load_variants(
        nonzero_fields(summaries, 20000.0), d.FIXTURE_LOADS, DEFAULTS.gate, DEFAULTS.material
    )
    return reports.run_summary(
        manifest, d.bases(spark, sf), zero_fields(summaries, 20000.0),
        DEFAULTS.checks.min_multihot_samples,
    )


def lumped_nodes(spark, sf):
    loads = d.mesh_bases(spark, sf).select(
        F.col("mesh_id").alias("sample_id"), "dir_x", "dir_y", "dir_z", "magnitude"
    )
    return topology.lump_forces(d.masked_nodes(spark, sf), loads)


@query("global_attributes", with_parts("forced", f"""
SELECT sample_id, {sr('sqrt(sum(fx)*sum(fx) + sum(fy)*sum(fy) + sum(fz)*sum(fz))', 6, 'total_load_vector')},
       {sr('sum(sqrt(fx*fx + fy*fy + fz*fz))', 6, 'total_load_l2')}, count(*) FILTER (WHERE is_fixed) AS pinned_node_count,
       count(*) AS total_node_count FROM forced GROUP BY sample_id"""))
def global_attributes(spark, sf):
    out = reports.global_attributes(lumped_nodes(spark, sf))
    return out.select(
        "sample_id", r("total_load_vector", 6), r("total_load_l2", 6), "pinned_node_count",
        "total_node_count",
    )


@query("thickness_slice_profile", with_parts("nodes nodeavg", f"""
WITH n AS (SELECT n.sample_id, z, coalesce(von_mises, 0.0) AS vm FROM nodes n LEFT JOIN nodeavg a ON a.sample_id = n.sample_id AND a.node_id = n.node_id),
b AS (SELECT sample_id, min(z) AS lo, max(z) AS hi, avg(vm) AS nominal FROM n GROUP BY 1),
s AS (SELECT n.sample_id, vm, nominal, CASE WHEN hi > lo THEN least(floor((z - lo) / (hi - lo) * 4), 3)::BIGINT ELSE 0 END AS z_slice FROM n JOIN b USING (sample_id))
SELECT sample_id, z_slice, {sr('max(vm) / 1e6', 5, 'peak')}, {sr('quantile_cont(vm, 0.9) / 1e6', 5, 'p90')}, {sr('quantile_cont(vm, 0.95) / 1e6', 5, 'p95')},
       {sr('quantile_cont(vm, 0.99) / 1e6', 5, 'p99')}, {sr('CASE WHEN max(nominal) > 0 THEN max(vm) / max(nominal) END', 6, 'kt')}
FROM s GROUP BY sample_id, z_slice"""))
def thickness_slice_profile(spark, sf):
    """Stress percentiles and concentration in four z-slices of every mesh."""
    keys = d.mesh_nodes(spark, sf).select("sample_id", "node_id", "z")
    solved = d.solved_elements(spark, sf, stored=["von_mises"])
    # Read several times, so the averages are stored once, where they lie.
    nodes = element_to_node(solved, keys, ["von_mises"])
    parts = sample_parts(spark, d.table(spark, sf, "part").count())
    nodes = store_placed(nodes, "averages", "sample_id", parts)
    mean = nodes.groupBy("sample_id").agg(F.avg("von_mises").alias("nominal"))
    out = reports.slice_profile(nodes.join(mean, "sample_id"), 4, "nominal")
    return out.select(
        "sample_id", F.col("z_slice").cast("bigint").alias("z_slice"),
        *[r(F.col(c) / 1e6, 5, c) for c in ("peak", "p90", "p95", "p99")], r("kt", 6),
    )


@query("reaction_balance", with_parts("forced", f"""
WITH react AS (SELECT *, CASE WHEN is_fixed THEN -600.0 / n_fixed * k ELSE 0.0 END AS rx, CASE WHEN is_fixed THEN -800.0 / n_fixed * k ELSE 0.0 END AS rz FROM (
  SELECT *, count(*) FILTER (WHERE is_fixed) OVER (PARTITION BY sample_id) AS n_fixed,
         CASE WHEN sample_id % 9 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS k FROM forced))
SELECT sample_id, {sr('residual', 6, 'residual')}, {sr('load', 6, 'load')}, residual <= 1e-6 * greatest(load, 1e-30) AS balanced
FROM (SELECT sample_id, sqrt(pow(sum(fx + rx), 2) + pow(sum(fz + rz), 2)) AS residual, sqrt(pow(sum(fx), 2) + pow(sum(fz), 2)) AS load FROM react GROUP BY 1)"""))
def reaction_balance(spark, sf):
    """Reactions shared over fixed nodes; every ninth sample's are a tenth too small."""
    nodes = lumped_nodes(spark, sf)
    fixed = nodes.groupBy("sample_id").agg(F.count_if("is_fixed").alias("n_fixed"))
    k = F.when(F.col("sample_id") % 9 == 0, 0.9).otherwise(1.0)

    def share(total: float):
        return F.when(F.col("is_fixed"), F.lit(-total) / F.col("n_fixed") * k).otherwise(0.0)

    reacting = nodes.join(fixed, "sample_id").withColumns(
        {"rx": share(600.0), "ry": F.lit(0.0), "rz": share(800.0)}
    )
    out = reports.reaction_balance(reacting, 1e-6)
    return out.select("sample_id", r("residual", 6), r("load", 6), "balanced")


@query("zero_radius_assertion", with_parts("base", """
SELECT base_sample_id FROM base WHERE geometry_family = 'l_bracket' AND (radius_ratio IS NULL OR radius_ratio < 0.03 OR tag % 100 = 0)"""))
def zero_radius_assertion(spark, sf):
    """Radii below r/d 0.03 count as zero here, and some are missing, so rows are found."""
    keep = (F.col("radius_ratio") >= 0.03) & (F.col("tag") % 100 != 0)
    radius = F.when(keep, F.col("radius_ratio") * F.col("characteristic_length"))
    bases = d.bases(spark, sf).withColumn("fillet_radius", radius)
    return reports.zero_radius(bases).select("base_sample_id")


@query("held_out_ratio_in_train", with_parts("splitmani", """
SELECT sample_id FROM splitmani WHERE geometry_family = 'l_bracket' AND radius_ratio BETWEEN 0.09::DOUBLE AND 0.21::DOUBLE AND split = 'train'"""))
def held_out_ratio_in_train(spark, sf):
    """Looked for in a range slightly wider than the holdout, whose rim is in train."""
    return reports.held_out_in_train(split_manifest(spark, sf), (0.09, 0.21)).select("sample_id")
