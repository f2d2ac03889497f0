"""Manifest and field storage, filters and row-level columns (O-01…O-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.split_queries import split_manifest
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import with_parts
from meshloom.config import DEFAULTS
from meshloom.functions import encode
from meshloom.operators import features, filters
from meshloom.operators.normalize import target_stats
from meshloom.operators.ranking import first_rows
from meshloom.operators.scaling import apply_factor
from meshloom.session import scratch_path
from meshloom.sources import derived as d
from meshloom.sources import fields as fs
from meshloom.sources import manifest as ms
from meshloom.sources import stats as st

MANIFEST_SQL = f"""
SELECT sample_id, geometry_family, scale_bucket, {sr('characteristic_length', 9, 'characteristic_length')},
       {sr('governing_thickness', 9, 'governing_thickness')}, {sr('radius_ratio', 9, 'radius_ratio')},
       target_safety_factor, {sr('peak_von_mises', 1, 'peak_von_mises')}, linearity_gate_pass, linearity_gate_type,
       coalesce(rejection_reason, '') AS rejection_reason, has_multihot_nodes, node_count::BIGINT AS node_count
FROM variants"""


def _manifest_view(m):
    return m.select(
        "sample_id", "geometry_family", "scale_bucket", r("characteristic_length", 9),
        r("governing_thickness", 9), r("radius_ratio", 9), "target_safety_factor",
        r("peak_von_mises", 1), "linearity_gate_pass", "linearity_gate_type",
        F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason"), "has_multihot_nodes",
        "node_count",
    )


@query("manifest_scan_parquet", with_parts("variants", MANIFEST_SQL))
def manifest_scan_parquet(spark, sf):
    path = scratch_path(spark, "manifest")
    ms.append_manifest(d.variants(spark, sf), path)
    return _manifest_view(ms.read_manifest(spark, path))


@query("manifest_scan_csv", with_parts("variants", MANIFEST_SQL))
def manifest_scan_csv(spark, sf):
    """Files with columns in another order, and without those that are null throughout, read by name."""
    path, variants = scratch_path(spark, "manifest-csv"), ms.conform(d.variants(spark, sf))
    kept = variants.where(filters.is_accepted())
    ms.append_manifest(variants.where(~filters.is_accepted()), path, "csv")
    shuffled = kept.select(*sorted(c for c in kept.columns if c != "rejection_reason"))
    shuffled.write.mode("append").csv(path, header=True)
    return _manifest_view(ms.read_manifest(spark, path, "csv"))


@query("manifest_tolerant_scan", with_parts("variants", """
SELECT sample_id, coalesce(rejection_reason, '') AS rejection_reason FROM variants
UNION ALL SELECT DISTINCT 'bad line', geometry_family || ',cut' FROM variants
UNION ALL SELECT 'damaged file', ''"""))
def manifest_tolerant_scan(spark, sf):
    """A stored manifest with a file that isn't Parquet, one with broken lines, and one that was never written."""
    path, broken = scratch_path(spark, "manifest"), scratch_path(spark, "manifest-csv")
    variants = d.variants(spark, sf)
    ms.append_manifest(variants, path)
    families = variants.select("geometry_family").distinct()
    families.coalesce(1).write.mode("append").text(path)
    lines = F.sort_array(F.collect_list(F.concat("geometry_family", F.lit(",cut"))))
    header = F.lit("sample_id,base_sample_id,geometry_family")
    families.agg(F.concat_ws("\n", header, lines).alias("value")).write.text(broken)
    absent = scratch_path(spark, "absent")
    read = ms.read_manifests(spark, [path, absent]).unionByName(ms.read_manifest_or_empty(spark, broken, "csv"))
    bad = ms.bad_rows(spark, broken).select(F.lit("bad line").alias("sample_id"), F.col("line").alias("rejection_reason"))
    damaged = ms.damaged_files(spark, path).select(F.lit("damaged file").alias("sample_id"), F.lit("").alias("rejection_reason"))
    return (
        read.select("sample_id", F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason"))
        .unionByName(bad)
        .unionByName(damaged)
    )


@query("manifest_append", with_parts("variants", """
SELECT target_safety_factor, geometry_family, count(*) AS rows, count(DISTINCT sample_id) AS samples,
       count(*) FILTER (WHERE linearity_gate_pass) AS accepted FROM variants GROUP BY ALL"""))
def manifest_append(spark, sf):
    """Two appends (accepted, then rejected) accumulate in one manifest."""
    path, v = scratch_path(spark, "manifest"), d.variants(spark, sf)
    ms.append_manifest(filters.accepted(v), path)
    ms.append_manifest(v.where(~filters.is_accepted()), path)
    return ms.read_manifest(spark, path).groupBy("target_safety_factor", "geometry_family").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("sample_id").alias("samples"),
        F.count_if("linearity_gate_pass").alias("accepted"),
    )


def _elements_by_mode(spark, sf):
    """Every third mesh lacks quadratic connectivity."""
    e = d.mesh_elements(spark, sf)
    return e.select(
        "sample_id", "elem_id", F.slice("nodes", 1, 4).alias("nodes4"),
        F.when(F.col("sample_id") % 3 != 0, F.col("nodes")).alias("nodes10"),
    )


@query("field_scan_by_mode", with_parts("elems", """
SELECT sample_id, elem_id, len(n) AS width, list_sum(n)::BIGINT AS node_sum FROM (
  SELECT sample_id, elem_id, CASE WHEN sample_id % 3 <> 0 THEN nodes ELSE nodes[1:4] END AS n FROM elems)"""))
def field_scan_by_mode(spark, sf):
    path = scratch_path(spark, "elements")
    _elements_by_mode(spark, sf).write.parquet(path)
    picked = fs.read_elements(spark, path, "tet10")
    total = F.aggregate("nodes", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return picked.select(
        "sample_id", "elem_id", F.size("nodes").cast("bigint").alias("width"), total.alias("node_sum")
    )


@query("field_scan_columns", with_parts("nodes", f"""
SELECT sample_id, {sr('sum(ux)', 14, 'ux')}, {sr('max(z)', 9, 'z_max')} FROM nodes GROUP BY sample_id"""))
def field_scan_columns(spark, sf):
    path = scratch_path(spark, "nodes")
    d.mesh_nodes(spark, sf).write.parquet(path)
    return fs.read_nodes(spark, path, ["z", "ux"]).groupBy("sample_id").agg(
        r(F.sum("ux"), 14, "ux"), r(F.max("z"), 9, "z_max")
    )


@query("samples_with_fields", with_parts("base nf", """
SELECT base_sample_id, geometry_family FROM base WHERE base_id IN (SELECT base_id FROM nf)"""))
def samples_with_fields(spark, sf):
    kept = fs.with_fields_only(d.bases(spark, sf), d.node_fields(spark, sf), "base_id")
    return kept.select("base_sample_id", "geometry_family")


@query("sample_fields_sink", with_parts("variants nf", f"""
SELECT scale_bucket, count(*) AS node_rows, count(DISTINCT sample_id) AS samples, {sr('sum(nf.von_mises * scale_factor) / 1e9', 3, 'vm_giga')}
FROM variants JOIN nf USING (base_id) WHERE linearity_gate_pass GROUP BY scale_bucket"""))
def sample_fields_sink(spark, sf):
    """Fields of accepted variants only, stored by bucket and read back."""
    path, v = scratch_path(spark, "fields"), d.stored_variants(spark, sf)
    rows = apply_factor(d.node_fields(spark, sf), v, "base_id", ["ux", "uy", "uz", "von_mises"])
    fs.write_sample_fields(rows, v, path, ["base_id", "sample_id"])
    return spark.read.parquet(path).groupBy("scale_bucket").agg(
        F.count(F.lit(1)).alias("node_rows"),
        F.count_distinct("sample_id").alias("samples"),
        r(F.sum("von_mises") / 1e9, 3, "vm_giga"),
    )


def _stats_sql() -> str:
    items = []
    for t in st.TARGETS:
        cast = "" if t == "von_mises" else "::FLOAT::DOUBLE"
        items.append(sr(f"avg({t}){cast} * {_unit(t)}", 4, f"mean_{t}"))
        items.append(sr(f"greatest(stddev_pop({t}), 1e-10){cast} * {_unit(t)}", 4, f"std_{t}"))
    return with_parts("nf", f"SELECT {', '.join(items)} FROM nf")


def _unit(t: str) -> str:
    return "1e6" if t.startswith("u") else "1e-2"


def _stats_view(stats):
    return stats.select(
        *[r(F.col(c).cast("double") * float(_unit(c.split("_", 1)[1])), 4, c) for c in st.STATS_COLUMNS]
    )


@query("stats_roundtrip", _stats_sql())
def stats_roundtrip(spark, sf):
    path = scratch_path(spark, "stats")
    st.save_stats(target_stats(d.node_fields(spark, sf)), path)
    return _stats_view(st.load_stats(spark, path))


@query("stats_cache_rule", _stats_sql())
def stats_cache_rule(spark, sf):
    """First call computes and stores; the second reads what was stored."""
    path = scratch_path(spark, "stats")
    st.cached_stats(spark, None, path, lambda: target_stats(d.node_fields(spark, sf)))

    def never():
        raise AssertionError("stored statistics were ignored")

    return _stats_view(st.cached_stats(spark, None, path, never))


@query("accepted_filter", with_parts("variants", """
SELECT sample_id FROM variants WHERE rejection_reason IS NULL OR rejection_reason = ''"""))
def accepted_filter(spark, sf):
    return filters.accepted(d.variants(spark, sf)).select("sample_id")


@query("coherence_filter", with_parts("base", "SELECT base_sample_id FROM base WHERE coherence_pass"))
def coherence_filter(spark, sf):
    return filters.coherent(d.bases(spark, sf)).select("base_sample_id")


@query("split_filter", with_parts("splitmani", "SELECT sample_id FROM splitmani WHERE split = 'val'"))
def split_filter(spark, sf):
    manifest = split_manifest(spark, sf)
    return filters.in_split(manifest, "val").select("sample_id")


@query("head_samples", with_parts("variants", f"""
SELECT sample_id, {sr('scale_factor', 6, 'scale_factor')} FROM variants WHERE linearity_gate_pass
ORDER BY sample_id LIMIT 500"""))
def head_samples(spark, sf):
    """The cap on samples that goes into statistics: first 500 by id after filters."""
    kept = filters.accepted(d.variants(spark, sf))
    return first_rows(kept, ["sample_id"], 500).select("sample_id", r("scale_factor", 6))


FACE_NAMES = (*d.FACES, "fillet_surface", "hole_1", "x_mid", "max_x")
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in FACE_NAMES) + "]"


@query("valid_faces", f"""
SELECT o_orderkey AS base_id, f AS face FROM (SELECT o_orderkey, ({_NAMES_SQL})[1 + o_orderkey % 10] AS f FROM orders)
WHERE regexp_matches(f, '^[xyz]_(min|max)$')""")
def valid_faces(spark, sf):
    face = d.chosen(F.col("o_orderkey") % 10, FACE_NAMES)
    rows = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("base_id"), face.alias("face"))
    return rows.where(encode.is_valid_face(F.col("face")))


@query("face_parse", f"""
SELECT o_orderkey AS base_id, CASE WHEN ok THEN instr('xyz', f[1]) - 1 END::BIGINT AS axis,
       CASE WHEN ok THEN f[3:] END AS side
FROM (SELECT *, regexp_matches(f, '^[xyz]_(min|max)$') AS ok FROM (
  SELECT o_orderkey, ({_NAMES_SQL})[1 + o_orderkey % 10] AS f FROM orders))""")
def face_parse(spark, sf):
    face = d.chosen(F.col("o_orderkey") % 10, FACE_NAMES)
    return d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("base_id"),
        encode.face_axis(face).cast("bigint").alias("axis"),
        encode.face_side(face).alias("side"),
    )


@query("category_codes", with_parts("base", """
SELECT base_sample_id, (CASE geometry_family WHEN 'block_with_holes' THEN 0 WHEN 'l_bracket' THEN 1
         WHEN 'elongated_bar' THEN 2 WHEN 'plate_3d' THEN 3 WHEN 'block_with_fillet' THEN 4 ELSE -1 END)::BIGINT AS family_code,
       (CASE WHEN tag % 17 = 0 THEN -1 WHEN scale_bucket = 'small' THEN 0 WHEN scale_bucket = 'medium' THEN 1 ELSE 2 END)::BIGINT AS bucket_code
FROM base"""))
def category_codes(spark, sf):
    """Known names to codes; an unknown bucket name becomes -1."""
    bucket = F.when(F.col("tag") % 17 == 0, "giant").otherwise(F.col("scale_bucket"))
    return d.bases(spark, sf).select(
        "base_sample_id",
        encode.family_code(F.col("geometry_family")).cast("bigint").alias("family_code"),
        encode.bucket_code(bucket).cast("bigint").alias("bucket_code"),
    )


@query("graph_attributes_with_defaults", with_parts("base", f"""
SELECT base_sample_id AS sample_id, {sr('characteristic_length::FLOAT::DOUBLE', 6, 'characteristic_length')}, 1.0::DOUBLE AS safety_factor
FROM base"""))
def graph_attributes_with_defaults(spark, sf):
    """No safety-factor column in this manifest, so it defaults to 1."""
    bases = d.bases(spark, sf).withColumn("sample_id", F.col("base_sample_id"))
    return features.graph_attributes(bases).select(
        "sample_id",
        r(F.col("characteristic_length").cast("double"), 6, "characteristic_length"),
        F.col("safety_factor").cast("double").alias("safety_factor"),
    )


@query("scale_buckets", with_parts("base", f"""
SELECT base_sample_id, {sr('characteristic_length', 9, 'characteristic_length')}, scale_bucket FROM base"""))
def scale_buckets(spark, sf):
    return d.bases(spark, sf).select("base_sample_id", r("characteristic_length", 9), "scale_bucket")


@query("mesh_sizes", with_parts("base", f"""
SELECT base_sample_id, {sr('mesh_size', 9, 'mesh_size')},
       {sr("least(mesh_size, CASE WHEN radius_ratio IS NULL THEN mesh_size ELSE radius_ratio * characteristic_length / 4.0::DOUBLE END)", 9, 'local_size')}
FROM base"""))
def mesh_sizes(spark, sf):
    local = encode.local_mesh_size(
        F.col("mesh_size"), F.col("radius_ratio") * F.col("characteristic_length")
    )
    return d.bases(spark, sf).select("base_sample_id", r("mesh_size", 9), r(local, 9, "local_size"))


@query("variant_ids", with_parts("scaled", "SELECT base_sample_id, sample_id, load_class FROM scaled"))
def variant_ids(spark, sf):
    return d.variants(spark, sf).select("base_sample_id", "sample_id", "load_class")
