"""Joins and lookups (O-30…O-36) and force selection (O-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.split_queries import split_manifest
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import with_parts
from meshloom.config import DEFAULTS
from meshloom.functions.uniform import uniform
from meshloom.operators import resume, scaling, topology
from meshloom.operators.gather import gather_points
from meshloom.sources import derived as d


@query("element_gather", with_parts("elnodes nodes", f"""
SELECT e.sample_id, e.elem_id, count(*) AS points, {sr('sum(x*(local+1))', 9, 'wx')}, {sr('sum(y)', 9, 'y')}, {sr('sum(uz)*1e3', 11, 'uz_milli')}
FROM elnodes e JOIN nodes n ON e.sample_id = n.sample_id AND e.node_id = n.node_id
GROUP BY e.sample_id, e.elem_id"""))
def element_gather(spark, sf):
    """Coordinates and displacement of each element's ten nodes, in local order."""
    got = gather_points(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf), ["x", "y", "uz"])

    def total(value):
        return F.aggregate("points", F.lit(0.0), lambda acc, p: acc + value(p))

    return got.select(
        "sample_id",
        "elem_id",
        F.size("points").cast("bigint").alias("points"),
        r(total(lambda p: p["x"] * (p["local"] + 1)), 9, "wx"),
        r(total(lambda p: p["y"]), 9, "y"),
        r(total(lambda p: p["uz"]) * 1e3, 11, "uz_milli"),
    )


@query("edge_endpoint_gather", with_parts("edges4 nodes", f"""
SELECT e.sample_id, src, dst, {sr('q.x - p.x', 6, 'dx')}, {sr('q.y - p.y', 6, 'dy')}, {sr('q.z - p.z', 6, 'dz')}
FROM edges4 e JOIN nodes p ON p.sample_id = e.sample_id AND p.node_id = src
     JOIN nodes q ON q.sample_id = e.sample_id AND q.node_id = dst"""))
def edge_endpoint_gather(spark, sf):
    edges = topology.undirected_edges(topology.graph_nodes(d.mesh_elements(spark, sf), "tet4"), 4)
    got = topology.edge_features(edges, d.mesh_nodes(spark, sf))
    return got.select(
        "sample_id", "src", "dst", *[r(F.col(c).cast("double"), 6, c) for c in ("dx", "dy", "dz")]
    )


@query("manifest_with_fields", with_parts("variants nf", f"""
SELECT sample_id, count(*) AS node_rows, {sr('max(nf.von_mises)', 3, 'reference_peak')}
FROM variants JOIN nf USING (base_id) WHERE linearity_gate_pass GROUP BY sample_id"""))
def manifest_with_fields(spark, sf):
    kept = d.variants(spark, sf).where("linearity_gate_pass").select("sample_id", "base_id")
    rows = kept.join(d.node_fields(spark, sf).select("base_id", "von_mises"), "base_id")
    return rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("node_rows"), r(F.max("von_mises"), 3, "reference_peak")
    )


@query("bases_by_safety_factor", with_parts("base", """
SELECT base_sample_id, t AS target_safety_factor
FROM base, (VALUES (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) q(t)"""))
def bases_by_safety_factor(spark, sf):
    spread = scaling.with_safety_factors(d.bases(spark, sf), DEFAULTS.loads.safety_factors)
    return spread.select("base_sample_id", "target_safety_factor")


@query("split_mapped_to_variants", with_parts("splitmani", "SELECT sample_id, split FROM splitmani"))
def split_mapped_to_variants(spark, sf):
    return split_manifest(spark, sf).select("sample_id", "split")


_DONE_SQL = "'42|' || base_sample_id || '|done'"


@query("completed_membership", with_parts("base", f"""
SELECT base_sample_id FROM base WHERE md5({_DONE_SQL}) < '8'"""))
def completed_membership(spark, sf):
    """Bases found in the completed set (about half of them)."""
    bases = d.bases(spark, sf)
    return bases.join(_done(bases), "base_sample_id", "left_semi").select("base_sample_id")


def _done(bases):
    return bases.where(uniform(42, "base_sample_id", "done") < 0.5).select("base_sample_id")


@query("resume_anti_join", with_parts("base", f"""
SELECT base_sample_id FROM base WHERE md5({_DONE_SQL}) >= '8'"""))
def resume_anti_join(spark, sf):
    bases = d.bases(spark, sf)
    return resume.remaining(bases, resume.completed_ids(_done(bases))).select("base_sample_id")


@query("completed_ids", with_parts("variants", "SELECT DISTINCT base_sample_id FROM variants"))
def completed_ids(spark, sf):
    return resume.completed_ids(d.variants(spark, sf))


@query("completed_count", with_parts("variants", "SELECT count(DISTINCT base_sample_id) AS completed FROM variants"))
def completed_count(spark, sf):
    return resume.completed_count(d.variants(spark, sf))


@query("force_fallback", with_parts("forced", f"""
SELECT sample_id, node_id, {sr('CASE WHEN sample_id % 4 = 0 THEN fx ELSE 1e4::DOUBLE * ux END', 10, 'gx')},
       {sr('CASE WHEN sample_id % 4 = 0 THEN fy ELSE 1e4::DOUBLE * uy END', 10, 'gy')}, {sr('CASE WHEN sample_id % 4 = 0 THEN fz ELSE 1e4::DOUBLE * uz END', 10, 'gz')}
FROM forced"""))
def force_fallback(spark, sf):
    """Solver forces (here all zero for every fourth sample) or else the lumped ones."""
    loads = d.mesh_bases(spark, sf).select(
        F.col("mesh_id").alias("sample_id"), "dir_x", "dir_y", "dir_z", "magnitude"
    )
    nodes = topology.lump_forces(d.masked_nodes(spark, sf), loads)
    silent = F.col("sample_id") % 4 == 0
    nodes = nodes.withColumns(
        {f"s{c}": F.when(silent, 0.0).otherwise(F.lit(1e4) * F.col(f"u{c}")) for c in "xyz"}
    )
    picked = scaling.choose_forces(
        nodes, "sample_id", ["sx", "sy", "sz"], ["fx", "fy", "fz"], ["gx", "gy", "gz"]
    )
    return picked.select("sample_id", "node_id", r("gx", 10), r("gy", 10), r("gz", 10))
