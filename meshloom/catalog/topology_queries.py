"""Edges, faces, masks, hop counts (O-50…O-63)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import with_parts
from meshloom.operators import contraction, hops, topology
from meshloom.sources import derived as d


def _edges(spark, sf, mode="tet4"):
    width = 10 if mode == "tet10" else 4
    return topology.undirected_edges(topology.graph_nodes(d.mesh_elements(spark, sf), mode), width)


def _cliques(spark, sf, mode="tet4"):
    """The same edges, not yet listed."""
    return topology.Cliques(topology.graph_nodes(d.mesh_elements(spark, sf), mode), 10 if mode == "tet10" else 4)


def _edge_totals(edges):
    """Per source node: its degree and a checksum of its neighbours."""
    return edges.groupBy("sample_id", "src").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("dst").alias("dst_sum")
    )


@query("tet4_projection", with_parts("elems", """
SELECT sample_id, elem_id, nodes[1] AS n0, nodes[2] AS n1, nodes[3] AS n2, nodes[4] AS n3 FROM elems"""))
def tet4_projection(spark, sf):
    kept = topology.graph_nodes(d.mesh_elements(spark, sf), "tet4")
    return kept.select("sample_id", "elem_id", *[F.get("nodes", i).alias(f"n{i}") for i in range(4)])


@query("clique_expansion", with_parts("elnodes", """
SELECT p.sample_id, p.node_id AS src, count(*) AS pairs, sum(q.node_id)::BIGINT AS dst_sum
FROM elnodes p JOIN elnodes q ON p.sample_id = q.sample_id AND p.elem_id = q.elem_id AND p.local < q.local
GROUP BY p.sample_id, p.node_id"""))
def clique_expansion(spark, sf):
    """All 45 pairs of each ten-node element, summed per first node."""
    pairs = topology.clique_edges(d.mesh_elements(spark, sf), 10)
    return pairs.groupBy("sample_id", "src").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("dst").alias("dst_sum")
    )


@query("undirected_edges_tet4", with_parts("edges4", "SELECT sample_id, src, dst FROM edges4"))
def undirected_edges_tet4(spark, sf):
    return _edges(spark, sf)


@query("undirected_edges_tet10", with_parts("edges10", """
SELECT sample_id, src, count(*) AS degree, sum(dst)::BIGINT AS dst_sum FROM edges10 GROUP BY sample_id, src"""))
def undirected_edges_tet10(spark, sf):
    return _edge_totals(_edges(spark, sf, "tet10"))


_FEATURES = f"""
SELECT e.sample_id, src, dst, {sr('(q.x-p.x)::FLOAT::DOUBLE', 7, 'dx')}, {sr('(q.y-p.y)::FLOAT::DOUBLE', 7, 'dy')}, {sr('(q.z-p.z)::FLOAT::DOUBLE', 7, 'dz')},
  {sr('sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z))::FLOAT::DOUBLE', 7, 'distance')}
FROM {{edges}} e JOIN nodes p ON p.sample_id = e.sample_id AND p.node_id = src
     JOIN nodes q ON q.sample_id = e.sample_id AND q.node_id = dst"""


def _feature_view(graph):
    return graph.select(
        "sample_id", "src", "dst",
        *[r(F.col(c).cast("double"), 7, c) for c in ("dx", "dy", "dz", "distance")],
    )


@query("edge_features", with_parts("edges4 nodes", _FEATURES.format(edges="edges4")))
def edge_features(spark, sf):
    return _feature_view(topology.edge_features(_edges(spark, sf), d.mesh_nodes(spark, sf)))


@query("graph_build_tet10", with_parts("edges10 nodes", f"""
SELECT e.sample_id, src, count(*) AS degree, {sr('sum((q.x-p.x)::FLOAT::DOUBLE)', 6, 'dx')},
  {sr('sum(sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z))::FLOAT::DOUBLE)', 6, 'distance')}
FROM edges10 e JOIN nodes p ON p.sample_id = e.sample_id AND p.node_id = src
     JOIN nodes q ON q.sample_id = e.sample_id AND q.node_id = dst GROUP BY e.sample_id, src"""))
def graph_build_tet10(spark, sf):
    graph = topology.build_graph(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf), "tet10")
    return graph.groupBy("sample_id", "src").agg(
        F.count(F.lit(1)).alias("degree"),
        r(F.sum(F.col("dx").cast("double")), 6, "dx"),
        r(F.sum(F.col("distance").cast("double")), 6, "distance"),
    )


@query("boundary_faces", with_parts("boundary", "SELECT sample_id, n0, n1, n2 FROM boundary"))
def boundary_faces(spark, sf):
    return topology.boundary_faces(d.mesh_elements(spark, sf))


@query("surface_node_mask", with_parts("nodes surface", """
SELECT n.sample_id, n.node_id, s.node_id IS NOT NULL AS is_surface
FROM nodes n LEFT JOIN surface s ON s.sample_id = n.sample_id AND s.node_id = n.node_id"""))
def surface_node_mask(spark, sf):
    marked = topology.mark_surface(d.mesh_nodes(spark, sf), d.mesh_elements(spark, sf))
    return marked.select("sample_id", "node_id", "is_surface")


@query("face_node_masks", with_parts("masked", "SELECT sample_id, node_id, is_loaded, is_fixed FROM masked"))
def face_node_masks(spark, sf):
    return d.masked_nodes(spark, sf).select("sample_id", "node_id", "is_loaded", "is_fixed")


@query("multihot_flag", with_parts("masked", """
SELECT sample_id, bool_or(is_fixed AND is_loaded) AS has_multihot_nodes FROM masked GROUP BY sample_id"""))
def multihot_flag(spark, sf):
    return topology.multihot_samples(d.masked_nodes(spark, sf))


@query("nodal_force_lumping", with_parts("forced", f"""
SELECT sample_id, node_id, {sr('fx', 6, 'fx')}, {sr('fy', 6, 'fy')}, {sr('fz', 6, 'fz')} FROM forced"""))
def nodal_force_lumping(spark, sf):
    loads = d.mesh_bases(spark, sf).select(
        F.col("mesh_id").alias("sample_id"), "dir_x", "dir_y", "dir_z", "magnitude"
    )
    lumped = topology.lump_forces(d.masked_nodes(spark, sf), loads)
    return lumped.select("sample_id", "node_id", r("fx", 6), r("fy", 6), r("fz", 6))


@query("mesh_counts", with_parts("nodes elems", """
SELECT n.sample_id, node_count, element_count FROM (SELECT sample_id, count(*) AS node_count FROM nodes GROUP BY 1) n
JOIN (SELECT sample_id, count(*) AS element_count FROM elems GROUP BY 1) e ON n.sample_id = e.sample_id"""))
def mesh_counts(spark, sf):
    return topology.mesh_counts(d.mesh_nodes(spark, sf), d.mesh_elements(spark, sf))


@query("connectivity_all_nodes", with_parts("nodes edges10 mesh", """
WITH RECURSIVE live AS (SELECT e.sample_id, src, dst FROM edges10 e WHERE NOT (e.sample_id % 5 = 0 AND (src = 0 OR dst = 0))),
walk AS (SELECT sample_id, min(node_id) AS node_id FROM nodes GROUP BY sample_id
         UNION SELECT l.sample_id, l.dst FROM walk w JOIN live l ON l.sample_id = w.sample_id AND l.src = w.node_id)
SELECT n.sample_id, n.c = w.c AS is_connected FROM (SELECT sample_id, count(*) AS c FROM nodes GROUP BY 1) n
JOIN (SELECT sample_id, count(*) AS c FROM walk GROUP BY 1) w ON n.sample_id = w.sample_id"""))
def connectivity_all_nodes(spark, sf):
    """Quadratic edges; the first node of every fifth sample is cut off."""
    cut = (F.col("sample_id") % 5 == 0) & ((F.col("src") == 0) | (F.col("dst") == 0))
    edges = topology.clique_edges(d.mesh_elements(spark, sf), 10).where(~cut)
    return hops.connectivity(d.mesh_nodes(spark, sf), edges)


@query("component_sizes", with_parts("nodes edges10 mesh", """
WITH RECURSIVE live AS (SELECT e.sample_id, src, dst FROM edges10 e
    WHERE NOT (e.sample_id % 5 = 0 AND (src = 0 OR dst = 0)) AND NOT (e.sample_id % 3 = 0 AND (src < 20) <> (dst < 20))),
least(sample_id, node_id, component) USING KEY (sample_id, node_id) AS (SELECT sample_id, node_id, node_id FROM nodes
    UNION SELECT l.sample_id, l.dst, min(w.component) FROM least w JOIN live l ON l.sample_id = w.sample_id AND l.src = w.node_id
    JOIN recurring.least r ON r.sample_id = l.sample_id AND r.node_id = l.dst WHERE w.component < r.component GROUP BY 1, 2)
SELECT sample_id, component, count(*) AS nodes FROM least GROUP BY 1, 2"""))
def component_sizes(spark, sf):
    """Quadratic edges, of which some samples lack those at node 0 and some those between nodes below 20 and the others."""
    cut = (F.col("sample_id") % 5 == 0) & ((F.col("src") == 0) | (F.col("dst") == 0))
    halves = (F.col("sample_id") % 3 == 0) & ((F.col("src") < 20) != (F.col("dst") < 20))
    edges = topology.clique_edges(d.mesh_elements(spark, sf), 10).where(~cut & ~halves)
    return contraction.component_sizes(contraction.components(d.mesh_nodes(spark, sf), edges))


_HOPS_SQL = """
WITH RECURSIVE seed AS (SELECT sample_id, 'f' AS s, node_id FROM masked WHERE is_fixed UNION ALL
                        SELECT sample_id, 'l', node_id FROM masked WHERE is_loaded),
walk AS (SELECT sample_id, s, node_id, 0 AS d FROM seed
         UNION SELECT w.sample_id, w.s, e.dst, w.d + 1 FROM walk w JOIN {edges} e ON e.sample_id = w.sample_id AND e.src = w.node_id
         WHERE w.d < 16),
best AS (SELECT sample_id, node_id, min(d) FILTER (WHERE s = 'f') AS hf, min(d) FILTER (WHERE s = 'l') AS hl FROM walk GROUP BY 1, 2)
SELECT m.sample_id, m.node_id, coalesce(hf, n)::BIGINT AS hops_to_fixed, coalesce(hl, n)::BIGINT AS hops_to_loaded
FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM masked) m
LEFT JOIN best b ON b.sample_id = m.sample_id AND b.node_id = m.node_id"""


def _hops_view(found):
    flags = ("hops_to_fixed", "hops_to_loaded")
    return found.select("sample_id", "node_id", *[F.col(f).cast("bigint").alias(f) for f in flags])


FLAGS = {"hops_to_fixed": "is_fixed", "hops_to_loaded": "is_loaded"}


@query("hops_to_sources_tet4", with_parts("masked edges4", _HOPS_SQL.format(edges="edges4")))
def hops_to_sources_tet4(spark, sf):
    """Mid-edge nodes have no linear edge, so they keep the node count unless flagged."""
    return _hops_view(hops.hops_to_sources(d.masked_nodes(spark, sf), _cliques(spark, sf), FLAGS))


@query("hops_to_sources_tet10", with_parts("masked edges10", _HOPS_SQL.format(edges="edges10").replace("w.d < 16", "w.d < 9")))
def hops_to_sources_tet10(spark, sf):
    return _hops_view(hops.hops_to_sources(d.masked_nodes(spark, sf), _cliques(spark, sf, "tet10"), FLAGS))


_DIAMETER_SQL = """
WITH RECURSIVE members AS (SELECT DISTINCT sample_id, src AS node_id FROM edges4),
starts AS (SELECT sample_id, node_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
             ORDER BY md5('42|' || sample_id || '|' || node_id || '|start'), node_id) AS rk FROM members) WHERE rk <= 5),
one AS (SELECT sample_id, rk, node_id, 0 AS d FROM starts
        UNION SELECT o.sample_id, o.rk, e.dst, o.d + 1 FROM one o JOIN edges4 e ON e.sample_id = o.sample_id AND e.src = o.node_id WHERE o.d < 12),
far AS (SELECT sample_id, rk, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, rk ORDER BY d DESC, node_id) AS q
          FROM (SELECT sample_id, rk, node_id, min(d) AS d FROM one GROUP BY ALL)) WHERE q = 1),
two AS (SELECT sample_id, rk, node_id, 0 AS d FROM far
        UNION SELECT o.sample_id, o.rk, e.dst, o.d + 1 FROM two o JOIN edges4 e ON e.sample_id = o.sample_id AND e.src = o.node_id WHERE o.d < 12)
SELECT sample_id, max(d)::BIGINT AS graph_diameter FROM (SELECT sample_id, rk, node_id, min(d) AS d FROM two GROUP BY ALL) GROUP BY sample_id"""


@query("graph_diameter", with_parts("edges4", _DIAMETER_SQL))
def graph_diameter(spark, sf):
    """Double sweep from five seeded starts over the nodes that carry edges."""
    found = hops.graph_diameter(d.mesh_nodes(spark, sf), _edges(spark, sf))
    return found.select("sample_id", F.col("graph_diameter").cast("bigint").alias("graph_diameter"))


@query("graph_diameter_all_nodes", with_parts("mesh", "SELECT sample_id, -1::BIGINT AS graph_diameter FROM mesh"))
def graph_diameter_all_nodes(spark, sf):
    """With mid-edge nodes counted but linear edges only, every sample is disconnected."""
    found = hops.graph_diameter(d.mesh_nodes(spark, sf), _edges(spark, sf), universe="all")
    return found.select("sample_id", F.col("graph_diameter").cast("bigint").alias("graph_diameter"))


@query("exact_diameter", with_parts("edges4 mesh", """
WITH RECURSIVE walk(sample_id, s, v, d) USING KEY (sample_id, s, v) AS (
    SELECT DISTINCT sample_id, src, src, 0 FROM edges4
    UNION SELECT w.sample_id, w.s, e.dst, min(w.d + 1) FROM walk w JOIN edges4 e ON e.sample_id = w.sample_id AND e.src = w.v
    LEFT JOIN recurring.walk r ON r.sample_id = w.sample_id AND r.s = w.s AND r.v = e.dst WHERE r.d IS NULL GROUP BY 1, 2, 3)
SELECT sample_id, max(d)::BIGINT AS diameter, true AS exact FROM walk GROUP BY sample_id"""))
def exact_diameter(spark, sf):
    """The true diameter over the nodes that carry edges, against all pairs."""
    found = hops.exact_diameter(d.mesh_nodes(spark, sf), _edges(spark, sf))
    return found.select("sample_id", F.col("diameter").cast("bigint").alias("diameter"), "exact")
