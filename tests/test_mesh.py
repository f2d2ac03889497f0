"""Closed-form checks of topology, volumes, strains and hop counts on tiny meshes."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.catalog import report_queries, strain_queries, training_queries
from meshloom.config import Material
from meshloom.functions.stress import VOIGT
from meshloom.operators import coherence, contraction, gather, hops, strain, topology, whole
from meshloom.plans import dataset
from meshloom.session import store_once
from meshloom.sources import derived

CORNERS = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
EDGES = [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)]
SKEW = np.array([[1.3, 0.2, 0.1], [0.1, 0.8, 0.3], [0.25, 0.05, 1.1]])


def tet10_points(matrix=np.eye(3)):
    corners = [np.array(c) @ matrix.T for c in CORNERS]
    return corners + [(corners[i] + corners[j]) / 2 for i, j in EDGES]


def node_frame(spark, points, displacement, sample=1):
    rows = []
    for i, p in enumerate(points):
        rows.append((sample, i, *map(float, p), *map(float, displacement(p))))
    return spark.createDataFrame(
        rows, "sample_id long, node_id long, x double, y double, z double, ux double, uy double, uz double"
    )


def element_frame(spark, elements, sample=1):
    return spark.createDataFrame(
        [(sample, i, list(e)) for i, e in enumerate(elements)],
        "sample_id long, elem_id long, nodes array<long>",
    )


def strain_row(df):
    row = df.first()
    return np.array([row[f"e_{v}"] for v in VOIGT])


def test_rigid_translation_has_no_strain(spark):
    nodes = node_frame(spark, tet10_points(SKEW), lambda p: (0.5, -0.3, 0.7))
    quadratic = strain.tet10_strains(element_frame(spark, [range(10)]), nodes)
    linear = strain.tet4_strains(element_frame(spark, [range(10)]), nodes)
    assert np.allclose(strain_row(quadratic), 0, atol=1e-12)
    assert np.allclose(strain_row(linear), 0, atol=1e-12)


def test_linear_field_is_exact_on_both_elements(spark):
    """A skewed element tells the gradient from its transpose."""
    a = np.array([[1.0, 2.0, -0.5], [0.3, -1.0, 0.7], [0.2, 0.9, 0.4]]) * 1e-3
    nodes = node_frame(spark, tet10_points(SKEW), lambda p: a @ p)
    wanted = [a[0, 0], a[1, 1], a[2, 2], a[0, 1] + a[1, 0], a[1, 2] + a[2, 1], a[0, 2] + a[2, 0]]
    for make in (strain.tet4_strains, strain.tet10_strains):
        assert np.allclose(strain_row(make(element_frame(spark, [range(10)]), nodes)), wanted, atol=1e-15)


def test_quadratic_field_average_is_the_centroid_value(spark):
    nodes = node_frame(spark, tet10_points(SKEW), lambda p: (p[0] * p[1], p[2] ** 2, p[0] * p[2]))
    got = strain_row(strain.tet10_strains(element_frame(spark, [range(10)]), nodes))
    cx, cy, cz = np.mean(tet10_points(SKEW)[:4], axis=0)
    assert np.allclose(got, [cy, 0, cx, cx, 2 * cz, cz], atol=1e-7)


def test_point_strains_follow_the_quadratic_field(spark):
    nodes = node_frame(spark, tet10_points(), lambda p: (p[0] ** 2, 0.0, 0.0))
    rows = strain.tet10_point_strains(element_frame(spark, [range(10)]), nodes).orderBy("gp").collect()
    at = [strain.GAUSS_FAR, strain.GAUSS_NEAR, strain.GAUSS_FAR, strain.GAUSS_FAR]
    assert [r["gp"] for r in rows] == [0, 1, 2, 3]
    assert np.allclose([r["e_xx"] for r in rows], [2 * x for x in at], atol=1e-12)


def test_unit_tetrahedron_volume(spark):
    nodes = node_frame(spark, tet10_points(), lambda p: (0, 0, 0))
    for make in (strain.tet4_volumes, strain.tet10_volumes):
        volume = make(element_frame(spark, [range(10)]), nodes).first()["volume"]
        assert math.isclose(volume, 1 / 6, rel_tol=1e-10)


def test_degenerate_element_has_zero_strain_and_a_self_loop(spark):
    flat = [0, 1, 2, 2]
    nodes = node_frame(spark, tet10_points(), lambda p: (p[0], p[1], p[2]))
    row = strain.tet4_strains(element_frame(spark, [flat]), nodes).first()
    assert row["volume"] == 0 and all(row[f"e_{v}"] == 0 for v in VOIGT)
    edges = topology.undirected_edges(element_frame(spark, [flat]), 4).collect()
    assert sum(e["src"] == e["dst"] == 2 for e in edges) == 1


def test_edges_are_undirected_and_distinct(spark):
    pair = [(0, 1, 2, 3), (1, 2, 3, 4)]
    got = {(e["src"], e["dst"]) for e in topology.undirected_edges(element_frame(spark, pair), 4).collect()}
    want = {(a, b) for e in pair for a in e for b in e if a != b}
    assert got == want
    assert topology.undirected_edges(element_frame(spark, pair), 4).count() == len(want)


def test_boundary_of_two_tetrahedra(spark):
    pair = element_frame(spark, [(0, 1, 2, 3), (1, 2, 3, 4)])
    faces = {(r["n0"], r["n1"], r["n2"]) for r in topology.boundary_faces(pair).collect()}
    assert len(faces) == 6 and (1, 2, 3) not in faces
    nodes = node_frame(spark, [*CORNERS, (1, 1, 1), (9, 9, 9)], lambda p: (0, 0, 0))
    flags = {r["node_id"]: r["is_surface"] for r in topology.mark_surface(nodes, pair).collect()}
    assert flags == {**{i: True for i in range(5)}, 5: False}


def test_face_masks_are_strict_and_ignore_flat_axes(spark):
    points = [(0, 0, 0), (0.02, 0, 0), (0.019, 0, 0), (1, 0, 0)]
    nodes = node_frame(spark, points, lambda p: (0, 0, 0))
    faces = spark.createDataFrame([(1, "x_min", "y_max")], "sample_id long, a string, b string")
    rows = topology.mark_faces(nodes, faces, {"on_a": "a", "on_b": "b"}).orderBy("node_id").collect()
    assert [r["on_a"] for r in rows] == [True, False, True, False]
    assert not any(r["on_b"] for r in rows)
    wide = spark.createDataFrame(
        [(1, "x_min", 10.0, 1.0, 1.0)], "sample_id long, a string, dx double, dy double, dz double"
    )
    rows = topology.mark_faces(nodes, wide, {"on": "a"}, extents=("dx", "dy", "dz")).orderBy("node_id")
    assert [r["on"] for r in rows.collect()] == [True, True, True, False]


def test_force_lumping_without_loaded_nodes(spark):
    nodes = node_frame(spark, CORNERS, lambda p: (0, 0, 0)).withColumn("is_loaded", F.lit(False))
    loads = spark.createDataFrame(
        [(1, 1.0, 0.0, 0.0, 5.0)], "sample_id long, dir_x double, dir_y double, dir_z double, magnitude double"
    )
    assert topology.lump_forces(nodes, loads).agg(F.sum("fx")).first()[0] == 0


def test_element_to_node_average_weights_by_volume(spark):
    elements = spark.createDataFrame(
        [(1, 0, [0, 1, 2, 3], 1.0, 10.0), (1, 1, [1, 2, 3, 4], 3.0, 20.0)],
        "sample_id long, elem_id long, nodes array<long>, volume double, v double",
    )
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "sample_id long, node_id long")
    got = {r["node_id"]: r["v"] for r in gather.element_to_node(elements, nodes, ["v"]).collect()}
    assert got == {0: 10.0, 1: 17.5, 2: 17.5, 3: 17.5, 4: 20.0, 5: 0.0}


def test_coherence_rejects_other_element_widths(spark):
    nodes = node_frame(spark, CORNERS, lambda p: (0, 0, 0))
    with pytest.raises(ValueError):
        coherence.recomputed_von_mises(element_frame(spark, [(0, 1, 2)]), nodes, 3, Material())
    with pytest.raises(Exception, match="unsupported element width"):
        coherence.recomputed_von_mises(element_frame(spark, [(0, 1, 2)]), nodes, 4, Material()).collect()


def test_coherence_of_a_silent_solver_passes(spark):
    pairs = spark.createDataFrame(
        [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.2, 1.0)], "sample_id long, vm double, solver_vm double"
    )
    got = {r["sample_id"]: r for r in coherence.by_element_pairs(pairs, 0.05).collect()}
    assert got[1]["coherence_pass"] and got[1]["coherence_error"] == 0
    assert not got[2]["coherence_pass"] and math.isclose(got[2]["coherence_error"], 0.2)


# --- hop counts against brute force -----------------------------------------------


def grid_edges(shape):
    nodes = list(itertools.product(*map(range, shape)))
    index = {n: i for i, n in enumerate(nodes)}
    pairs = []
    for n in nodes:
        for axis in range(len(shape)):
            other = tuple(c + (i == axis) for i, c in enumerate(n))
            if other in index:
                pairs += [(index[n], index[other]), (index[other], index[n])]
    return len(nodes), pairs


def distances(n, pairs):
    dist = np.full((n, n), np.inf)
    np.fill_diagonal(dist, 0)
    for a, b in pairs:
        dist[a, b] = 1
    for k in range(n):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
    return dist


def graph_frames(spark, graphs):
    nodes = [(s, i) for s, (n, _) in graphs.items() for i in range(n)]
    edges = [(s, a, b) for s, (_, pairs) in graphs.items() for a, b in pairs]
    return (
        spark.createDataFrame(nodes, "sample_id long, node_id long"),
        spark.createDataFrame(edges, "sample_id long, src long, dst long"),
    )


def test_hops_to_nearest_source_match_all_pairs(spark):
    graphs = {1: grid_edges((4, 3)), 2: grid_edges((7,)), 3: (3, [(0, 1), (1, 0)])}
    nodes, edges = graph_frames(spark, graphs)
    flagged = nodes.withColumn("near", F.col("node_id") % 5 == 0).withColumn(
        "never", F.lit(False)
    )
    got = hops.hops_to_sources(flagged, edges, {"h": "near", "h2": "never"}).collect()
    for row in got:
        n, pairs = graphs[row["sample_id"]]
        best = distances(n, pairs)[row["node_id"], [i for i in range(n) if i % 5 == 0]].min()
        assert row["h"] == (n if np.isinf(best) else best)
        assert row["h2"] == n
    assert len(got) == sum(n for n, _ in graphs.values())


def test_diameter_of_trees_grids_and_disconnected_samples(spark):
    graphs = {1: grid_edges((9,)), 2: grid_edges((4, 4)), 3: (2, [(0, 1), (1, 0)]), 4: (3, [(0, 1), (1, 0)])}
    nodes, edges = graph_frames(spark, graphs)
    every = {r[0]: r[1] for r in hops.graph_diameter(nodes, edges, universe="all").collect()}
    assert every == {1: 8, 2: 6, 3: 1, 4: -1}
    used = {r[0]: r[1] for r in hops.graph_diameter(nodes, edges, universe="used").collect()}
    assert used[4] == 1
    linked = {r[0]: r[1] for r in hops.connectivity(nodes, edges).collect()}
    assert linked == {1: True, 2: True, 3: True, 4: False}


def test_single_node_has_diameter_zero(spark):
    nodes = spark.createDataFrame([(1, 0)], "sample_id long, node_id long")
    edges = spark.createDataFrame([], "sample_id long, src long, dst long")
    assert hops.graph_diameter(nodes, edges, universe="all").first()["graph_diameter"] == 0


def test_a_hop_shuffles_its_frontier_only(spark, tmp_path):
    edges = spark.createDataFrame([(1, i, j) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30], "sample_id long, src long, dst long")
    spark.createDataFrame([(1, 1, 0)], "sample_id long, bits long, node_id long").write.parquet(f"{tmp_path}/frontier")
    with hops.neighbour_lists(edges) as lists:
        reached = hops.next_nodes(spark.read.parquet(f"{tmp_path}/frontier"), lists.now)
        plan = reached._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort " not in plan
        assert [tuple(r) for r in reached.collect()] == [(1, 1, 1)]


def test_diameter_of_samples_without_edges(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)], "sample_id long, node_id long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "sample_id long, src long, dst long")
    out = {r["sample_id"]: r["graph_diameter"] for r in hops.graph_diameter(nodes, edges).collect()}
    assert out == {1: 1, 2: 0, 3: -1}


def test_lists_of_finished_samples_are_dropped_in_place(spark):
    """One long chain among forty short ones: later hops read its lists alone, still without moving them."""
    graphs = {i: grid_edges((4,)) for i in range(40)} | {99: grid_edges((13,))}
    nodes, edges = graph_frames(spark, graphs)
    with hops.neighbour_lists(edges) as lists:
        found = hops.breadth_first(lists, nodes.where("node_id = 0").selectExpr("sample_id", "node_id", "1L AS bits"))
        assert found.where("sample_id = 99").count() == 13 and found.count() == 173
        assert lists.samples == 1 and lists.now.count() == 13 and lists.whole.count() == 173
        frontier = found.select("sample_id", "node_id", "bits")
        plan = hops.next_nodes(frontier, lists.now)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort " not in plan


def random_graph(rng, n, extra):
    pairs = [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(extra)]
    return n, [p for a, b in pairs if a != b for p in ((a, b), (b, a))]


def test_exact_diameter_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hops, "WORD", 4)  # several rounds of starts on small graphs
    rng = random.Random(4)
    ring = [p for i in range(7) for p in ((i, (i + 1) % 7), ((i + 1) % 7, i))]
    graphs = {1: grid_edges((5,)), 2: grid_edges((2, 3)), 3: (7, ring), 4: (5, [(0, 1), (1, 0), (2, 3), (3, 2)]), 5: (1, []), 6: (2, [])}
    graphs |= {10 + i: random_graph(rng, n, i) for i, n in enumerate((2, 4, 5, 8))}
    nodes, edges = graph_frames(spark, graphs)
    most = {s: distances(n, pairs).max() for s, (n, pairs) in graphs.items()}
    want = {s: -1 if np.isinf(d) else int(d) for s, d in most.items()}
    got = {r["sample_id"]: (r["diameter"], r["exact"]) for r in hops.exact_diameter(nodes, edges, universe="all").collect()}
    assert got == {s: (d, True) for s, d in want.items()}
    few = {r["sample_id"]: (r["diameter"], r["exact"]) for r in hops.exact_diameter(nodes, edges, universe="all", most_starts=4).collect()}
    # No sweep of a ring bounds another node by its diameter: four starts leave it open, and say so.
    assert few[3] == (3, False) and all(few[s][0] <= want[s] for s in few)
    assert all(few[s][0] == want[s] for s in few if few[s][1])


@pytest.mark.parametrize("mixed", [False, True])
def test_contraction_of_a_long_chain_takes_few_rounds(spark, mixed):
    n, ids = 10_000, list(range(10_000))
    if mixed:
        random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(1, ids[i], ids[i + 1]) for i in range(n - 1) if i != 6999], "sample_id long, src long, dst long")
    assert len(contraction.rounds(edges, 42)) <= 2 * math.log2(n)
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "sample_id long, node_id long")
    found = contraction.components(nodes, edges)
    got = {tuple(r) for r in contraction.component_sizes(found).collect()}
    assert got == {(1, min(ids[:7000]), 7000), (1, min(ids[7000:]), 3000)}


def test_components_of_odd_graphs(spark):
    edges = spark.createDataFrame([(1, 0, 0), (1, 2, 1), (1, 2, 1), (1, 9, 4), (1, 9, 5)], "sample_id long, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 3)], "sample_id long, node_id long")
    got = {(r[0], r[1]): r[2] for r in contraction.components(nodes, edges).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 3, (1, 4): 4, (1, 5): 4, (1, 6): 6, (2, 3): 3}
    none = contraction.components(nodes, edges.limit(0))
    assert none.where("component = node_id").count() == 8


def exchanged(df) -> list[str]:
    """What the plan moves, by the lines that say how."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_meshes_placed_by_sample_are_not_moved_again(spark):
    sf = "/root/testdata/sf0.001"
    elements, nodes = derived.mesh_elements(spark, sf), derived.mesh_nodes(spark, sf)
    for made in (strain.tet10_strains(elements, nodes), topology.build_graph(elements, nodes, "tet10"), derived.mesh_fields(spark, sf)):
        assert not [line for line in exchanged(made) if "node_id" in line or "elem_id" in line or "src" in line]


def test_nodes_of_variants_are_not_moved(spark):
    checked = strain_queries.spot_checks(spark, "/root/testdata/sf0.001")
    assert not [line for line in exchanged(checked) if "node_id" in line.split("hashpartitioning(")[-1].split("]")[0]]


def test_first_contraction_leaves_edges_where_they_lie(spark):
    elements = derived.mesh_elements(spark, "/root/testdata/sf0.001")
    edges = topology.clique_edges(elements, 10).selectExpr("sample_id", "src AS a", "dst AS b")
    pointed = contraction.pointers(edges, 42)
    assert not [line for line in exchanged(pointed) if "hashpartitioning(sample_id" in line]
    # Draws are aggregated by hash: nothing is sorted.
    assert "Sort" not in pointed._jdf.queryExecution().executedPlan().toString()
    merged = contraction.contracted(edges, contraction.store_once(pointed, "moves"))
    assert not [line for line in exchanged(merged) if ", a#" in line or ", b#" in line]


def test_hops_of_small_meshes_move_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    nodes, edges = derived.masked_nodes(spark, sf), topology.undirected_edges(topology.graph_nodes(derived.mesh_elements(spark, sf), "tet4"), 4)
    sizes = hops.store_once(hops.sample_sizes(nodes), "sizes")
    starts = hops.store_once(nodes.where("is_fixed").selectExpr("sample_id", "node_id", "1L AS bits"), "starts")
    with hops.neighbour_lists(edges, sizes) as lists:
        found = hops.breadth_first(lists, starts)
        assert lists.keys == ["sample_id"]
        assert not exchanged(hops.next_nodes(found.where("hops = 1"), lists.now).groupBy("sample_id", "node_id").count())
        near = {tuple(r) for r in found.select("sample_id", "node_id", "hops").collect()}
    monkeypatch.setattr(hops, "TASK_NODES", 5)  # too large for a task: spread by node
    with hops.neighbour_lists(edges, sizes) as lists:
        assert lists.keys == ["sample_id", "node_id"]
        assert near == {tuple(r) for r in hops.breadth_first(lists, starts).select("sample_id", "node_id", "hops").collect()}


def test_hops_of_small_samples_take_one_table(spark, monkeypatch):
    """Forty hops in some samples, one in others, an isolated start: one job's worth of tables, and the levels of hop by hop."""
    rng = random.Random(8)
    graphs = {i: grid_edges((1 + i % 3, 2 + i % 4)) for i in range(30)} | {40: grid_edges((41,)), 41: (3, [(0, 1), (1, 0)])}
    graphs |= {50 + i: random_graph(rng, 12, i) for i in range(8)}
    nodes, edges = graph_frames(spark, graphs)
    starts = nodes.where("node_id in (0, 2)").selectExpr("sample_id", "node_id", "if(node_id = 0, 1L, shiftleft(1L, 63)) AS bits")
    monkeypatch.setattr(hops, "SWEPT_ROWS", 7)  # samples are cut from the rows of a task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        with hops.neighbour_lists(edges, hops.sample_sizes(nodes)) as lists:
            found = hops.breadth_first(lists, starts)
            assert len(lists.names) <= 4
            got = sorted(tuple(r) for r in found.select("sample_id", "node_id", "bits", "hops").collect())
            frontier = found.where("hops = 0").select("sample_id", "node_id", "bits")
            assert not exchanged(hops.swept(lists, frontier))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with hops.neighbour_lists(edges) as lists:
        assert got == sorted(tuple(r) for r in hops.breadth_first(lists, starts).select("sample_id", "node_id", "bits", "hops").collect())
    assert {r[3] for r in got if r[0] == 40} == set(range(41)) and (41, 2, -(1 << 63), 0) in got


def test_dataset_rows_of_placed_fields_are_not_moved(spark):
    manifest, fields = training_queries.mesh_manifest(spark, "/root/testdata/sf0.001")
    stats = store_once(dataset.training_stats(manifest, fields, key="mesh_id"), "stats")
    nodes = dataset.node_table(manifest, fields, None, stats, "mesh_id", ["split"])
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    # Neither moved before nor after the variants multiply them: what is shuffled are manifest rows.
    assert not [line for line in exchanged(nodes) if "sample_id" in line or "REPARTITION" in line]
    assert "SelectedBucketsCount" in plan and set(nodes.columns) >= {"sample_id", "node_id", "split"}


def test_hops_over_elements_store_neither_edges_nor_lists(spark, monkeypatch):
    """Elements that lack nodes or hold one twice, a source off the mesh, one sample cut from the rows of a task after the other."""
    rng = random.Random(3)
    meshes = [(s, i, rng.sample(range(12), 3) + [rng.choice([None, 2, 7])]) for s in range(9) for i in range(4)]
    elements = spark.createDataFrame([*meshes, (9, 0, [1, 2, 8])], "sample_id long, elem_id long, nodes array<long>")
    nodes = spark.createDataFrame([(s, n, n % 5 == 0, n == 3) for s in range(11) for n in range(14)], "sample_id long, node_id long, a boolean, b boolean")
    cliques, flags = topology.Cliques(elements, 4), {"to_a": "a", "to_b": "b"}
    want = sorted(tuple(r) for r in hops.hops_to_sources(nodes, cliques.edges(), flags).collect())
    monkeypatch.setattr(whole, "SWEPT_ROWS", 25)
    with monkeypatch.context() as m:
        m.setattr(hops, "neighbour_lists", None)  # not called
        assert want == sorted(tuple(r) for r in hops.hops_to_sources(nodes, cliques, flags).collect())
    monkeypatch.setattr(whole, "SWEPT_ROWS", 2)  # too large to be taken whole
    assert want == sorted(tuple(r) for r in hops.hops_to_sources(nodes, cliques, flags).collect())


def test_graph_of_small_samples_equals_the_joins(spark, monkeypatch):
    """Nodes that come twice, lack a coordinate or are missing, elements that lack nodes, a null sample."""
    rng = random.Random(5)
    meshes = [(s, i, rng.sample(range(9), 3) + [rng.choice([None, 2, 7])]) for s in range(6) for i in range(4)]
    elements = spark.createDataFrame([*meshes, (9, 0, [1, 2]), (None, 1, [0, 1, 2, 3])], "sample_id long, elem_id long, nodes array<long>")
    rows = [(s, n, rng.random(), rng.random(), None if n == 7 else rng.random()) for s in range(10) for n in [*range(8), 2, 2]]
    nodes = spark.createDataFrame([*rows, (None, 0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0, 0.0)], "sample_id long, node_id long, x double, y double, z double")
    want = sorted(map(repr, topology.edge_features(topology.undirected_edges(elements, 4), nodes).collect()))
    monkeypatch.setattr(whole, "SWEPT_ROWS", 20)
    with monkeypatch.context() as m:
        m.setattr(topology, "edge_features", None)  # not called
        assert want == sorted(map(repr, topology.build_graph(elements, nodes).collect()))
    monkeypatch.setattr(whole, "SWEPT_ROWS", 2)  # too large to be taken whole
    assert want == sorted(map(repr, topology.build_graph(elements, nodes).collect()))


def test_strains_of_small_samples_equal_the_joins(spark):
    """Flat and repeated elements, repeated nodes, elements that lack nodes or hold eleven, null coordinates, displacements and keys."""
    rng = random.Random(11)
    point = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(s, n, *point()) for s in range(4) for n in range(14)] + [(5, n, *point()) for n in [*range(10), 3, 3]]
    rows += [(6, n, 0.0, 1.0, 2.0, *point()[:3]) for n in range(10)]
    rows += [(7, n, *(None if (n, k) in ((1, 1), (11, 3)) else v for k, v in enumerate(point()))) for n in range(12)]
    nodes = spark.createDataFrame(
        [*rows, (None, 0, *point()), (1, None, *point())],
        "sample_id long, node_id long, x double, y double, z double, ux double, uy double, uz double",
    )
    held = [(s, i, rng.sample(range(14), 10)) for s in range(4) for i in range(3)]
    held += [(0, 1, held[1][2]), (1, 0, rng.sample(range(14), 10)), (5, 0, list(range(10))), (6, 0, list(range(10)))]
    held += [(7, 0, list(range(10))), (7, 1, [0, *range(2, 11)]), (7, 2, [0, *range(3, 12)]), (2, 7, [*range(9)]), (2, 8, [*range(11)])]
    held += [(2, 9, [99, *range(10)]), (3, 9, [*range(9), None]), (3, None, list(range(2, 12))), (None, 0, list(range(10))), (8, 0, [1]), (3, 5, None)]
    elements = spark.createDataFrame(held, "sample_id long, elem_id long, nodes array<long>").withColumn("tag", F.col("elem_id") % 2)
    for keep in ([], ["nodes"], ["tag"]):
        joined = strain.tet10_strains(elements, nodes, keep, 0)
        made = strain.tet10_strains(elements, nodes, keep)
        assert joined.columns == made.columns and "MapInArrow" in made._jdf.queryExecution().toString()
        assert sorted(map(repr, made.collect())) == sorted(map(repr, joined.collect()))


def test_solved_elements_are_stored_where_they_lie(spark):
    solved = derived.solved_elements(spark, "/root/testdata/sf0.001", stored=["von_mises"])
    keys = derived.mesh_nodes(spark, "/root/testdata/sf0.001").select("sample_id", "node_id")
    averaged = gather.element_to_node(solved, keys, ["von_mises"])
    plan = averaged._jdf.queryExecution().executedPlan().toString()
    # Nothing is solved again, and neither elements nor nodes are moved.
    assert "MapInArrow" not in plan and "collect_list" not in plan and not [line for line in exchanged(averaged) if "node_id" in line]


def test_slice_profile_solves_its_meshes_once(spark):
    profile = report_queries.thickness_slice_profile(spark, "/root/testdata/sf0.001")
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "explode" not in plan  # of stored averages, read by bucket
    assert "SelectedBucketsCount" in plan


def test_mesh_fields_read_stored_stresses(spark):
    fields = derived.mesh_fields(spark, "/root/testdata/sf0.001")
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan and "SelectedBucketsCount" in plan
