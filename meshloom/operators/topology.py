"""Mesh topology: edges, boundary faces, face masks.

Element tables are (sample_id, elem_id, nodes ARRAY<BIGINT>), node tables are
(sample_id, node_id, x, y, z, …). Work is keyed by (sample, node), (sample, edge)
or (sample, face), so one giant mesh spreads over all tasks like many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.encode import face_axis, face_side
from meshloom.functions.stress import norm3
from meshloom.operators.ranking import binned_rank
from meshloom.operators.whole import are_long, by_sample, mesh_places, placed_edges, rows_of_places, stacked, whole_parts

CORNERS = 4
FACE_TOLERANCE = 0.02


def corners(nodes: Column | str) -> Column:
    """The corner nodes of a tet4 or tet10 element."""
    return F.slice(nodes, 1, CORNERS)


def graph_nodes(elements: DataFrame, mode: str) -> DataFrame:
    """Project quadratic elements to their corners in ``tet4`` mode."""
    if mode == "tet10":
        return elements
    return elements.withColumn("nodes", corners("nodes"))


def clique_edges(elements: DataFrame, width: int) -> DataFrame:
    """Every pair i < j of an element's ``width`` nodes, one row each.

    ``width`` is the fixed element width (4 or 10), so an element never yields
    more than 45 pairs.
    """
    return elements.select("sample_id", "nodes", _choices(width, 2)).select(
        "sample_id",
        F.get("nodes", F.col("pick")[0]).alias("src"),
        F.get("nodes", F.col("pick")[1]).alias("dst"),
    )


def _choices(width: int, size: int) -> Column:
    """Explode the ways to pick ``size`` of ``width`` local positions, in order."""
    picks = [F.array(*map(F.lit, c)) for c in combinations(range(width), size)]
    return F.explode(F.array(*picks)).alias("pick")


def undirected_edges(elements: DataFrame, width: int) -> DataFrame:
    """Distinct edges in both directions.

    Pairs are put in order and deduplicated before being mirrored, which halves the
    shuffle. A repeated node gives a self-loop, kept once.
    """
    once = clique_edges(elements, width).select(
        "sample_id",
        F.least("src", "dst").alias("lo"),
        F.greatest("src", "dst").alias("hi"),
    ).distinct()
    ends = [F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"))]
    back = F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(*ends)).otherwise(F.array(*ends, back))
    return once.select("sample_id", F.explode(both).alias("e")).select("sample_id", "e.*")


@dataclass(frozen=True)
class Cliques:
    """The :func:`undirected_edges` of elements, for steps that make them as they need them."""

    elements: DataFrame
    width: int

    def edges(self) -> DataFrame:
        return undirected_edges(self.elements, self.width)


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relative position and distance of each directed edge, as float32."""
    point = ["x", "y", "z"]
    tail = nodes.select(
        "sample_id", F.col("node_id").alias("src"), *[F.col(c).alias(f"s{c}") for c in point]
    )
    head = nodes.select(
        "sample_id", F.col("node_id").alias("dst"), *[F.col(c).alias(f"d{c}") for c in point]
    )
    delta = [F.col(f"d{c}") - F.col(f"s{c}") for c in point]
    return (
        edges.join(tail, ["sample_id", "src"])
        .join(head, ["sample_id", "dst"])
        .select(
            "sample_id",
            "src",
            "dst",
            *[d.cast("float").alias(f"d{c}") for c, d in zip(point, delta)],
            norm3(*delta).cast("float").alias("distance"),
        )
    )


def build_graph(elements: DataFrame, nodes: DataFrame, mode: str = "tet4") -> DataFrame:
    """Edges with their features. Small samples are taken whole, where they lie; larger ones are joined."""
    width = 10 if mode == "tet10" else CORNERS
    cliques = Cliques(graph_nodes(elements, mode), width)
    made = whole_graph(cliques, nodes)
    return edge_features(cliques.edges(), nodes) if made is None else made


def whole_graph(cliques: Cliques, nodes: DataFrame) -> DataFrame | None:
    """:func:`edge_features` of edges that a task makes, keeps and forgets some thousand rows at a time; None where a sample is too large
    for that, or columns are of other types."""
    point = ["x", "y", "z"]
    kinds = {df.schema["sample_id"].dataType.simpleString() for df in (cliques.elements, nodes)}
    doubles = all(nodes.schema[c].dataType.simpleString() == "double" for c in point)
    if len(kinds) > 1 or not doubles or not are_long((cliques.elements, "nodes"), (nodes, "node_id")):
        return None
    rows = stacked(
        cliques.elements.select("sample_id", "nodes").where("nodes is not null"),
        nodes.select("sample_id", "node_id", *point).where("node_id is not null"),
    )
    parts = whole_parts(rows)
    if not parts:
        return None
    numbered, edges, met = mesh_places(cliques.width), placed_edges(), rows_of_places()

    def step(table: pa.Table) -> pa.Table:
        sample, _, own, first, matrix, held, names = numbered(table)
        src, dst = edges(matrix, len(names))
        at, tail, head = met(first, len(names), src, dst)
        columns = {"sample_id": sample.dictionary.take(pa.array(held[src[at]])), "src": names[src[at]], "dst": names[dst[at]]}
        square, lacking = 0.0, None
        for c in point:
            values = table[c].combine_chunks().filter(pa.array(own))
            known = values.to_numpy(zero_copy_only=False)
            delta = known[head] - known[tail]
            null = None
            if values.null_count:
                none = values.is_null().to_numpy(zero_copy_only=False)
                null = none[head] | none[tail]
                lacking = null if lacking is None else lacking | null
            columns[f"d{c}"] = pa.array(delta.astype(np.float32), mask=null)
            square = square + delta * delta
        columns["distance"] = pa.array(np.sqrt(square).astype(np.float32), mask=lacking)
        return pa.table(columns)

    return by_sample(rows, parts, step, f"sample_id {kinds.pop()}, src long, dst long, dx float, dy float, dz float, distance float")


def node_positions(nodes: DataFrame, width: int = 4096) -> DataFrame:
    """0-based position of each node within its sample, by node id.

    Ids are ranked in blocks of ``width`` consecutive ids, so a giant mesh is not
    sorted in one task.
    """
    block = F.floor(F.col("node_id") / width)
    ranked = binned_rank(
        nodes.select("sample_id", "node_id"), ["sample_id"], [F.col("node_id")], block, "_rank"
    )
    return ranked.select("sample_id", "node_id", (F.col("_rank") - 1).alias("position"))


def positional_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with node ids replaced by positions."""
    for end in ("src", "dst"):
        lookup = positions.select("sample_id", F.col("node_id").alias(end), "position")
        edges = edges.join(lookup, ["sample_id", end]).drop(end).withColumnRenamed("position", end)
    return edges


def element_faces(elements: DataFrame) -> DataFrame:
    """The four triangles of each tetrahedron as sorted node triples."""
    picked = elements.select("sample_id", "nodes", _choices(CORNERS, 3)).select(
        "sample_id", *[F.get("nodes", F.col("pick")[i]).alias(f"p{i}") for i in range(3)]
    )
    ends = [F.least("p0", "p1", "p2"), F.greatest("p0", "p1", "p2")]
    middle = F.col("p0") + F.col("p1") + F.col("p2") - ends[0] - ends[1]
    return picked.select("sample_id", ends[0].alias("n0"), middle.alias("n1"), ends[1].alias("n2"))


def boundary_faces(elements: DataFrame) -> DataFrame:
    """Triangles that belong to exactly one tetrahedron."""
    return (
        element_faces(elements)
        .groupBy("sample_id", "n0", "n1", "n2")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where(F.col("uses") == 1)
        .drop("uses")
    )


def surface_nodes(elements: DataFrame) -> DataFrame:
    return (
        boundary_faces(elements)
        .select("sample_id", F.explode(F.array("n0", "n1", "n2")).alias("node_id"))
        .distinct()
    )


def mark_surface(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Add ``is_surface`` to every node, touched by an element or not."""
    flagged = surface_nodes(elements).withColumn("_on", F.lit(True))
    return (
        nodes.join(flagged, ["sample_id", "node_id"], "left")
        .withColumn("is_surface", F.coalesce("_on", F.lit(False)))
        .drop("_on")
    )


def bounding_boxes(nodes: DataFrame) -> DataFrame:
    aggs = []
    for c in ("x", "y", "z"):
        aggs += [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    return nodes.groupBy("sample_id").agg(*aggs)


def mark_faces(
    nodes: DataFrame,
    faces: DataFrame,
    named: dict[str, str],
    tolerance: float = FACE_TOLERANCE,
    extents: Sequence[str] | None = None,
) -> DataFrame:
    """Add a boolean per entry of ``named`` (mask column -> face-name column of ``faces``).

    ``faces`` has one row per sample. A node lies on a face when it is strictly
    within ``tolerance`` × extent of that side. ``extents`` names columns of ``faces``
    with given box dimensions; by default the extent is measured.
    """
    box = bounding_boxes(nodes).join(faces, "sample_id")
    axes = ("x", "y", "z")

    def pick(axis: Column, columns: list[Column]) -> Column:
        return F.when(axis == 0, columns[0]).when(axis == 1, columns[1]).when(axis == 2, columns[2])

    limits = []
    for mask, face in named.items():
        axis = face_axis(F.col(face))
        low = pick(axis, [F.col(f"{c}_lo") for c in axes])
        high = pick(axis, [F.col(f"{c}_hi") for c in axes])
        extent = pick(axis, [F.col(c) for c in extents]) if extents else high - low
        side = face_side(F.col(face))
        margin = F.lit(tolerance) * extent
        limits.append(
            F.struct(
                axis.alias("axis"),
                (side == "min").alias("at_min"),
                F.when(side == "min", low + margin).otherwise(high - margin).alias("limit"),
            ).alias(f"_{mask}")
        )
    # A row a sample: hashed, so nodes aren't sorted.
    joined = nodes.join(box.select("sample_id", *limits).hint("shuffle_hash"), "sample_id")
    for mask in named:
        spec = F.col(f"_{mask}")
        at = pick(spec["axis"], [F.col(c) for c in axes])
        on = F.when(spec["at_min"], at < spec["limit"]).otherwise(at > spec["limit"])
        joined = joined.withColumn(mask, F.coalesce(on, F.lit(False))).drop(f"_{mask}")
    return joined


def multihot_samples(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("sample_id").agg(
        F.bool_or(F.col("is_fixed") & F.col("is_loaded")).alias("has_multihot_nodes")
    )


def mesh_counts(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    n = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = elements.groupBy("sample_id").agg(F.count(F.lit(1)).alias("element_count"))
    return n.join(e, "sample_id", "left").withColumn(
        "element_count", F.coalesce("element_count", F.lit(0))
    )


def lump_forces(nodes: DataFrame, loads: DataFrame) -> DataFrame:
    """Share magnitude × direction equally over a sample's loaded nodes.

    ``loads``: one row per sample (dir_x, dir_y, dir_z, magnitude).
    """
    share = (
        nodes.groupBy("sample_id")
        .agg(F.count_if("is_loaded").alias("_n"))
        .join(loads, "sample_id")
        .select(
            "sample_id",
            *[
                F.when(F.col("_n") > 0, F.col(f"dir_{c}") * F.col("magnitude") / F.col("_n")).alias(
                    f"_f{c}"
                )
                for c in ("x", "y", "z")
            ],
        )
    )
    joined = nodes.join(share, "sample_id")
    for c in ("x", "y", "z"):
        force = F.when(F.col("is_loaded"), F.col(f"_f{c}")).otherwise(0.0)
        joined = joined.withColumn(f"f{c}", F.coalesce(force, F.lit(0.0)))
    return joined.drop("_fx", "_fy", "_fz")
