"""Domain tables derived from the star-schema test tables.

Bases and variants come from ``orders``, unkeyed node fields from ``lineitem``,
tetrahedral meshes from ``part`` and manifest deliveries from ``events``. All
formulas are deterministic and grow with their source table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.config import DEFAULTS, FAMILIES, LoadScaling, Settings
from meshloom.functions.encode import base_id, mesh_size, scale_bucket
from meshloom.functions.stress import VOIGT, components, hooke, von_mises
from meshloom.operators.gather import element_to_node
from meshloom.operators.scaling import field_summary, load_variants
from meshloom.operators.strain import STRAINS, strain_parts, tet10_strains
from meshloom.operators.topology import corners, lump_forces, mark_faces, mark_surface
from meshloom.session import sample_parts, store_once, store_placed

# Order priority to geometry family.
PRIORITY_FAMILY = {
    "1-URGENT": "block_with_holes",
    "2-HIGH": "l_bracket",
    "3-MEDIUM": "elongated_bar",
    "4-NOT SPECIFIED": "plate_3d",
    "5-LOW": "block_with_fillet",
}
FACES = ("x_min", "x_max", "y_min", "y_max", "z_min", "z_max")
FIXTURE_CAP = 360.0e6
FIXTURE_LOADS = LoadScaling(peak_stress_cap=FIXTURE_CAP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(index: Column, names) -> Column:
    """``names[index]`` for an index known to be in range."""
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


def log_length(share: Column) -> Column:
    lo, hi = DEFAULTS.scale.length_range
    return F.exp(F.lit(math.log(lo)) + share * F.lit(math.log(hi) - math.log(lo)))


def bases(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULTS) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    family = F.lit(None).cast("string")
    for priority, name in PRIORITY_FAMILY.items():
        family = F.when(F.col("o_orderpriority") == priority, name).otherwise(family)
    length = log_length(F.col("o_totalprice") / 500000.0)
    ratio = F.lit(0.02) + F.lit(0.28) * ((F.col("o_custkey") % 1000) / 999.0)
    plain = o.select(
        F.col("o_orderkey").alias("base_id"),
        F.col("o_custkey").alias("tag"),
        base_id(F.col("o_orderkey")).alias("base_sample_id"),
        family.alias("geometry_family"),
        length.alias("characteristic_length"),
        ratio.alias("_ratio"),
    )
    bending = F.col("geometry_family").isin(*settings.gate.bending_families)
    return plain.select(
        "base_id", "tag", "base_sample_id", "geometry_family", "characteristic_length",
        scale_bucket(F.col("characteristic_length"), settings.scale).alias("scale_bucket"),
        mesh_size(F.col("characteristic_length"), settings.scale).alias("mesh_size"),
        F.when(bending, F.lit(0.05) * F.col("characteristic_length")).alias("governing_thickness"),
        F.when(F.col("geometry_family") == "l_bracket", F.col("_ratio")).alias("radius_ratio"),
        (F.col("tag") % 11 != 0).alias("coherence_pass"),
        (F.col("tag") % 13 == 0).alias("has_multihot_nodes"),
        (F.lit(1.1) + (F.col("tag") % 10) / 100.0).alias("solve_time_s"),
        (F.lit(3) + F.col("base_id") % 20).alias("graph_diameter"),
    )


def node_fields(spark: SparkSession, sf_dir: str, node: str | None = None) -> DataFrame:
    """Stress, displacement and von Mises rows per base; a node key only if ``node`` names it."""
    q, d, t = F.col("l_quantity"), F.col("l_discount") + 0.0, F.col("l_tax") + 0.0
    stress = [
        F.col("l_extendedprice"), F.lit(1000.0) * q, F.lit(1e5) * d, F.lit(1e5) * t,
        F.lit(1e3) * q * d, F.lit(1e3) * q * t,
    ]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("base_id"),
        *([F.col("l_linenumber").alias(node)] if node else []),
        *[s.alias(f"s_{v}") for s, v in zip(stress, VOIGT)],
        (F.lit(1e-5) * d).alias("ux"),
        (F.lit(1e-5) * t).alias("uy"),
        (F.lit(1e-5) * (q / 1000.0)).alias("uz"),
    )
    return rows.withColumn("von_mises", von_mises(components("s")))


def base_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = field_summary(node_fields(spark, sf_dir), "base_id", FIXTURE_LOADS.percentile)
    return bases(spark, sf_dir).join(summary, "base_id")


def variants(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The manifest of all load variants, accepted or not."""
    return load_variants(
        base_summaries(spark, sf_dir), FIXTURE_LOADS, settings.gate, settings.material
    )


def stored_variants(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The finished manifest (or ``columns`` of it) as a stored table, for steps that read it several times."""
    made = variants(spark, sf_dir)
    return store_once(made.select(*columns) if columns else made, "variants")


# --- meshes --------------------------------------------------------------------------

STRIDE = {0: 20000, 1: 200, 2: 2}
# The two inner corners of each tetrahedron along a cube's diagonal, as
# node-id offsets, one per order of walking the three axes.
WALKS = [(STRIDE[p[0]], STRIDE[p[0]] + STRIDE[p[1]]) for p in permutations(range(3))]


def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    # A row grows to hundreds of nodes and elements: the rows are spread while they are small, by sample, and what grows
    # from them is joined and grouped where it lies. A mesh has at most 108 elements, so a task's share is bounded.
    part = table(spark, sf_dir, "part")
    part = part.repartition(sample_parts(spark, part.count()), "p_partkey")
    return part.select(
        key.alias("sample_id"),
        (1 + size % 3).cast("int").alias("a"),
        (1 + key % 3).cast("int").alias("b"),
        (1 + key % 2).cast("int").alias("c"),
        (F.lit(0.05) * (1 + size / 50.0)).alias("h"),
    )


def _span(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def mesh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic tetrahedra: (sample_id, elem_id, nodes[10])."""
    walks = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.lit(d1).alias("d1"), F.lit(d2).alias("d2"))
            for t, (d1, d2) in enumerate(WALKS)
        ]
    )
    cells = (
        mesh_samples(spark, sf_dir)
        .withColumn("ci", _span(F.col("a")))
        .withColumn("cj", _span(F.col("b")))
        .withColumn("ck", _span(F.col("c")))
        .withColumn("w", F.explode(walks))
    )
    first = (2 * F.col("ci") * 10000 + 2 * F.col("cj") * 100 + 2 * F.col("ck")).cast("bigint")
    corner = [first, first + F.col("w.d1"), first + F.col("w.d2"), first + 20202]
    mids = [(corner[i] + corner[j]) / 2 for i, j in ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3))]
    return cells.select(
        "sample_id",
        (((F.col("ci") * 10 + F.col("cj")) * 10 + F.col("ck")) * 6 + F.col("w.t"))
        .cast("bigint")
        .alias("elem_id"),
        F.array(*[c.cast("bigint") for c in corner + mids]).alias("nodes"),
    )


def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the doubled grid with coordinates and an analytic displacement."""
    grid = mesh_samples(spark, sf_dir)
    for axis, size in (("i", "a"), ("j", "b"), ("k", "c")):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), 2 * F.col(size))))
    i, j, k, h = (F.col(n) for n in ("i", "j", "k", "h"))
    placed = grid.select(
        "sample_id",
        ((i * 100 + j) * 100 + k).cast("bigint").alias("node_id"),
        (h * (i + 0.3 * j + 0.1 * k) / 2.0).alias("x"),
        (h * (0.05 * i + 0.9 * j + 0.2 * k) / 2.0).alias("y"),
        (h * (0.15 * i + 1.1 * k) / 2.0).alias("z"),
    )
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return placed.select(
        "*",
        (F.lit(1e-3) * (2.0 * x - y + 0.5 * z) + F.lit(1e-2) * x * y).alias("ux"),
        (F.lit(1e-3) * (0.3 * x + y) + F.lit(2e-2) * z * z).alias("uy"),
        (F.lit(1e-3) * (x - z) + F.lit(1e-2) * x * z).alias("uz"),
    )


def mesh_bases(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One planned base per mesh: family, length, faces and load."""
    key = F.col("p_partkey")
    plain = table(spark, sf_dir, "part").select(
        key.alias("mesh_id"),
        base_id(key).alias("base_sample_id"),
        chosen(key % 5, FAMILIES).alias("geometry_family"),
        log_length((key * 7919 % 1000) / 1000.0).alias("characteristic_length"),
        chosen(key % 6, FACES).alias("load_face"),
        chosen((key / 6).cast("bigint") % 6, FACES).alias("fixed_face"),
    )
    bending = F.col("geometry_family").isin(*settings.gate.bending_families)
    length = F.col("characteristic_length")
    return plain.select(
        "*",
        scale_bucket(length, settings.scale).alias("scale_bucket"),
        F.when(bending, F.lit(0.05) * length).alias("governing_thickness"),
        F.when(
            F.col("geometry_family") == "l_bracket",
            F.lit(0.02) + F.lit(0.28) * ((F.col("mesh_id") % 1000) / 999.0),
        ).alias("radius_ratio"),
        (F.col("mesh_id") % 7 != 0).alias("coherence_pass"),
        *[F.lit(v).alias(n) for n, v in
          (("dir_x", 0.6), ("dir_y", 0.0), ("dir_z", 0.8), ("magnitude", 1000.0))],
    )


def masked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mesh nodes with ``is_loaded`` and ``is_fixed``."""
    faces = mesh_bases(spark, sf_dir).select(
        F.col("mesh_id").alias("sample_id"), "load_face", "fixed_face"
    )
    return mark_faces(
        mesh_nodes(spark, sf_dir), faces, {"is_loaded": "load_face", "is_fixed": "fixed_face"}
    )


def solved_elements(
    spark: SparkSession, sf_dir: str, settings: Settings = DEFAULTS, stored: Sequence[str] = ()
) -> DataFrame:
    """Elements with volume, Voigt stress and von Mises; ``nodes`` are the corners.

    With ``stored`` columns, these are stored where small samples lie: what is made of them isn't moved, and they are solved once.
    """
    elements, nodes = mesh_elements(spark, sf_dir), mesh_nodes(spark, sf_dir)
    parts = strain_parts(elements, nodes)
    strains = tet10_strains(elements, nodes, ["nodes"], parts)
    stress = hooke([F.col(e) for e in STRAINS], settings.material)
    solved = strains.select(
        "sample_id", "elem_id", corners("nodes").alias("nodes"), "volume",
        *[s.alias(f"s_{v}") for s, v in zip(stress, VOIGT)],
    ).withColumn("von_mises", von_mises(components("s")))
    if not stored:
        return solved
    solved = solved.select("sample_id", "elem_id", "nodes", "volume", *stored)
    return store_placed(solved, "solved", "sample_id", parts, lies=True) if parts else solved


def mesh_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full node table of the meshes: masks, forces, averaged stress, displacement."""
    loads = mesh_bases(spark, sf_dir).select(
        F.col("mesh_id").alias("sample_id"), "dir_x", "dir_y", "dir_z", "magnitude"
    )
    values = [*[f"s_{v}" for v in VOIGT], "von_mises"]
    elements = solved_elements(spark, sf_dir, stored=values)
    stressed = element_to_node(elements, lump_forces(masked_nodes(spark, sf_dir), loads), values)
    # The surface follows from connectivity alone: no need to solve the elements again.
    plain = mesh_elements(spark, sf_dir).select("sample_id", "elem_id", corners("nodes").alias("nodes"))
    return mark_surface(stressed, plain)
