"""Tables of design points: which bases to generate and with which parameters.

Every draw is a stateless function of (seed, base id, draw name): a plan can be
rebuilt in any order and resumed by an anti-join on ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.config import (
    BarRanges,
    FilletBlockRanges,
    HoleBlockRanges,
    LBracketRanges,
    PlateRanges,
    Sampling,
    Scale,
    Settings,
)
from meshloom.config import BUCKETS, FAMILIES
from meshloom.functions import geometry as geo
from meshloom.functions.encode import base_id, mesh_size, scale_bucket, valid_faces
from meshloom.functions.uniform import (
    between,
    integer_between,
    log_between,
    shuffle_key,
    uniform,
    unit_direction,
)
from meshloom.operators.reports import stratum_shortfalls
from meshloom.operators.slots import free_slots

FREE = "~free"
#: Streams of ids: one a stratum and one for free draws.
STREAMS = len(FAMILIES) * len(BUCKETS) + 1


def free_length(seed: int, key: str, scale: Scale) -> Column:
    return log_between(uniform(seed, key, "length"), *scale.length_range)


def bucket_length(seed: int, key: str, scale: Scale, bucket: str) -> Column:
    """Log-uniform length inside the bucket named by a column."""
    edges = {name: scale.edges[i : i + 2] for i, name in enumerate(scale.buckets)}

    def edge(i: int) -> Column:
        pick = reduce(
            lambda acc, item: acc.when(F.col(bucket) == item[0], float(item[1][i])),
            edges.items(),
            F.when(F.lit(False), 0.0),
        )
        return pick

    return log_between(uniform(seed, key, "length"), edge(0), edge(1))


def weighted_family(u: Column, weights: tuple[float, ...]) -> Column:
    """The family whose cumulative weight interval holds ``u``."""
    total, reached, pick = sum(weights), 0.0, None
    for name, w in list(zip(FAMILIES, weights))[:-1]:
        reached += w / total
        pick = F.when(u < reached, name) if pick is None else pick.when(u < reached, name)
    return pick.otherwise(FAMILIES[-1])


def stream_number(family: Column, bucket: Column) -> Column:
    """The fixed number of a stratum's stream of ids; free draws have the number after the last."""
    names = [F.lit(f"{f}/{b}") for f in FAMILIES for b in BUCKETS] + [F.lit(f"{FREE}/{FREE}")]
    return (F.array_position(F.array(*names), F.concat_ws("/", family, bucket)) - 1).cast("bigint")


def used_slots(manifest: DataFrame) -> DataFrame:
    """(stream, slot) of the completed ids. Ids that end in no number take no slot."""
    number = F.substring_index("base_sample_id", "_", -1).try_cast("bigint")
    return manifest.select(number.alias("_number")).where("_number is not null").select(
        F.pmod("_number", F.lit(STREAMS)).alias("stream"), F.floor(F.col("_number") / STREAMS).alias("slot")
    )


def stratum_plan(
    manifest: DataFrame, sampling: Sampling, scale: Scale, floor: Column | int, extra: Column | int
) -> DataFrame:
    """New bases: every stratum is filled up to ``floor``, then ``extra`` free draws.

    Base number = slot * ``STREAMS`` + stream, so an id belongs to one stratum for good. A
    stratum gets its first slots that no completed id holds: failed or skipped ids below the
    largest are planned again, under the same id and so with the same draws. ``floor`` and ``extra``
    may be scalar subqueries over the manifest.
    """
    stream = stream_number(F.col("geometry_family"), F.col("scale_bucket"))
    short = stratum_shortfalls(manifest, floor).select(
        "geometry_family", "scale_bucket", F.col("shortfall").cast("bigint").alias("n")
    )
    free = manifest.sparkSession.range(1).select(
        F.lit(FREE).alias("geometry_family"),
        F.lit(FREE).alias("scale_bucket"),
        (extra if isinstance(extra, Column) else F.lit(extra)).cast("bigint").alias("n"),
    )
    strata = short.unionByName(free).withColumn("stream", stream)
    slots = free_slots(used_slots(manifest), strata.select("stream", "n"), "stream", "n")
    named = strata.drop("n")  # a row a stratum
    rows = slots.join(F.broadcast(named), "stream").withColumn(
        "base_sample_id", base_id(F.col("slot") * STREAMS + F.col("stream"))
    )
    is_free = F.col("geometry_family") == FREE
    u = uniform(sampling.seed, "base_sample_id", "family")
    length = F.when(is_free, free_length(sampling.seed, "base_sample_id", scale)).otherwise(
        bucket_length(sampling.seed, "base_sample_id", scale, "scale_bucket")
    )
    return (
        rows.withColumn("characteristic_length", length)
        .withColumn(
            "scale_bucket",
            F.when(is_free, scale_bucket(F.col("characteristic_length"), scale)).otherwise(
                F.col("scale_bucket")
            ),
        )
        .withColumn(
            "geometry_family",
            F.when(is_free, weighted_family(u, sampling.family_weights)).otherwise(
                F.col("geometry_family")
            ),
        )
        .select(
            "base_sample_id",
            "geometry_family",
            "scale_bucket",
            "characteristic_length",
            mesh_size(F.col("characteristic_length"), scale).alias("mesh_size"),
        )
    )


# --- shape parameters ------------------------------------------------------------


class _Draws:
    """Named draws of one base."""

    def __init__(self, seed: int, key: str) -> None:
        self._seed, self._key = seed, key

    def u(self, name: str | Column) -> Column:
        return uniform(self._seed, self._key, name)

    def real(self, name: str | Column, bounds: tuple[float, float]) -> Column:
        return between(self.u(name), *bounds)

    def whole(self, name: str, bounds: tuple[int, int]) -> Column:
        return integer_between(self.u(name), *bounds)

    def each(self, count: Column, build) -> Column:
        """``build(i)`` for i = 1..count; empty when count is 0."""
        items = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), build)
        return F.slice(items, 1, count)

    def nth(self, name: str, i: Column) -> Column:
        return F.concat(F.lit(name), i.cast("string"))


def hole_block_params(seed: int, key: str, r: HoleBlockRanges) -> Column:
    d = _Draws(seed, key)
    dims = [d.real(f"dim{i}", r.base_dims) for i in range(3)]
    count = d.whole("hole_count", r.hole_count)
    min_face = F.least(dims[0], dims[1])

    def hole(i: Column) -> Column:
        axis = integer_between(d.u(d.nth("axis", i)), 0, 2)
        fraction = d.real(d.nth("radius", i), r.hole_radius_fraction)

        def centre(a: int) -> Column:
            margin = F.least(F.lit(1.5) * fraction * min_face / dims[a], F.lit(0.4))
            at = margin + d.u(d.nth(f"centre{a}_", i)) * (F.lit(1.0) - margin - margin)
            return F.when(axis != a, at)

        return F.struct(
            axis.alias("axis"),
            fraction.alias("radius_fraction"),
            *[centre(a).alias(f"centre_{n}") for a, n in enumerate("xyz")],
        )

    return F.struct(
        *[x.alias(f"dim_{n}") for x, n in zip(dims, "xyz")],
        count.alias("hole_count"),
        d.each(count, hole).alias("holes"),
    )


def l_bracket_params(seed: int, key: str, r: LBracketRanges) -> Column:
    d = _Draws(seed, key)
    return F.struct(
        d.real("aspect_w", r.block_aspect).alias("width_aspect"),
        d.real("aspect_d", r.block_aspect).alias("depth_aspect"),
        d.real("notch_d", r.notch_depth_fraction).alias("notch_depth_fraction"),
        d.real("notch_w", r.notch_width_fraction).alias("notch_width_fraction"),
        d.real("ratio", r.radius_ratio).alias("radius_ratio"),
    )


def _optional_holes(d: _Draws, probability: float, bounds: tuple[int, int]) -> Column:
    return F.when(d.u("has_holes") < probability, d.whole("hole_count", bounds)).otherwise(0)


def bar_params(seed: int, key: str, r: BarRanges) -> Column:
    d = _Draws(seed, key)
    count = _optional_holes(d, r.hole_probability, r.hole_count)
    return F.struct(
        d.real("aspect", r.aspect_ratio).alias("aspect_ratio"),
        d.real("cross", r.cross_section_aspect).alias("cross_section_aspect"),
        count.alias("hole_count"),
        d.each(
            count,
            lambda i: F.struct(
                d.real(d.nth("position", i), r.hole_position).alias("position_fraction"),
                d.real(d.nth("radius", i), r.hole_radius).alias("radius_fraction"),
            ),
        ).alias("holes"),
    )


def plate_params(seed: int, key: str, r: PlateRanges) -> Column:
    d = _Draws(seed, key)
    count = _optional_holes(d, r.hole_probability, r.hole_count)
    return F.struct(
        d.real("thickness", r.thickness_fraction).alias("thickness_fraction"),
        d.real("width", r.width_length_ratio).alias("width_length_ratio"),
        count.alias("hole_count"),
        d.each(
            count,
            lambda i: F.struct(
                d.real(d.nth("hole_x", i), r.hole_position).alias("x_fraction"),
                d.real(d.nth("hole_y", i), r.hole_position).alias("y_fraction"),
                d.real(d.nth("radius", i), r.hole_radius).alias("radius_fraction"),
            ),
        ).alias("holes"),
    )


def fillet_block_params(seed: int, key: str, r: FilletBlockRanges) -> Column:
    d = _Draws(seed, key)
    count = d.whole("num_fillets", r.num_fillets)
    mixed = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(r.edge_count - 1)),
            lambda e: F.struct(
                shuffle_key(seed, key, d.nth("edge", e)).alias("digest"), e.alias("edge")
            ),
        )
    )
    edges = F.array_sort(F.transform(F.slice(mixed, 1, count), lambda s: s["edge"]))
    return F.struct(
        *[d.real(f"aspect{i}", r.block_aspect).alias(f"aspect_{n}") for i, n in enumerate("xyz")],
        d.real("fillet", r.fillet_radius_fraction).alias("fillet_radius_fraction"),
        count.alias("num_fillets"),
        edges.alias("fillet_edges"),
    )


def shape_params(family: str, settings: Settings, key: str = "base_sample_id") -> Column:
    """Parameter struct of one family. New families are added to this table."""
    seed = settings.sampling.seed
    builders = {
        "block_with_holes": lambda: hole_block_params(seed, key, settings.hole_block),
        "l_bracket": lambda: l_bracket_params(seed, key, settings.l_bracket),
        "elongated_bar": lambda: bar_params(seed, key, settings.bar),
        "plate_3d": lambda: plate_params(seed, key, settings.plate),
        "block_with_fillet": lambda: fillet_block_params(seed, key, settings.fillet_block),
    }
    return builders[family]()


def with_shape_params(plan: DataFrame, settings: Settings) -> DataFrame:
    """One struct column per family, null for rows of other families."""
    return plan.withColumns(
        {
            f: F.when(F.col("geometry_family") == f, shape_params(f, settings))
            for f in FAMILIES
        }
    )


def with_thickness(plan: DataFrame) -> DataFrame:
    """Governing thickness of bending families from their parameters, null for bulk."""
    length = F.col("characteristic_length")
    largest = F.array_max(F.transform("elongated_bar.holes", lambda h: h["radius_fraction"]))
    bar = geo.bar_thickness(
        length,
        F.col("elongated_bar.aspect_ratio"),
        F.col("elongated_bar.cross_section_aspect"),
        largest,
    )
    plate = geo.plate_thickness(length, F.col("plate_3d.thickness_fraction"))
    family = F.col("geometry_family")
    return plan.withColumn(
        "governing_thickness", F.when(family == "elongated_bar", bar).when(family == "plate_3d", plate)
    )


def with_bracket_fillet(plan: DataFrame) -> DataFrame:
    """Section depth, fillet radius and feasibility of brackets."""
    p, length = F.col("l_bracket"), F.col("characteristic_length")
    radius = geo.bracket_fillet_radius(
        length, p["width_aspect"], p["notch_depth_fraction"], p["notch_width_fraction"],
        p["radius_ratio"],
    )
    return plan.withColumns(
        {
            "section_depth": geo.section_depth(length, p["notch_depth_fraction"]),
            "fillet_radius": radius,
            "fillet_resolved": geo.fillet_is_resolved(radius, F.col("mesh_size")),
        }
    )


def with_block_fillet(plan: DataFrame) -> DataFrame:
    p = F.col("block_with_fillet")
    smallest = F.least(p["aspect_x"], p["aspect_y"], p["aspect_z"]) * F.col("characteristic_length")
    radius = geo.block_fillet_radius(smallest, p["fillet_radius_fraction"])
    return plan.withColumns(
        {
            "block_fillet_radius": radius,
            "block_fillet_applied": geo.block_fillet_applied(radius, F.col("mesh_size")),
        }
    )


# --- faces and direction -----------------------------------------------------------


def load_face(seed: int, key: str, faces: Column) -> Column:
    """Uniform choice among valid faces; an error when there is none."""
    usable = valid_faces(faces)
    index = F.floor(uniform(seed, key, "load_face") * F.size(usable)).cast("int")
    missing = F.raise_error(F.concat(F.lit("no valid face for "), F.col(key)))
    return F.when(F.size(usable) > 0, F.get(usable, index)).otherwise(missing)


def fixed_face(seed: int, key: str, faces: Column, loaded: Column) -> Column:
    """Uniform choice among the other valid faces, else the loaded face itself."""
    others = F.filter(valid_faces(faces), lambda f: f != loaded)
    index = F.floor(uniform(seed, key, "fixed_face") * F.size(others)).cast("int")
    return F.when(F.size(others) > 0, F.get(others, index)).otherwise(loaded)


def with_boundary_conditions(plan: DataFrame, seed: int, faces: str = "faces") -> DataFrame:
    direction = unit_direction(seed, "base_sample_id")
    picked = plan.withColumn("load_face", load_face(seed, "base_sample_id", F.col(faces)))
    return (
        picked.withColumn(
            "fixed_face", fixed_face(seed, "base_sample_id", F.col(faces), F.col("load_face"))
        )
        .withColumn("_dir", direction)
        .withColumns({f"load_dir_{c}": F.col(f"_dir.{c}") for c in "xyz"})
        .drop("_dir")
    )


def manifest_rows(plan: DataFrame) -> DataFrame:
    """Flat manifest columns of a planned base; radius fields for brackets only."""
    bracket = F.col("geometry_family") == "l_bracket"
    return plan.select(
        "base_sample_id", "geometry_family", "characteristic_length", "scale_bucket", "mesh_size",
        "fixed_face", "load_face", "load_dir_x", "load_dir_y", "load_dir_z", "governing_thickness",
        F.when(bracket, F.col("l_bracket.radius_ratio")).alias("radius_ratio"),
        F.when(bracket, F.col("fillet_radius")).alias("fillet_radius"),
    )
