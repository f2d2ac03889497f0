"""Design points: lengths, strata, shape parameters, faces, thickness (O-23…O-26, O-40…O-47)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.sqltext import bucket, digest, with_parts
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import u as su
from meshloom.config import BUCKETS, DEFAULTS, FAMILIES
from meshloom.functions.encode import mesh_size, scale_bucket
from meshloom.functions.uniform import unit_direction
from meshloom.operators.linearity import verification_sample
from meshloom.operators.reports import base_counts
from meshloom.plans import sample_plan as sp
from meshloom.sources import derived as d
from meshloom.sources.fields import with_fields_only

SEED = DEFAULTS.sampling.seed


def su42(draw: str) -> str:
    return su(42, "base_sample_id", f"'{draw}'")


def span(draw: str, lo: float, hi: float) -> str:
    return f"({lo!r}::DOUBLE + {su42(draw)} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE))"


def whole(draw: str, lo: int, hi: int) -> str:
    return f"({lo} + floor({su42(draw)} * {float(hi - lo + 1)!r}::DOUBLE))::BIGINT"


_FREE = f"exp(ln(0.02::DOUBLE) + {su42('length')} * (ln(2.0::DOUBLE) - ln(0.02::DOUBLE)))"


@query("log_uniform_lengths", with_parts("base", f"""
SELECT base_sample_id, {sr('len', 9, 'characteristic_length')}, {bucket('len')} AS scale_bucket,
       {sr('0.05::DOUBLE * len', 9, 'mesh_size')}
FROM (SELECT base_sample_id, {_FREE} AS len FROM base)"""))
def log_uniform_lengths(spark, sf):
    scale = DEFAULTS.scale
    drawn = d.bases(spark, sf).select(
        "base_sample_id", sp.free_length(SEED, "base_sample_id", scale).alias("len")
    )
    return drawn.select(
        "base_sample_id",
        r("len", 9, "characteristic_length"),
        scale_bucket(F.col("len"), scale).alias("scale_bucket"),
        r(mesh_size(F.col("len"), scale), 9, "mesh_size"),
    )


_EDGES = "(VALUES ('small', 0.02::DOUBLE, 0.15::DOUBLE), ('medium', 0.15::DOUBLE, 0.6::DOUBLE), ('large', 0.6::DOUBLE, 2.0::DOUBLE)) e(scale_bucket, lo, hi)"


@query("bucket_lengths", with_parts("base", f"""
SELECT base_sample_id, b.scale_bucket, {sr(f"exp(ln(lo) + {su42('length')} * (ln(hi) - ln(lo)))", 9, 'characteristic_length')}
FROM base b JOIN {_EDGES} ON e.scale_bucket = b.scale_bucket"""))
def bucket_lengths(spark, sf):
    drawn = sp.bucket_length(SEED, "base_sample_id", DEFAULTS.scale, "scale_bucket")
    return d.bases(spark, sf).select(
        "base_sample_id", "scale_bucket", r(drawn, 9, "characteristic_length")
    )


_GRID = " UNION ALL ".join(
    f"SELECT {i} AS stream, '{f}' AS geometry_family, '{b}' AS scale_bucket"
    for i, (f, b) in enumerate((f, b) for f in FAMILIES for b in BUCKETS)
)


@query("stratum_plan", with_parts("base nf", f"""
WITH done AS (SELECT * FROM base WHERE base_id IN (SELECT base_id FROM nf)),
counted AS (SELECT stream, geometry_family, scale_bucket, count(DISTINCT base_sample_id) AS n
            FROM ({_GRID}) LEFT JOIN done USING (geometry_family, scale_bucket) GROUP BY ALL),
want AS (SELECT stream, geometry_family, scale_bucket, (SELECT max(n) FROM counted) - n AS n FROM counted
         UNION ALL SELECT 15, '~free', '~free', (SELECT count(*) // 10 FROM done)),
numbers AS (SELECT *, unnest(range(n + (SELECT count(*) FROM done))) AS slot FROM want),
unused AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY slot) AS nth FROM numbers
           WHERE slot * 16 + stream NOT IN (SELECT base_id FROM done)),
ids AS (SELECT geometry_family, scale_bucket, printf('base_%06d', slot * 16 + stream) AS base_sample_id FROM unused WHERE nth <= n),
drawn AS (SELECT i.*, {su42('family')} AS uf,
                 CASE WHEN i.geometry_family = '~free' THEN {_FREE}
                      ELSE exp(ln(lo) + {su42('length')} * (ln(hi) - ln(lo))) END AS len
          FROM ids i LEFT JOIN {_EDGES} USING (scale_bucket))
SELECT base_sample_id, {sr('len', 9, 'characteristic_length')}, {sr('0.05::DOUBLE * len', 9, 'mesh_size')},
       CASE WHEN geometry_family <> '~free' THEN geometry_family WHEN uf < 0.2 THEN 'block_with_holes' WHEN uf < 0.4 THEN 'l_bracket'
            WHEN uf < 0.6 THEN 'elongated_bar' WHEN uf < 0.8 THEN 'plate_3d' ELSE 'block_with_fillet' END AS geometry_family,
       CASE WHEN geometry_family <> '~free' THEN scale_bucket ELSE {bucket('len')} END AS scale_bucket
FROM drawn"""))
def stratum_plan(spark, sf):
    """Fill every stratum up to the fullest one, then a tenth more by free draws.

    Completed are the bases with stored fields; ids of the others are gaps, planned first.
    """
    manifest = with_fields_only(d.bases(spark, sf), d.node_fields(spark, sf), "base_id")
    fullest = base_counts(manifest).select(F.max("base_samples")).scalar()
    tenth = manifest.select(F.floor(F.count(F.lit(1)) / 10)).scalar()
    plan = sp.stratum_plan(manifest, DEFAULTS.sampling, DEFAULTS.scale, fullest, tenth)
    return plan.select(
        "base_sample_id", "geometry_family", "scale_bucket", r("characteristic_length", 9),
        r("mesh_size", 9),
    )


def _planned(spark, sf, family=None):
    plan = sp.with_shape_params(d.bases(spark, sf), DEFAULTS)
    return plan.where(F.col("geometry_family") == family) if family else plan


_HOLE_U = {  # draw name -> SQL of the uniform of hole i
    n: su(42, "base_sample_id", f"'{n}' || i") for n in
    ("axis", "radius", "centre0_", "centre1_", "centre2_", "position", "hole_x", "hole_y")
}


def _hole_rows(spark, sf, family):
    exploded = _planned(spark, sf, family).select("base_sample_id", f"{family}.*")
    return exploded.select("*", F.posexplode("holes").alias("i", "hole"))


_MARGIN = "least(1.5::DOUBLE * fr * least(d0, d1) / {d}, 0.4::DOUBLE)"


def _centre(a: int) -> str:
    m = _MARGIN.format(d=f"d{a}")
    value = f"{m} + {_HOLE_U[f'centre{a}_']} * (1.0::DOUBLE - {m} - {m})"
    return sr(f"CASE WHEN axis <> {a} THEN {value} END", 9, f"centre_{'xyz'[a]}")


@query("hole_block_parameters", with_parts("base", f"""
WITH p AS (SELECT base_sample_id, {span('dim0', 0.8, 1.2)} AS d0, {span('dim1', 0.8, 1.2)} AS d1, {span('dim2', 0.8, 1.2)} AS d2,
                  {whole('hole_count', 1, 4)} AS hole_count FROM base WHERE geometry_family = 'block_with_holes'),
h AS (SELECT p.*, unnest(range(1, hole_count + 1)) AS i FROM p),
k AS (SELECT *, floor({_HOLE_U['axis']} * 3.0::DOUBLE)::BIGINT AS axis,
             0.05::DOUBLE + {_HOLE_U['radius']} * (0.20::DOUBLE - 0.05::DOUBLE) AS fr FROM h)
SELECT base_sample_id, hole_count, i AS hole, axis, {sr('d0', 9, 'dim_x')}, {sr('d2', 9, 'dim_z')}, {sr('fr', 9, 'radius_fraction')},
       {_centre(0)}, {_centre(1)}, {_centre(2)} FROM k"""))
def hole_block_parameters(spark, sf):
    rows = _hole_rows(spark, sf, "block_with_holes")
    return rows.select(
        "base_sample_id",
        F.col("hole_count").cast("bigint").alias("hole_count"),
        (F.col("i") + 1).cast("bigint").alias("hole"),
        F.col("hole.axis").cast("bigint").alias("axis"),
        r("dim_x", 9), r("dim_z", 9),
        *[r(F.col(f"hole.{c}"), 9, c) for c in ("radius_fraction", "centre_x", "centre_y", "centre_z")],
    )


_BRACKET = f"""
SELECT base_sample_id, characteristic_length AS len, mesh_size, {span('aspect_w', 0.6, 1.5)} AS aw, {span('aspect_d', 0.6, 1.5)} AS ad,
       {span('notch_d', 0.25, 0.5)} AS nd, {span('notch_w', 0.25, 0.5)} AS nw, {span('ratio', 0.02, 0.3)} AS rr
FROM base WHERE geometry_family = 'l_bracket'"""


@query("l_bracket_parameters", with_parts("base", f"""
SELECT base_sample_id, {sr('aw', 9, 'width_aspect')}, {sr('ad', 9, 'depth_aspect')}, {sr('nd', 9, 'notch_depth_fraction')},
       {sr('nw', 9, 'notch_width_fraction')}, {sr('rr', 9, 'radius_ratio')} FROM ({_BRACKET})"""))
def l_bracket_parameters(spark, sf):
    p = _planned(spark, sf, "l_bracket").select("base_sample_id", "l_bracket.*")
    return p.select("base_sample_id", *[r(c, 9) for c in p.columns if c != "base_sample_id"])


@query("bracket_fillet", with_parts("base", f"""
SELECT base_sample_id, {sr('len - nd*len', 9, 'section_depth')}, {sr('radius', 9, 'fillet_radius')}, radius >= mesh_size * 0.5::DOUBLE AS fillet_resolved
FROM (SELECT *, least(rr * (len - nd*len), least(nd*len, nw*aw*len, len - nd*len) * 0.9::DOUBLE) AS radius FROM ({_BRACKET}))"""))
def bracket_fillet(spark, sf):
    """Section depth, clamped radius and whether the mesh resolves it."""
    p = sp.with_bracket_fillet(_planned(spark, sf, "l_bracket"))
    return p.select("base_sample_id", r("section_depth", 9), r("fillet_radius", 9), "fillet_resolved")


_BAR = f"""
SELECT base_sample_id, characteristic_length AS len, {span('aspect', 8.0, 15.0)} AS ar, {span('cross', 0.5, 2.0)} AS cs,
       CASE WHEN {su42('has_holes')} < 0.4::DOUBLE THEN {whole('hole_count', 1, 3)} ELSE 0 END AS hole_count
FROM base WHERE geometry_family = 'elongated_bar'"""
_PLATE = f"""
SELECT base_sample_id, characteristic_length AS len, {span('thickness', 0.02, 0.1)} AS tf, {span('width', 0.3, 1.0)} AS wl,
       CASE WHEN {su42('has_holes')} < 0.3::DOUBLE THEN {whole('hole_count', 1, 3)} ELSE 0 END AS hole_count
FROM base WHERE geometry_family = 'plate_3d'"""


def _holes_from(source: str, lo: float, hi: float) -> str:
    return f"""SELECT base_sample_id, i, {lo!r}::DOUBLE + {_HOLE_U['radius']} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) AS rf
FROM (SELECT base_sample_id, unnest(range(1, hole_count + 1)) AS i FROM {source})"""


@query("bar_parameters", with_parts("base", f"""
WITH p AS ({_BAR}), h AS ({_holes_from('p', 0.08, 0.25)})
SELECT p.base_sample_id, hole_count::BIGINT AS hole_count, {sr('any_value(ar)', 9, 'aspect_ratio')}, {sr('any_value(cs)', 9, 'cross_section_aspect')},
       {sr('max(rf)', 9, 'largest_hole')} FROM p LEFT JOIN h USING (base_sample_id) GROUP BY p.base_sample_id, hole_count"""))
def bar_parameters(spark, sf):
    p = _planned(spark, sf, "elongated_bar").select("base_sample_id", "elongated_bar.*")
    largest = F.array_max(F.transform("holes", lambda h: h["radius_fraction"]))
    return p.select(
        "base_sample_id", F.col("hole_count").cast("bigint").alias("hole_count"),
        r("aspect_ratio", 9), r("cross_section_aspect", 9), r(largest, 9, "largest_hole"),
    )


@query("plate_parameters", with_parts("base", f"""
WITH p AS ({_PLATE}), h AS (SELECT *, 0.15::DOUBLE + {_HOLE_U['hole_x']} * (0.85::DOUBLE - 0.15::DOUBLE) AS hx,
                                      0.15::DOUBLE + {_HOLE_U['hole_y']} * (0.85::DOUBLE - 0.15::DOUBLE) AS hy
                            FROM ({_holes_from('p', 0.03, 0.12)}))
SELECT p.base_sample_id, hole_count::BIGINT AS hole_count, {sr('any_value(tf)', 9, 'thickness_fraction')}, {sr('any_value(wl)', 9, 'width_length_ratio')},
       {sr('sum(hx*rf)', 9, 'x_moment')}, {sr('sum(hy*rf)', 9, 'y_moment')} FROM p LEFT JOIN h USING (base_sample_id)
GROUP BY p.base_sample_id, hole_count"""))
def plate_parameters(spark, sf):
    p = _planned(spark, sf, "plate_3d").select("base_sample_id", "plate_3d.*")

    def moment(c):
        total = F.aggregate("holes", F.lit(0.0), lambda a, h: a + h[c] * h["radius_fraction"])
        return F.when(F.col("hole_count") > 0, total)

    return p.select(
        "base_sample_id", F.col("hole_count").cast("bigint").alias("hole_count"),
        r("thickness_fraction", 9), r("width_length_ratio", 9),
        r(moment("x_fraction"), 9, "x_moment"), r(moment("y_fraction"), 9, "y_moment"),
    )


@query("governing_thickness", with_parts("base", f"""
WITH b AS ({_BAR}), h AS (SELECT base_sample_id, max(rf) AS rf FROM ({_holes_from('b', 0.08, 0.25)}) GROUP BY 1), p AS ({_PLATE}),
t AS (SELECT base_sample_id, m, len/ar - 2.0::DOUBLE*rf*m AS net, rf
      FROM (SELECT base_sample_id, len, ar, least(len/ar, len/ar*cs) AS m FROM b) LEFT JOIN h USING (base_sample_id))
SELECT base_sample_id, geometry_family, {sr('''CASE WHEN geometry_family = 'plate_3d' THEN p.len * p.tf
  WHEN geometry_family = 'elongated_bar' THEN CASE WHEN t.rf IS NULL THEN t.m ELSE least(t.m, greatest(t.net, 0.1::DOUBLE*t.m)) END END''', 9, 'governing_thickness')}
FROM base LEFT JOIN t USING (base_sample_id) LEFT JOIN p USING (base_sample_id)"""))
def governing_thickness(spark, sf):
    plan = sp.with_thickness(_planned(spark, sf))
    return plan.select("base_sample_id", "geometry_family", r("governing_thickness", 9))


_FILLET = f"""
SELECT base_sample_id, characteristic_length AS len, mesh_size, {span('aspect0', 0.5, 1.5)} AS ax, {span('aspect1', 0.5, 1.5)} AS ay,
       {span('aspect2', 0.5, 1.5)} AS az, {span('fillet', 0.05, 0.25)} AS ff, {whole('num_fillets', 1, 4)} AS nf
FROM base WHERE geometry_family = 'block_with_fillet'"""


@query("fillet_block_parameters", with_parts("base", f"""
WITH p AS ({_FILLET}),
e AS (SELECT base_sample_id, edge, row_number() OVER (PARTITION BY base_sample_id
        ORDER BY {digest(42, 'base_sample_id', "'edge' || edge")}, edge) AS rk
      FROM (SELECT base_sample_id, unnest(range(12)) AS edge FROM p))
SELECT p.base_sample_id, nf AS num_fillets, {sr('any_value(ax)', 9, 'aspect_x')}, {sr('any_value(ff)', 9, 'fillet_radius_fraction')},
       string_agg(edge::VARCHAR, ',' ORDER BY edge) AS edges
FROM p JOIN e ON e.base_sample_id = p.base_sample_id AND rk <= nf GROUP BY p.base_sample_id, nf"""))
def fillet_block_parameters(spark, sf):
    p = _planned(spark, sf, "block_with_fillet").select("base_sample_id", "block_with_fillet.*")
    return p.select(
        "base_sample_id", F.col("num_fillets").cast("bigint").alias("num_fillets"),
        r("aspect_x", 9), r("fillet_radius_fraction", 9),
        F.array_join(F.col("fillet_edges").cast("array<string>"), ",").alias("edges"),
    )


@query("block_fillet_radius", with_parts("base", f"""
SELECT base_sample_id, {sr('radius', 9, 'block_fillet_radius')}, radius > mesh_size * 0.3::DOUBLE AS block_fillet_applied
FROM (SELECT *, least(ff * least(ax, ay, az) * len, 0.45::DOUBLE * least(ax, ay, az) * len) AS radius FROM ({_FILLET}))"""))
def block_fillet_radius(spark, sf):
    p = sp.with_block_fillet(_planned(spark, sf, "block_with_fillet"))
    return p.select("base_sample_id", r("block_fillet_radius", 9), "block_fillet_applied")


# --- faces, direction, verification sample ------------------------------------------

_FACE_SETS = """
(CASE tag % 4 WHEN 0 THEN ['x_min', 'x_max', 'y_min', 'y_max', 'z_min', 'z_max'] WHEN 1 THEN ['hole_1', 'z_max', 'z_min', 'x_min']
              WHEN 2 THEN ['x_max', 'fillet_surface'] ELSE ['y_min', 'bad', 'y_max'] END)"""


def _with_faces(spark, sf):
    sets = [
        d.FACES,
        ("hole_1", "z_max", "z_min", "x_min"),
        ("x_max", "fillet_surface"),
        ("y_min", "bad", "y_max"),
    ]
    arrays = [F.array(*map(F.lit, s)) for s in sets]
    tag = F.col("tag") % 4
    faces = F.when(tag == 0, arrays[0]).when(tag == 1, arrays[1]).when(tag == 2, arrays[2])
    return d.bases(spark, sf).withColumn("faces", faces.otherwise(arrays[3]))


_FACES_SQL = f"""
usable AS (SELECT base_sample_id, list_filter({_FACE_SETS}, lambda f: regexp_matches(f, '^[xyz]_(min|max)$')) AS fs FROM base),
picked AS (SELECT *, fs[1 + floor({su42('load_face')} * len(fs))::BIGINT] AS load_face FROM usable),
others AS (SELECT *, list_filter(fs, lambda f: f <> load_face) AS os FROM picked),
faced AS (SELECT base_sample_id, load_face, CASE WHEN len(os) > 0 THEN os[1 + floor({su42('fixed_face')} * len(os))::BIGINT] ELSE load_face END AS fixed_face FROM others)"""
_DIR_SQL = f"""
normals AS (SELECT base_sample_id, sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {su42('dir_r1')})) * cos(2.0::DOUBLE * pi() * {su42('dir_a1')}) AS nx,
  sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {su42('dir_r1')})) * sin(2.0::DOUBLE * pi() * {su42('dir_a1')}) AS ny,
  sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {su42('dir_r2')})) * cos(2.0::DOUBLE * pi() * {su42('dir_a2')}) AS nz FROM base),
dirs AS (SELECT base_sample_id, CASE WHEN n < 1e-10 THEN 1.0 ELSE nx / n END AS dx, CASE WHEN n < 1e-10 THEN 0.0 ELSE ny / n END AS dy,
  CASE WHEN n < 1e-10 THEN 0.0 ELSE nz / n END AS dz FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n FROM normals))"""


@query("load_and_fixed_faces", with_parts("base", f"""
WITH {_FACES_SQL} SELECT base_sample_id, load_face, fixed_face FROM faced"""))
def load_and_fixed_faces(spark, sf):
    """Invalid names are never chosen; a lone face is both loaded and fixed."""
    plan = sp.with_boundary_conditions(_with_faces(spark, sf), SEED)
    return plan.select("base_sample_id", "load_face", "fixed_face")


@query("load_directions", with_parts("base", f"""
WITH {_DIR_SQL} SELECT base_sample_id, {sr('dx', 9, 'load_dir_x')}, {sr('dy', 9, 'load_dir_y')}, {sr('dz', 9, 'load_dir_z')} FROM dirs"""))
def load_directions(spark, sf):
    drawn = d.bases(spark, sf).select(
        "base_sample_id", unit_direction(SEED, "base_sample_id").alias("d")
    )
    return drawn.select("base_sample_id", *[r(F.col(f"d.{c}"), 9, f"load_dir_{c}") for c in "xyz"])


@query("manifest_rows", with_parts("base", f"""
WITH {_FACES_SQL}, {_DIR_SQL}, brackets AS (
  SELECT base_sample_id, rr, least(rr * (len - nd*len), least(nd*len, nw*aw*len, len - nd*len) * 0.9::DOUBLE) AS radius FROM ({_BRACKET}))
SELECT b.base_sample_id, geometry_family, scale_bucket, {sr('mesh_size', 9, 'mesh_size')}, fixed_face, load_face,
       {sr('dx', 9, 'load_dir_x')}, {sr('rr', 9, 'radius_ratio')}, {sr('radius', 9, 'fillet_radius')}
FROM base b JOIN faced USING (base_sample_id) JOIN dirs USING (base_sample_id) LEFT JOIN brackets USING (base_sample_id)"""))
def manifest_rows(spark, sf):
    plan = sp.with_boundary_conditions(_with_faces(spark, sf), SEED)
    plan = sp.with_bracket_fillet(sp.with_thickness(sp.with_shape_params(plan, DEFAULTS)))
    return sp.manifest_rows(plan).select(
        "base_sample_id", "geometry_family", "scale_bucket", r("mesh_size", 9), "fixed_face",
        "load_face", r("load_dir_x", 9), r("radius_ratio", 9), r("fillet_radius", 9),
    )


@query("verification_sample", with_parts("base", f"""
SELECT base_sample_id FROM (
  SELECT base_sample_id, count(*) OVER () AS n, row_number() OVER (ORDER BY {digest(42, 'base_sample_id', "'verify'")}, base_sample_id) AS rk FROM base)
WHERE rk <= greatest(1, floor(n * 0.01::DOUBLE))"""))
def verification_sample_query(spark, sf):
    return verification_sample(d.bases(spark, sf), DEFAULTS.checks.linearity_sample_rate, SEED)
