"""Volumes, strains, Hooke's law, nodal averages, coherence, linearity (O-64…O-71, O-89…O-91)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.sqltext import hooke as shooke
from meshloom.catalog.sqltext import r as sr
from meshloom.catalog.sqltext import vm as svm
from meshloom.catalog.sqltext import with_parts
from meshloom.config import DEFAULTS
from meshloom.functions.stress import VOIGT, hooke, tensor_to_voigt, voigt_to_tensor
from meshloom.operators import coherence, linearity, strain
from meshloom.operators.gather import element_to_node
from meshloom.session import store_once
from meshloom.sources import derived as d

TOLERANCE = DEFAULTS.checks.coherence_tolerance
# Volumes are near 1e-6 and strains near 1e-3, so they are compared in micro units.
MICRO = 1e6
# Averaged stresses are multiples of simple fractions in pascal; ksi keeps them off rounding ties.
KSI = 6894757.293168
#: Node rows of bases that a task of the spot check holds at once.
ROWS_A_TASK = 50_000


def _strain_view(df, *keys, digits=5):
    return df.select(*keys, *[r(F.col(f"e_{v}") * MICRO, digits, f"e_{v}") for v in VOIGT])


def _strain_sql(source: str, keys: str, digits: int = 5) -> str:
    return f"SELECT {keys}, " + ", ".join(sr(f"e_{v} * 1e6", digits, f"e_{v}") for v in VOIGT) + f" FROM {source}"


def _volume_view(df):
    return df.select("sample_id", "elem_id", r(F.col("volume") * MICRO, 10, "volume"))


_VOLUME_SQL = f"SELECT sample_id, elem_id, {sr('volume * 1e6', 10, 'volume')} FROM"


@query("tet4_volumes", with_parts("lpt", f"{_VOLUME_SQL} lpt"))
def tet4_volumes(spark, sf):
    return _volume_view(strain.tet4_volumes(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf)))


@query("tet10_volumes", with_parts("qstrain", f"{_VOLUME_SQL} qstrain"))
def tet10_volumes(spark, sf):
    return _volume_view(strain.tet10_volumes(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf)))


@query("tet4_strain", with_parts("lpt", _strain_sql("lpt", "sample_id, elem_id")))
def tet4_strain(spark, sf):
    out = strain.tet4_strains(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf))
    return _strain_view(out, "sample_id", "elem_id")


@query("tet10_strain", with_parts("qstrain", _strain_sql("qstrain", "sample_id, elem_id")))
def tet10_strain(spark, sf):
    out = strain.tet10_strains(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf))
    return _strain_view(out, "sample_id", "elem_id")


@query("tet10_point_strain", with_parts("qpt", _strain_sql("qpt", "sample_id, elem_id, gp::BIGINT AS gp", 3)))
def tet10_point_strain(spark, sf):
    out = strain.tet10_point_strains(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf))
    return _strain_view(out.withColumn("gp", F.col("gp").cast("bigint")), "sample_id", "elem_id", "gp", digits=3)


@query("hooke_stress", with_parts("lpt", f"""
SELECT sample_id, elem_id, {', '.join(sr(f's_{v} / 1e3', 3, f's_{v}') for v in VOIGT)}
FROM (SELECT sample_id, elem_id, {shooke('e', 's')} FROM lpt)"""))
def hooke_stress(spark, sf):
    out = strain.tet4_strains(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf))
    stress = hooke([F.col(e) for e in strain.STRAINS], DEFAULTS.material)
    return out.select(
        "sample_id", "elem_id", *[r(s / 1e3, 3, f"s_{v}") for s, v in zip(stress, VOIGT)]
    )


@query("voigt_tensor_roundtrip", with_parts("lpt", f"""
SELECT sample_id, elem_id, {sr('e_xy / 2.0::DOUBLE * 1e6', 5, 't01')}, {sr('e_xz / 2.0::DOUBLE * 1e6', 5, 't20')}, {sr('e_yy * 1e6', 5, 't11')},
       {sr('e_yz * 1e6', 5, 'back_yz')} FROM lpt"""))
def voigt_tensor_roundtrip(spark, sf):
    """Strain to a symmetric 3×3 (shears halved) and back."""
    out = strain.tet4_strains(d.mesh_elements(spark, sf), d.mesh_nodes(spark, sf))
    tensor = voigt_to_tensor([F.col(e) for e in strain.STRAINS], engineering=True)
    t = out.select("sample_id", "elem_id", tensor.alias("t"))
    back = tensor_to_voigt(F.col("t"), engineering=True)
    return t.select(
        "sample_id", "elem_id",
        r(F.col("t")[0][1] * MICRO, 5, "t01"), r(F.col("t")[2][0] * MICRO, 5, "t20"),
        r(F.col("t")[1][1] * MICRO, 5, "t11"), r(back[4] * MICRO, 5, "back_yz"),
    )


@query("element_to_node_average", with_parts("nodes nodeavg", f"""
SELECT n.sample_id, n.node_id, {sr('coalesce(s_xx, 0.0) / 6894757.293168e0', 6, 's_xx')}, {sr('coalesce(s_yz, 0.0) / 6894757.293168e0', 6, 's_yz')},
       {sr('coalesce(von_mises, 0.0) / 6894757.293168e0', 6, 'von_mises')}
FROM nodes n LEFT JOIN nodeavg a ON a.sample_id = n.sample_id AND a.node_id = n.node_id"""))
def element_to_node_average(spark, sf):
    """Vector and scalar averages; mid-edge nodes are touched by no linear element, so 0."""
    keys = d.mesh_nodes(spark, sf).select("sample_id", "node_id")
    got = element_to_node(d.solved_elements(spark, sf), keys, ["s_xx", "s_yz", "von_mises"])
    return got.select(
        "sample_id", "node_id", *[r(F.col(c) / KSI, 6, c) for c in ("s_xx", "s_yz", "von_mises")]
    )


# --- coherence -------------------------------------------------------------------

_COHERENCE_TAIL = f"""
SELECT sample_id, err <= 0.05::DOUBLE AS coherence_pass, {sr('err', 6, 'coherence_error')},
       {sr('CASE WHEN norm < 1e-10 THEN 0.0 ELSE worst END', 6, 'max_element_error')},
       {sr('CASE WHEN norm < 1e-10 THEN 0.0 ELSE mean END', 6, 'mean_element_error')}
FROM (SELECT *, CASE WHEN norm < 1e-10 THEN 0.0 ELSE diff / norm END AS err FROM (
  SELECT sample_id, sqrt(sum((vm-solver)*(vm-solver))) AS diff, sqrt(sum(solver*solver)) AS norm,
         max(abs(vm-solver)/greatest(solver, 1e-10)) AS worst, avg(abs(vm-solver)/greatest(solver, 1e-10)) AS mean
  FROM pairs GROUP BY sample_id))"""


def _coherence_view(df):
    errors = ("coherence_error", "max_element_error", "mean_element_error")
    return df.select("sample_id", "coherence_pass", *[r(e, 6) for e in errors])


def _recomputed(spark, sf, width=10):
    elements = d.mesh_elements(spark, sf)
    if width == 4:
        elements = elements.withColumn("nodes", F.slice("nodes", 1, 4))
    return coherence.recomputed_von_mises(
        elements, d.mesh_nodes(spark, sf), width, DEFAULTS.material
    )


def _off(key: str = "sample_id"):
    return F.lit(1.0) + F.lit(0.1) * (F.col(key) % 7 == 0).cast("int")


_SOLVER_SQL = "von_mises * (1.0::DOUBLE + 0.1::DOUBLE * (CASE WHEN sample_id % 7 = 0 THEN 1 ELSE 0 END))"


@query("coherence_element_vm", with_parts("solved", f"""
WITH pairs AS (SELECT sample_id, von_mises AS vm, {_SOLVER_SQL} AS solver FROM solved) {_COHERENCE_TAIL}"""))
def coherence_element_vm(spark, sf):
    """The solver's element von Mises is off by a tenth for every seventh sample."""
    pairs = _recomputed(spark, sf).withColumn("solver_vm", F.col("vm") * _off())
    return _coherence_view(coherence.by_element_pairs(pairs, TOLERANCE))


@query("coherence_element_stress", with_parts("qstrain lpt", f"""
WITH mine AS (SELECT sample_id, elem_id, {svm('s')} AS vm FROM (SELECT sample_id, elem_id, {shooke('e', 's')} FROM lpt)),
theirs AS (SELECT sample_id, elem_id, {svm('s')} AS solver FROM (SELECT sample_id, elem_id, {shooke('e', 's')} FROM qstrain)),
pairs AS (SELECT m.sample_id, vm, solver FROM mine m JOIN theirs t ON m.sample_id = t.sample_id AND m.elem_id = t.elem_id)
{_COHERENCE_TAIL}"""))
def coherence_element_stress(spark, sf):
    """Linear-element recomputation against element stress of the quadratic solution."""
    solver = d.solved_elements(spark, sf).select(
        "sample_id", "elem_id", F.col("von_mises").alias("solver_vm")
    )
    return _coherence_view(coherence.by_element(_recomputed(spark, sf, 4), solver, TOLERANCE))


@query("coherence_nodal_mean", with_parts("solved nodeavg", f"""
WITH e AS (SELECT sample_id, avg(von_mises) AS mine FROM solved GROUP BY 1),
n AS (SELECT sample_id, avg(von_mises) AS theirs, sqrt(sum(von_mises*von_mises)) AS norm FROM nodeavg GROUP BY 1),
k AS (SELECT sample_id, CASE WHEN norm < 1e-10 THEN 0.0 ELSE abs(mine - theirs) / greatest(theirs, 1e-10) END AS err
      FROM e JOIN n USING (sample_id))
SELECT sample_id, err <= 0.05::DOUBLE AS coherence_pass, {sr('err', 6, 'coherence_error')}, {sr('err', 6, 'max_element_error')},
       {sr('err', 6, 'mean_element_error')} FROM k"""))
def coherence_nodal_mean(spark, sf):
    """Only nodal stress is known: means are compared (over corner nodes)."""
    solved = d.solved_elements(spark, sf, stored=["von_mises"])
    corner_nodes = solved.select("sample_id", F.explode("nodes").alias("node_id")).distinct()
    nodal = element_to_node(solved, corner_nodes, ["von_mises"]).select(
        "sample_id", F.col("von_mises").alias("solver_vm")
    )
    return _coherence_view(coherence.by_nodal_mean(_recomputed(spark, sf), nodal, TOLERANCE))


# --- linearity spot-check ------------------------------------------------------------

_SPOT_SQL = f"""
fields AS (SELECT *, {svm('s')} AS von_mises FROM (
  SELECT l_orderkey AS base_id, l_linenumber AS node_id, l_extendedprice AS s_xx, 1000.0::DOUBLE * l_quantity AS s_yy,
         1e5::DOUBLE * (l_discount + 0.0) AS s_zz, 1e5::DOUBLE * (l_tax + 0.0) AS s_xy,
         1e3::DOUBLE * l_quantity * (l_discount + 0.0) AS s_yz, 1e3::DOUBLE * l_quantity * (l_tax + 0.0) AS s_xz,
         1e-5::DOUBLE * (l_discount + 0.0) AS ux, 1e-5::DOUBLE * (l_tax + 0.0) AS uy, 1e-5::DOUBLE * (l_quantity / 1000.0::DOUBLE) AS uz
  FROM lineitem)),
mine AS (SELECT sample_id, node_id, sqrt(ux*ux+uy*uy+uz*uz) * scale_factor AS u, von_mises * scale_factor AS s
         FROM scaled JOIN fields USING (base_id)),
solved AS (SELECT sample_id, node_id, sqrt(ux*ux+uy*uy+uz*uz) * scale_factor * k AS u, von_mises * scale_factor * k AS s FROM (
         SELECT *, 1.0::DOUBLE + CASE WHEN base_id % 20 = 0 AND target_safety_factor < 2 THEN 0.02::DOUBLE ELSE 0.001::DOUBLE END AS k
         FROM scaled JOIN fields USING (base_id)) WHERE NOT (base_id % 40 = 3 AND node_id = 1 AND target_safety_factor = 3)),
errors AS (SELECT coalesce(m.sample_id, r.sample_id) AS sample_id, abs(m.u - r.u) / greatest(r.u, 1e-30) AS eu, abs(m.s - r.s) / greatest(r.s, 1e-30) AS es,
         m.u IS NULL OR r.u IS NULL OR m.s IS NULL OR r.s IS NULL AS lacking
         FROM mine m FULL JOIN solved r ON m.sample_id = r.sample_id AND m.node_id = r.node_id),
worst AS (SELECT sample_id, max(CASE WHEN NOT lacking THEN eu END) AS max_displacement_error, max(CASE WHEN NOT lacking THEN es END) AS max_von_mises_error,
         count(*) FILTER (WHERE lacking) AS missing_nodes FROM errors GROUP BY 1),
spot AS (SELECT base_sample_id, target_safety_factor, geometry_family, scale_bucket, w.*,
         coalesce(max_displacement_error <= 0.01::DOUBLE AND max_von_mises_error <= 0.01::DOUBLE AND missing_nodes = 0, false) AS passed
         FROM worst w JOIN scaled v ON v.sample_id = w.sample_id)"""


def spot_checks(spark, sf):
    """Every variant of every base against a solve of its own, node by node.

    The second solve is off by 2 % for every twentieth base below a safety factor of 2, else by 0.1 %, and lacks a node of
    every fortieth base at 3.
    """
    # Read three times below, so the variants are stored once. A variant lies with its base: rows are joined by base
    # first, and all that follows keeps the base among its keys, so the nodes of variants are never moved.
    variants = store_once(
        d.variants(spark, sf).select(
            "base_id", "sample_id", "base_sample_id", "target_safety_factor", "geometry_family", "scale_bucket", "scale_factor"
        ),
        "variants",
    )
    values = ["ux", "uy", "uz", "von_mises"]
    # Each row grows to ten: bases are spread by their rows, in parts that sorting holds in memory.
    fields = d.node_fields(spark, sf, "node_id").select("base_id", "node_id", *values)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fields.count() // ROWS_A_TASK))
    fields = fields.repartition(parts, "base_id")
    factors = variants.select("base_id", "sample_id", "target_safety_factor", "scale_factor")
    mine = fields.join(factors, "base_id")
    scaled = mine.select("base_id", "sample_id", "node_id", *[(F.col(v) * F.col("scale_factor")).alias(v) for v in values])
    low, at = F.col("target_safety_factor") < 2, F.col("target_safety_factor") == 3
    drift = F.lit(1.0) + F.when((F.col("base_id") % 20 == 0) & low, 0.02).otherwise(0.001)
    loads = factors.withColumn("scale_factor", F.col("scale_factor") * drift)
    solved = fields.join(loads, "base_id").where(~((F.col("base_id") % 40 == 3) & (F.col("node_id") == 1) & at))
    resolved = solved.select("base_id", "sample_id", "node_id", *[(F.col(v) * F.col("scale_factor")).alias(v) for v in values])
    pairs = linearity.pair_fields(scaled, resolved, ["base_id", "sample_id", "node_id"])
    checked = linearity.compare(pairs, ["base_id", "sample_id"], DEFAULTS.checks.linearity_tolerance)
    labels = variants.drop("scale_factor")
    return checked.join(labels, ["base_id", "sample_id"]).drop("base_id", "sample_id")


@query("scaled_vs_resolved", with_parts("scaled nf", f"""
WITH {_SPOT_SQL} SELECT base_sample_id, target_safety_factor, {sr('max_displacement_error', 9, 'max_displacement_error')},
  {sr('max_von_mises_error', 9, 'max_von_mises_error')}, missing_nodes, passed FROM spot"""))
def scaled_vs_resolved(spark, sf):
    return spot_checks(spark, sf).select(
        "base_sample_id", "target_safety_factor", r("max_displacement_error", 9), r("max_von_mises_error", 9), "missing_nodes", "passed"
    )


@query("linearity_report", with_parts("scaled nf", f"""
WITH {_SPOT_SQL} SELECT geometry_family, count(*) AS checked, count(*) FILTER (WHERE passed) AS passed,
  count(*) FILTER (WHERE NOT passed) AS failed, {sr('count(*) FILTER (WHERE NOT passed) / count(*)::DOUBLE', 9, 'failure_rate')},
  {sr('max(max_von_mises_error)', 9, 'worst_von_mises_error')}, {sr('max(max_displacement_error)', 9, 'worst_displacement_error')},
  grouping(geometry_family) = 0 AND count(*) FILTER (WHERE NOT passed) / count(*)::DOUBLE > 0.05::DOUBLE AS blocking
FROM spot GROUP BY ROLLUP (geometry_family)"""))
def linearity_report(spark, sf):
    """Per family, and in total under a null family."""
    out = linearity.report(spot_checks(spark, sf), DEFAULTS.checks.max_family_failure_rate)
    return out.select(
        "geometry_family", "checked", "passed", "failed", r("failure_rate", 9),
        r("worst_von_mises_error", 9), r("worst_displacement_error", 9), "blocking",
    )


@query("linearity_verdict", with_parts("scaled nf", f"""
WITH {_SPOT_SQL}, fam AS (SELECT geometry_family, count(*) FILTER (WHERE NOT passed) / count(*)::DOUBLE > 0.05::DOUBLE AS blocking FROM spot GROUP BY 1)
SELECT count(*) AS total_checked, count(*) FILTER (WHERE passed) AS total_passed, count(*) FILTER (WHERE NOT passed) AS total_failed,
  (SELECT count(*) FILTER (WHERE blocking) FROM fam) AS blocking_families, (SELECT count(*) FILTER (WHERE blocking) = 0 FROM fam) AS all_passed
FROM spot"""))
def linearity_verdict(spark, sf):
    return linearity.verdict(
        linearity.report(spot_checks(spark, sf), DEFAULTS.checks.max_family_failure_rate)
    )


@query("flagged_stratum_bases", with_parts("scaled nf base", f"""
WITH {_SPOT_SQL} SELECT base_sample_id, geometry_family, scale_bucket FROM base
WHERE (geometry_family, scale_bucket) IN (SELECT (geometry_family, scale_bucket) FROM spot WHERE NOT passed)"""))
def flagged_stratum_bases(spark, sf):
    """Every base of a stratum with a failed spot-check."""
    flagged = linearity.flag_bases(d.bases(spark, sf), spot_checks(spark, sf))
    return flagged.select("base_sample_id", "geometry_family", "scale_bucket")


@query("spot_check_cross_reference", with_parts("variants nf", f"""
WITH {_SPOT_SQL}, s AS (SELECT DISTINCT base_sample_id FROM spot WHERE NOT passed),
g AS (SELECT base_sample_id, count(*) AS gate_failures FROM variants WHERE NOT linearity_gate_pass GROUP BY 1)
SELECT coalesce(s.base_sample_id, g.base_sample_id) AS base_sample_id, s.base_sample_id IS NOT NULL AS spot_check_failed,
       coalesce(gate_failures, 0) AS gate_failures FROM s FULL JOIN g ON s.base_sample_id = g.base_sample_id"""))
def spot_check_cross_reference(spark, sf):
    return linearity.cross_reference(spot_checks(spark, sf), d.variants(spark, sf))
