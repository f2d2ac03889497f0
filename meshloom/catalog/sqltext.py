"""Shared pieces of the oracle SQL: the derived tables as common table expressions."""

from __future__ import annotations

import re

# Fixed values below repeat the parameters of the settings and derived tables.

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], body: str) -> None:
    _PARTS[name] = (needs, body)


def with_parts(names: str, query: str) -> str:
    """``WITH`` every named part and what it needs, then ``query``."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = _PARTS[name]
        for n in needs:
            visit(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS ({_PARTS[n][1].strip()})" for n in order)
    query = query.strip()
    if re.match(r"WITH RECURSIVE\b", query):
        return f"WITH RECURSIVE {ctes},\n{query[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", query):
        return f"WITH {ctes},\n{query[len('WITH'):]}"
    return f"WITH {ctes}\n{query}"


def r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def u(seed: int, key: str, draw: str) -> str:
    """The stateless uniform; ``draw`` is an SQL expression."""
    digest = f"md5('{seed}|' || {key} || '|' || {draw})"
    return f"(CAST('0x' || substr({digest}, 1, 13) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE)"


def digest(seed: int, key: str, draw: str) -> str:
    return f"md5('{seed}|' || {key} || '|' || {draw})"


def bucket(length: str) -> str:
    return (
        f"CASE WHEN {length} >= 0.02::DOUBLE AND {length} < 0.15::DOUBLE THEN 'small' "
        f"WHEN {length} >= 0.15::DOUBLE AND {length} < 0.6::DOUBLE THEN 'medium' ELSE 'large' END"
    )


def log_length(share: str) -> str:
    return f"exp(ln(0.02::DOUBLE) + ({share}) * (ln(2.0::DOUBLE) - ln(0.02::DOUBLE)))"


def vm(p: str) -> str:
    xx, yy, zz, xy, yz, xz = (f"{p}_{n}" for n in ("xx", "yy", "zz", "xy", "yz", "xz"))
    return (
        f"sqrt(0.5::DOUBLE * (({xx}-{yy})*({xx}-{yy}) + ({yy}-{zz})*({yy}-{zz}) + ({zz}-{xx})*({zz}-{xx})"
        f" + 6.0::DOUBLE * ({xy}*{xy} + {yz}*{yz} + {xz}*{xz})))"
    )


def hooke(prefix: str, out: str) -> str:
    """Six select items: stress from strain columns ``prefix_*``."""
    lam = "(210e9 * 0.3e0 / ((1 + 0.3e0) * (1 - 2 * 0.3e0)))"
    mu = "(210e9 / (2 * (1 + 0.3e0)))"
    tr = f"({prefix}_xx + {prefix}_yy + {prefix}_zz)"
    normal = [f"{lam} * {tr} + 2.0::DOUBLE * {mu} * {prefix}_{c} AS {out}_{c}" for c in ("xx", "yy", "zz")]
    shear = [f"{mu} * {prefix}_{c} AS {out}_{c}" for c in ("xy", "yz", "xz")]
    return ", ".join(normal + shear)


part("base", (), f"""
SELECT *, {bucket('characteristic_length')} AS scale_bucket,
       0.05::DOUBLE * characteristic_length AS mesh_size,
       CASE WHEN geometry_family IN ('elongated_bar', 'plate_3d')
            THEN 0.05::DOUBLE * characteristic_length END AS governing_thickness,
       CASE WHEN geometry_family = 'l_bracket'
            THEN 0.02::DOUBLE + 0.28::DOUBLE * ((tag % 1000) / 999.0::DOUBLE) END AS radius_ratio,
       tag % 11 <> 0 AS coherence_pass, tag % 13 = 0 AS has_multihot_nodes,
       1.1::DOUBLE + (tag % 10) / 100.0::DOUBLE AS solve_time_s, 3 + base_id % 20 AS graph_diameter
FROM (SELECT o_orderkey AS base_id, o_custkey AS tag, printf('base_%06d', o_orderkey) AS base_sample_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'block_with_holes' WHEN '2-HIGH' THEN 'l_bracket'
             WHEN '3-MEDIUM' THEN 'elongated_bar' WHEN '4-NOT SPECIFIED' THEN 'plate_3d'
             WHEN '5-LOW' THEN 'block_with_fillet' END AS geometry_family,
        {log_length('o_totalprice / 500000.0::DOUBLE')} AS characteristic_length
      FROM orders)
""")
part("nf", (), f"""
SELECT *, {vm('s')} AS von_mises FROM (
  SELECT l_orderkey AS base_id, l_extendedprice AS s_xx, 1000.0::DOUBLE * l_quantity AS s_yy,
         1e5::DOUBLE * (l_discount + 0.0) AS s_zz, 1e5::DOUBLE * (l_tax + 0.0) AS s_xy,
         1e3::DOUBLE * l_quantity * (l_discount + 0.0) AS s_yz, 1e3::DOUBLE * l_quantity * (l_tax + 0.0) AS s_xz,
         1e-5::DOUBLE * (l_discount + 0.0) AS ux, 1e-5::DOUBLE * (l_tax + 0.0) AS uy,
         1e-5::DOUBLE * (l_quantity / 1000.0::DOUBLE) AS uz
  FROM lineitem)
""")
part("summ", ("nf",), """
SELECT base_id, max(von_mises) AS ref_peak, quantile_cont(von_mises, 0.95) AS ref_p95,
       quantile_cont(von_mises, 0.95) AS ref_scale,
       max(sqrt(ux*ux + uy*uy + uz*uz)) AS ref_max_disp, count(*) AS node_count
FROM nf GROUP BY base_id
""")


def scaled_variants(source: str) -> str:
    return f"""
SELECT *, base_sample_id || '_sf' || printf('%.1f', target_safety_factor) AS sample_id,
       'SF_' || printf('%.1f', target_safety_factor) AS load_class,
       ref_peak * scale_factor AS peak_von_mises, ref_p95 * scale_factor AS p95_von_mises,
       ref_max_disp * scale_factor AS max_displacement
FROM (SELECT b.*, t AS target_safety_factor,
             CASE WHEN ref_scale < 1e-10 THEN 0.0 ELSE 420e6 / t / ref_scale END AS scale_factor
      FROM {source} b, (VALUES (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) q(t))
"""


def gated_variants(source: str, cap: str) -> str:
    return f"""
SELECT *, CASE rejection_code
         WHEN 'peak_cap' THEN 'Peak VM ' || printf('%.1f', peak_von_mises) || ' Pa > cap ' || printf('%.1f', {cap}::DOUBLE) || ' Pa'
         WHEN 'delta_l' THEN label || ' δ/L = ' || printf('%.4f', by_l) || ' > 0.05'
         WHEN 'delta_t' THEN 'Bending δ/t = ' || printf('%.4f', by_t) || ' > 0.5' ELSE '' END AS rejection_reason,
       rejection_code IS NULL AS linearity_gate_pass
FROM (SELECT *, CASE WHEN peak_von_mises > {cap} THEN 'peak_cap' WHEN by_l > 0.05::DOUBLE THEN 'delta_l'
                     WHEN by_t > 0.5::DOUBLE THEN 'delta_t' END AS rejection_code
      FROM (SELECT *, CASE WHEN geometry_family IN ('elongated_bar', 'plate_3d') THEN 'Bending'
                           WHEN geometry_family IN ('block_with_holes', 'block_with_fillet', 'l_bracket') THEN 'Bulk'
                           ELSE 'Default' END AS label,
                   CASE WHEN characteristic_length > 0 THEN max_displacement / characteristic_length ELSE 0 END AS by_l,
                   CASE WHEN geometry_family IN ('elongated_bar', 'plate_3d') AND governing_thickness > 0
                        THEN max_displacement / governing_thickness END AS by_t,
                   CASE WHEN geometry_family IN ('elongated_bar', 'plate_3d') AND governing_thickness > 0 THEN 'both'
                        WHEN geometry_family IN ('elongated_bar', 'plate_3d') THEN 'bending' ELSE 'bulk' END
                     AS linearity_gate_type
            FROM {source}))
"""


part("basesum", ("base", "summ"), "SELECT * FROM base JOIN summ USING (base_id)")
part("scaled", ("basesum",), scaled_variants("basesum"))
part("variants", ("scaled",), gated_variants("scaled", "360e6"))

# --- splits ----------------------------------------------------------------------


def split_parts(prefix: str, source: str, needs: tuple[str, ...]) -> None:
    """Parts ``{prefix}first``, ``{prefix}large``, ``{prefix}split`` over a manifest ``source``."""
    part(f"{prefix}first", needs, f"""
SELECT base_sample_id, geometry_family, scale_bucket, radius_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY base_sample_id ORDER BY sample_id) AS rn FROM {source}) WHERE rn = 1""")
    part(f"{prefix}large", (f"{prefix}first",), f"""
SELECT base_sample_id FROM (
  SELECT base_sample_id, count(*) OVER () AS n,
         row_number() OVER (ORDER BY {digest(42, 'base_sample_id', "'large'")}, base_sample_id) AS rk
  FROM {prefix}first WHERE scale_bucket = 'large')
WHERE rk <= greatest(1, floor(n * 0.5::DOUBLE))""")
    part(f"{prefix}held", (f"{prefix}large",), f"""
SELECT *, base_sample_id IN (SELECT base_sample_id FROM {prefix}large) AS held_large,
       coalesce(geometry_family = 'l_bracket' AND radius_ratio BETWEEN 0.10::DOUBLE AND 0.20::DOUBLE, FALSE) AS held_ratio
FROM {prefix}first""")
    part(f"{prefix}split", (f"{prefix}held",), f"""
SELECT *, CASE WHEN held_large OR held_ratio THEN 'test'
               WHEN geometry_family IS NULL OR scale_bucket IS NULL THEN 'train'
               WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train'
               WHEN rk <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, count(*) OVER (PARTITION BY geometry_family, scale_bucket, held_large OR held_ratio) AS n,
             row_number() OVER (PARTITION BY geometry_family, scale_bucket, held_large OR held_ratio
                                ORDER BY {digest(42, 'base_sample_id', "'stratum'")}, base_sample_id) AS rk
      FROM {prefix}held)""")


split_parts("s", "variants", ("variants",))
part("splitmani", ("ssplit",), "SELECT v.*, s.split FROM variants v LEFT JOIN ssplit s USING (base_sample_id)")

# --- meshes ------------------------------------------------------------------------

part("mesh", (), """
SELECT p_partkey AS sample_id, 1 + p_size % 3 AS a, 1 + p_partkey % 3 AS b, 1 + p_partkey % 2 AS c,
       0.05::DOUBLE * (1 + p_size / 50.0::DOUBLE) AS h FROM part
""")
part("elems", ("mesh",), """
SELECT sample_id, elem_id, [c0, c1, c2, c3, (c0+c1)//2, (c1+c2)//2, (c0+c2)//2, (c0+c3)//2, (c1+c3)//2, (c2+c3)//2] AS nodes
FROM (SELECT sample_id, (((ci*10+cj)*10+ck)*6+t)::BIGINT AS elem_id, c0, c0+d1 AS c1, c0+d2 AS c2, c0+20202 AS c3
      FROM (SELECT sample_id, ci, cj, ck, (20000*ci + 200*cj + 2*ck)::BIGINT AS c0
            FROM mesh, (VALUES (0),(1),(2)) i(ci), (VALUES (0),(1),(2)) j(cj), (VALUES (0),(1)) k(ck)
            WHERE ci < a AND cj < b AND ck < c),
           (VALUES (0, 20000, 20200), (1, 20000, 20002), (2, 200, 20200),
                   (3, 200, 202), (4, 2, 20002), (5, 2, 202)) w(t, d1, d2))
""")
part("nodes", ("mesh",), """
SELECT *, 1e-3::DOUBLE * (2.0::DOUBLE*x - y + 0.5::DOUBLE*z) + 1e-2::DOUBLE*x*y AS ux,
       1e-3::DOUBLE * (0.3::DOUBLE*x + y) + 2e-2::DOUBLE*z*z AS uy,
       1e-3::DOUBLE * (x - z) + 1e-2::DOUBLE*x*z AS uz
FROM (SELECT sample_id, ((i*100 + j)*100 + k)::BIGINT AS node_id,
             h * (i + 0.3::DOUBLE*j + 0.1::DOUBLE*k) / 2.0::DOUBLE AS x,
             h * (0.05::DOUBLE*i + 0.9::DOUBLE*j + 0.2::DOUBLE*k) / 2.0::DOUBLE AS y,
             h * (0.15::DOUBLE*i + 1.1::DOUBLE*k) / 2.0::DOUBLE AS z
      FROM mesh, (VALUES (0),(1),(2),(3),(4),(5),(6)) p(i), (VALUES (0),(1),(2),(3),(4),(5),(6)) q(j),
           (VALUES (0),(1),(2),(3),(4)) s(k)
      WHERE i <= 2*a AND j <= 2*b AND k <= 2*c)
""")
part("elnodes", ("elems",), """
SELECT sample_id, elem_id, unnest(range(10)) AS local, unnest(nodes) AS node_id FROM elems
""")
part("edges4", ("elnodes",), """
SELECT DISTINCT p.sample_id, p.node_id AS src, q.node_id AS dst
FROM elnodes p JOIN elnodes q ON p.sample_id = q.sample_id AND p.elem_id = q.elem_id
WHERE p.local < 4 AND q.local < 4 AND p.local <> q.local
""")
part("edges10", ("elnodes",), """
SELECT DISTINCT p.sample_id, p.node_id AS src, q.node_id AS dst
FROM elnodes p JOIN elnodes q ON p.sample_id = q.sample_id AND p.elem_id = q.elem_id
WHERE p.local <> q.local
""")
part("faces", ("elems",), """
SELECT sample_id, list_sort(f) AS face FROM (
  SELECT sample_id, unnest([[nodes[1],nodes[2],nodes[3]], [nodes[1],nodes[2],nodes[4]],
                            [nodes[1],nodes[3],nodes[4]], [nodes[2],nodes[3],nodes[4]]]) AS f FROM elems)
""")
part("boundary", ("faces",), """
SELECT sample_id, face[1] AS n0, face[2] AS n1, face[3] AS n2 FROM faces GROUP BY sample_id, face HAVING count(*) = 1
""")
part("surface", ("boundary",), """
SELECT DISTINCT sample_id, node_id FROM (SELECT sample_id, unnest([n0, n1, n2]) AS node_id FROM boundary)
""")
part("gp", (), """
SELECT * FROM (VALUES (0, 0.58541020e0, 0.13819660e0, 0.13819660e0, 0.13819660e0),
  (1, 0.13819660e0, 0.58541020e0, 0.13819660e0, 0.13819660e0),
  (2, 0.13819660e0, 0.13819660e0, 0.58541020e0, 0.13819660e0),
  (3, 0.13819660e0, 0.13819660e0, 0.13819660e0, 0.58541020e0)) g(gp, l0, l1, l2, l3)
""")
part("shape", ("gp",), """
SELECT gp, 0 AS local, -(4*l0-1) AS dr, -(4*l0-1) AS ds, -(4*l0-1) AS dt FROM gp
UNION ALL SELECT gp, 1, 4*l1-1, 0, 0 FROM gp UNION ALL SELECT gp, 2, 0, 4*l2-1, 0 FROM gp
UNION ALL SELECT gp, 3, 0, 0, 4*l3-1 FROM gp UNION ALL SELECT gp, 4, 4*(l0-l1), -4*l1, -4*l1 FROM gp
UNION ALL SELECT gp, 5, 4*l2, 4*l1, 0 FROM gp UNION ALL SELECT gp, 6, -4*l2, 4*(l0-l2), -4*l2 FROM gp
UNION ALL SELECT gp, 7, -4*l3, -4*l3, 4*(l0-l3) FROM gp UNION ALL SELECT gp, 8, 4*l3, 0, 4*l1 FROM gp
UNION ALL SELECT gp, 9, 0, 4*l3, 4*l2 FROM gp
""")
part("shape4", (), """
SELECT * FROM (VALUES (0, 0, -1e0, -1e0, -1e0), (0, 1, 1e0, 0e0, 0e0), (0, 2, 0e0, 1e0, 0e0), (0, 3, 0e0, 0e0, 1e0))
  s(gp, local, dr, ds, dt)
""")


def strain_parts(prefix: str, shape: str, weight: str) -> None:
    """Parts ``{prefix}pt`` (per integration point) and ``{prefix}strain`` (per element)."""
    sums = ", ".join(
        f"sum({d}*{f}) AS {m}{i}{k}"
        for i, d in enumerate(("dr", "ds", "dt"))
        for m, fs in (("j", ("x", "y", "z")), ("g", ("ux", "uy", "uz")))
        for k, f in enumerate(fs)
    )

    def inv(k: int, i: int) -> str:
        rows = [n for n in range(3) if n != i]
        cols = [n for n in range(3) if n != k]
        sign = "" if (k + i) % 2 == 0 else "-"
        a, b = rows
        c, d = cols
        return f"({sign}(j{a}{c}*j{b}{d} - j{a}{d}*j{b}{c}) / dd)"

    def slope(j: int, k: int) -> str:
        return "(" + " + ".join(f"{inv(k, i)}*g{i}{j}" for i in range(3)) + ")"

    e = {"xx": slope(0, 0), "yy": slope(1, 1), "zz": slope(2, 2), "xy": f"{slope(0,1)} + {slope(1,0)}",
         "yz": f"{slope(1,2)} + {slope(2,1)}", "xz": f"{slope(0,2)} + {slope(2,0)}"}
    items = ", ".join(f"CASE WHEN abs(det) < 1e-30 THEN 0.0 ELSE {v} END AS e_{n}" for n, v in e.items())
    part(f"{prefix}pt", ("elnodes", "nodes", shape), f"""
SELECT sample_id, elem_id, gp, det, abs(det) * {weight} AS volume, {items}
FROM (SELECT *, CASE WHEN abs(det) < 1e-30 THEN 1.0 ELSE det END AS dd FROM (
  SELECT *, j00*(j11*j22-j12*j21) - j01*(j10*j22-j12*j20) + j02*(j10*j21-j11*j20) AS det FROM (
    SELECT e.sample_id, e.elem_id, gp, {sums}
    FROM elnodes e JOIN nodes n ON e.sample_id = n.sample_id AND e.node_id = n.node_id
         JOIN {shape} s ON s.local = e.local
    GROUP BY e.sample_id, e.elem_id, gp)))""")
    avg = ", ".join(
        f"CASE WHEN min(abs(det)) < 1e-30 THEN 0.0 ELSE sum(e_{n}*volume)/sum(volume) END AS e_{n}" for n in e
    )
    part(f"{prefix}strain", (f"{prefix}pt",), f"""
SELECT sample_id, elem_id, sum(volume) AS volume, {avg} FROM {prefix}pt GROUP BY sample_id, elem_id""")


strain_parts("q", "shape", "(1.0::DOUBLE/24.0::DOUBLE)")
strain_parts("l", "shape4", "(1.0::DOUBLE/6.0::DOUBLE)")
part("solved", ("qstrain",), f"""
SELECT *, {vm('s')} AS von_mises FROM (SELECT sample_id, elem_id, volume, {hooke('e', 's')} FROM qstrain)
""")
part("nodeavg", ("solved", "elnodes"), """
SELECT e.sample_id, e.node_id, """ + ", ".join(
    f"sum({c}*volume)/greatest(sum(volume), 1e-30) AS {c}"
    for c in ("s_xx", "s_yy", "s_zz", "s_xy", "s_yz", "s_xz", "von_mises")
) + """
FROM elnodes e JOIN solved s ON e.sample_id = s.sample_id AND e.elem_id = s.elem_id
WHERE e.local < 4 GROUP BY e.sample_id, e.node_id
""")
part("mbase", (), f"""
SELECT *, {bucket('characteristic_length')} AS scale_bucket,
       CASE WHEN geometry_family IN ('elongated_bar', 'plate_3d')
            THEN 0.05::DOUBLE * characteristic_length END AS governing_thickness,
       CASE WHEN geometry_family = 'l_bracket'
            THEN 0.02::DOUBLE + 0.28::DOUBLE * ((mesh_id % 1000) / 999.0::DOUBLE) END AS radius_ratio,
       mesh_id % 7 <> 0 AS coherence_pass
FROM (SELECT p_partkey AS mesh_id, printf('base_%06d', p_partkey) AS base_sample_id,
        (['block_with_holes', 'l_bracket', 'elongated_bar', 'plate_3d', 'block_with_fillet'])[1 + p_partkey % 5] AS geometry_family,
        {log_length('(p_partkey * 7919 % 1000) / 1000.0::DOUBLE')} AS characteristic_length,
        (['x_min', 'x_max', 'y_min', 'y_max', 'z_min', 'z_max'])[1 + p_partkey % 6] AS load_face,
        (['x_min', 'x_max', 'y_min', 'y_max', 'z_min', 'z_max'])[1 + (p_partkey // 6) % 6] AS fixed_face
      FROM part)
""")


def on_face(face: str) -> str:
    arms = " ".join(
        f"WHEN '{c}_min' THEN {c} < {c}_lo + 0.02::DOUBLE * ({c}_hi - {c}_lo) "
        f"WHEN '{c}_max' THEN {c} > {c}_hi - 0.02::DOUBLE * ({c}_hi - {c}_lo)"
        for c in "xyz"
    )
    return f"CASE {face} {arms} END"


part("boxes", ("nodes",), """
SELECT sample_id, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi
FROM nodes GROUP BY sample_id
""")
part("masked", ("boxes", "mbase"), f"""
SELECT n.*, {on_face('load_face')} AS is_loaded, {on_face('fixed_face')} AS is_fixed
FROM nodes n JOIN boxes USING (sample_id) JOIN mbase m ON m.mesh_id = n.sample_id
""")
part("forced", ("masked",), """
SELECT *, CASE WHEN is_loaded THEN 0.6::DOUBLE * 1000.0::DOUBLE / n_loaded ELSE 0.0 END AS fx, 0.0::DOUBLE AS fy,
       CASE WHEN is_loaded THEN 0.8::DOUBLE * 1000.0::DOUBLE / n_loaded ELSE 0.0 END AS fz
FROM (SELECT *, count(*) FILTER (WHERE is_loaded) OVER (PARTITION BY sample_id) AS n_loaded FROM masked)
""")
part("mfields", ("forced", "nodeavg", "surface"), """
SELECT f.*, """ + ", ".join(
    f"coalesce(a.{c}, 0.0) AS {c}" for c in ("s_xx", "s_yy", "s_zz", "s_xy", "s_yz", "s_xz", "von_mises")
) + """, s.node_id IS NOT NULL AS is_surface
FROM forced f LEFT JOIN nodeavg a ON f.sample_id = a.sample_id AND f.node_id = a.node_id
     LEFT JOIN surface s ON f.sample_id = s.sample_id AND f.node_id = s.node_id
""")
part("msumm", ("mfields", "mbase"), """
SELECT m.*, t.* EXCLUDE (sample_id) FROM mbase m JOIN (
  SELECT sample_id, max(von_mises) AS ref_peak, quantile_cont(von_mises, 0.95) AS ref_p95,
         quantile_cont(von_mises, 0.95) AS ref_scale, max(sqrt(ux*ux + uy*uy + uz*uz)) AS ref_max_disp,
         count(*) AS node_count
  FROM mfields GROUP BY sample_id) t ON t.sample_id = m.mesh_id
""")
part("mscaled", ("msumm",), scaled_variants("msumm"))
part("mvariants", ("mscaled",), gated_variants("mscaled", "432e6"))
split_parts("m", "mvariants", ("mvariants",))
part("mmani", ("msplit",), "SELECT v.*, s.split FROM mvariants v LEFT JOIN msplit s USING (base_sample_id)")
