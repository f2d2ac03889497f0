"""Tetrahedron volumes and strains as column expressions.

The shape-function gradient of a quadratic tetrahedron is linear in the barycentric
coordinates. At corner m the derivative of a field along L_v is 3·f(m) for v = m and
4·f(mid(m, v)) − f(v) otherwise, and over all four corners these add up to 4 times
the three mid-edge values around v. An integration point is one corner weighted
more than the rest, so its derivative is a blend of those two short formulas.
A linear tetrahedron has a single Jacobian, the same at every point.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.stress import VOIGT
from meshloom.operators.gather import gather_points
from meshloom.operators.whole import are_long, by_sample, mesh_places, stacked, whole_parts

COORDS = ("x", "y", "z")
DISP = ("ux", "uy", "uz")

# Barycentric coordinates of the four-point rule and its weight.
GAUSS_NEAR = 0.58541020
GAUSS_FAR = 0.13819660
GAUSS_WEIGHT = 1.0 / 24.0
DEGENERATE = 1e-30

# Mid-edge node between each pair of corners (local numbering).
MID_EDGE = {(0, 1): 4, (1, 2): 5, (0, 2): 6, (0, 3): 7, (1, 3): 8, (2, 3): 9}

STRAINS = tuple(f"e_{name}" for name in VOIGT)


def _mid(a: int, b: int) -> int:
    return MID_EDGE[min(a, b), max(a, b)]


def _mids(vertex: int) -> list[int]:
    return [_mid(vertex, other) for other in range(4) if other != vertex]


def _det(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _matrix(prefix: str) -> list[list[Column]]:
    return [[F.col(f"{prefix}{r}{c}") for c in range(3)] for r in range(3)]


def _cofactor(k: int, r: int) -> Column:
    """Entry (k, r) of the adjugate of J[r][k] = ∂x_k/∂ξ_r."""
    (a, b), (c, d) = [i for i in range(3) if i != r], [i for i in range(3) if i != k]
    j = _matrix("j")
    minor = j[a][c] * j[b][d] - j[a][d] * j[b][c]
    return minor if (k + r) % 2 == 0 else -minor


def _voigt_strain() -> list[Column]:
    """Strain from the scaled cofactors ``i{k}{r}`` and G[r][j] = ∂u_j/∂ξ_r."""

    def slope(j: int, k: int) -> Column:
        return sum(
            (F.col(f"i{k}{r}") * F.col(f"g{r}{j}") for r in (1, 2)), F.col(f"i{k}0") * F.col(f"g0{j}")
        )

    normal = [slope(i, i) for i in range(3)]
    shear = [slope(i, j) + slope(j, i) for i, j in ((0, 1), (1, 2), (0, 2))]
    return normal + shear


def _linear_slopes(points: Column, names: Sequence[str], prefix: str) -> list[Column]:
    return [
        (points[r + 1][n] - points[0][n]).alias(f"{prefix}{r}{c}")
        for r in range(3)
        for c, n in enumerate(names)
    ]


def tet4_volumes(elements: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(sample_id, elem_id, keep…, volume) from the corner nodes."""
    pts = gather_points(_corner_elements(elements), nodes, COORDS, keep)
    jac = pts.select("sample_id", "elem_id", *keep, *_linear_slopes(F.col("points"), COORDS, "j"))
    return jac.select(
        "sample_id", "elem_id", *keep, (F.abs(_det(_matrix("j"))) / 6.0).alias("volume")
    )


def _corner_elements(elements: DataFrame) -> DataFrame:
    return elements.withColumn("nodes", F.slice("nodes", 1, 4))


def tet4_strains(elements: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Constant strain and volume per linear element; zero strain if degenerate."""
    head = ["sample_id", "elem_id", *keep]
    pts = gather_points(_corner_elements(elements), nodes, (*COORDS, *DISP), keep)
    slopes = pts.select(
        *head,
        *_linear_slopes(F.col("points"), COORDS, "j"),
        *_linear_slopes(F.col("points"), DISP, "g"),
    ).withColumn("det", _det(_matrix("j")))
    return _finish(slopes, head, F.abs("det") / 6.0)


def _finish(slopes: DataFrame, head: list[str], volume: Column) -> DataFrame:
    """Strain columns; a vanishing Jacobian scales every cofactor, hence the strain, to 0."""
    flat = F.abs("det") < DEGENERATE
    scaled = slopes.withColumn("_inv", F.when(flat, 0.0).otherwise(F.lit(1.0) / F.col("det")))
    inverse = scaled.withColumns(
        {f"i{k}{r}": _cofactor(k, r) * F.col("_inv") for k in range(3) for r in range(3)}
    )
    return inverse.select(
        *head, volume.alias("volume"), *[e.alias(n) for n, e in zip(STRAINS, _voigt_strain())]
    )


def _integration_points() -> Column:
    """Constant list: per point and vertex, which node the corner formula takes and how."""

    def term(corner: int, vertex: int) -> Column:
        own = corner == vertex
        return F.struct(
            F.lit(corner if own else _mid(corner, vertex)).alias("node"),
            F.lit(3.0 if own else 4.0).alias("times"),
            F.lit(0.0 if own else 1.0).alias("minus"),
        )

    points = [
        F.struct(F.lit(m).alias("gp"), *[term(m, v).alias(f"v{v}") for v in range(4)])
        for m in range(4)
    ]
    return F.explode(F.array(*points))


def _at_integration_points(
    elements: DataFrame, nodes: DataFrame, names: dict[str, Sequence[str]], keep: Sequence[str]
) -> DataFrame:
    """One row per (element, gp) with ∂/∂L_a − ∂/∂L_0 of every value, gp in 0..3."""
    head = ["sample_id", "elem_id", *keep]
    values = [n for group in names.values() for n in group]

    def at(node: Column | int, name: str) -> Column:
        return F.get("points", node if isinstance(node, Column) else F.lit(node))[name]

    far = {
        f"far{v}{n}": F.lit(4.0 * GAUSS_FAR) * sum((at(m, n) for m in _mids(v)[1:]), at(_mids(v)[0], n))
        for v in range(4)
        for n in values
    }
    gathered = gather_points(elements, nodes, values, keep)
    spread = gathered.select(*head, "points", *[c.alias(n) for n, c in far.items()])
    spread = spread.select("*", _integration_points().alias("at"))
    near = F.lit(GAUSS_NEAR - GAUSS_FAR)
    along = {}
    for v in range(4):
        rule = F.col(f"at.v{v}")
        for n in values:
            corner = rule["times"] * at(rule["node"], n) - rule["minus"] * at(v, n)
            along[f"d{v}{n}"] = near * corner + F.col(f"far{v}{n}")
    derived = spread.select(*head, "at.gp", *[c.alias(n) for n, c in along.items()])
    return derived.select(
        *head,
        "gp",
        *[
            (F.col(f"d{row + 1}{n}") - F.col(f"d0{n}")).alias(f"{prefix}{row}{col}")
            for prefix, group in names.items()
            for row in range(3)
            for col, n in enumerate(group)
        ],
    ).withColumn("det", _det(_matrix("j")))


def tet10_volumes(elements: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Volume of quadratic elements by the four-point rule."""
    gp = _at_integration_points(elements, nodes, {"j": COORDS}, keep)
    return gp.groupBy("sample_id", "elem_id", *keep).agg(
        F.sum(F.lit(GAUSS_WEIGHT) * F.abs("det")).alias("volume")
    )


def tet10_point_strains(
    elements: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Strain at each integration point with its weight (``volume``) and ``det``."""
    gp = _at_integration_points(elements, nodes, {"j": COORDS, "g": DISP}, keep)
    head = ["sample_id", "elem_id", *keep, "gp", "det"]
    return _finish(gp, head, F.lit(GAUSS_WEIGHT) * F.abs("det"))


def tet10_strains(
    elements: DataFrame, nodes: DataFrame, keep: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Volume-averaged strain; zero when any integration point is degenerate.

    Small samples are taken whole, in ``parts`` tasks (:func:`strain_parts`) and where they lie; with 0 of them, points are joined.
    """
    parts = strain_parts(elements, nodes) if parts is None else parts
    if parts:
        return _whole_strains(elements, nodes, keep, parts)
    points = tet10_point_strains(elements, nodes, keep)
    flat = F.min(F.abs("det")) < DEGENERATE
    weight = F.sum("volume")
    return points.groupBy("sample_id", "elem_id", *keep).agg(
        weight.alias("volume"),
        *[
            F.when(flat, 0.0).otherwise(F.sum(F.col(e) * F.col("volume")) / weight).alias(e)
            for e in STRAINS
        ],
    )


def strain_parts(elements: DataFrame, nodes: DataFrame) -> int:
    """Partitions by sample in which :func:`tet10_strains` takes samples whole; 0 where one is too large, or columns are of other types."""
    kinds = {df.schema["sample_id"].dataType.simpleString() for df in (elements, nodes)}
    doubles = all(nodes.schema[c].dataType.simpleString() == "double" for c in (*COORDS, *DISP))
    if len(kinds) > 1 or not doubles or not are_long((elements, "nodes"), (nodes, "node_id")):
        return 0
    return whole_parts(stacked(elements.select("sample_id"), nodes.select("sample_id")))


def _whole_strains(elements: DataFrame, nodes: DataFrame, keep: Sequence[str], parts: int) -> DataFrame:
    """:func:`tet10_strains` of samples that a task takes whole, some thousand rows at a time."""
    head = list(dict.fromkeys(["elem_id", *keep]))
    # Rows of one element are one group; the hash stands for all that names it within its sample.
    same = F.xxhash64(*[c for n in head for c in (F.col(n), F.col(n).isNull())]).alias("_same")
    rows = stacked(
        elements.select("sample_id", *dict.fromkeys([*head, "nodes"]), same).where("nodes is not null"),
        nodes.select("sample_id", "node_id", *COORDS, *DISP).where("node_id is not null"),
    )
    gathered, strained, values = _points_of_elements(), _strained(), (*COORDS, *DISP)

    def step(table: pa.Table) -> pa.Table:
        known, null = {}, {}
        own = table["nodes"].combine_chunks().is_null()
        for c in values:
            column = table[c].combine_chunks().filter(own)
            known[c] = column.to_numpy(zero_copy_only=False)
            null[c] = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
        table, at = gathered(table, [known[c] for c in values], [null[c] for c in values])
        made = {c: table[c] for c in ["sample_id", *head]}
        return pa.table(made | strained(known, null, at))

    kinds = [f"{n} {elements.schema[n].dataType.simpleString()}" for n in ["sample_id", *head]]
    return by_sample(rows, parts, step, ", ".join([*kinds, *[f"{n} double" for n in ("volume", *STRAINS)]]))


def _points_of_elements() -> Callable[..., tuple]:
    """A function that gathers what :func:`gather_points` does: elements (one row a group) and the node rows of their first ten points,
    -1 for elements of fewer."""
    width = 10
    numbered = mesh_places(None)

    def gathered(table: pa.Table, values: list, nulls: list) -> tuple:
        _, code, own, first, matrix, _, names = numbered(table)
        table = table.filter(pa.array(~own))
        same = np.stack([code[~own], table["_same"].to_numpy()])
        order = np.lexsort(same[::-1])
        new = np.append(True, (np.diff(same[:, order]) != 0).any(0))[: len(order)]
        times = np.bincount(first, minlength=len(names))
        by_place = np.argsort(first, kind="stable")
        begin = np.cumsum(times) - times
        if matrix.shape[1] == width and new.all() and (matrix >= 0).all() and (times[matrix] == 1).all():
            return table, by_place[begin[matrix]]
        group, least = np.empty(len(order), np.int64), order[new]
        group[order] = np.cumsum(new) - 1
        element, local = np.nonzero(matrix >= 0)
        place = matrix[element, local]
        n = times[place]
        again = np.repeat(np.arange(len(place)), n)
        row = by_place[begin[place[again]] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)]
        group, local = group[element[again]], local[again]
        keys = [group, local]
        for v, none in zip(values, nulls):
            keys += [v[row]] if none is None else [~none[row], np.where(none[row], 0.0, v[row])]
        order = np.lexsort(keys[::-1])
        group, row = group[order], row[order]
        held = np.bincount(group, minlength=len(least))
        at = np.full((len(least), width), -1)
        full = held >= width
        start = (np.cumsum(held) - held)[full]
        at[full] = row[start[:, None] + np.arange(width)]
        return table.take(pa.array(least[held > 0])), at[held > 0]

    return gathered


def _strained() -> Callable[[dict, dict, np.ndarray], dict]:
    """A function that gives volume and strains of elements, by the formulas and in the order of operations of the columns above. A null
    coordinate makes all null, a null displacement the strains that take it."""
    coords, disp, names = COORDS, DISP, STRAINS
    near, far, weight, degenerate = GAUSS_NEAR - GAUSS_FAR, 4.0 * GAUSS_FAR, GAUSS_WEIGHT, DEGENERATE
    mid = {(a, b): _mid(a, b) for a in range(4) for b in range(4) if a != b}
    mids = [_mids(v) for v in range(4)]
    shears = ((0, 1), (1, 2), (0, 2))

    def strained(known: dict, null: dict, at: np.ndarray) -> dict:
        lacking = at[:, 0] < 0
        nodes = np.where(at < 0, 0, at).T

        def any_null(c: str) -> np.ndarray:
            return lacking if null[c] is None else lacking | null[c][nodes].any(0)

        def slopes(c: str) -> list:
            """Of each integration point, the three slopes of a value."""
            if not len(known[c]):
                return [[np.zeros(len(at))] * 3] * 4
            f = known[c][nodes]
            wide = [far * (f[mids[v][0]] + f[mids[v][1]] + f[mids[v][2]]) for v in range(4)]
            points = []
            for m in range(4):
                d = [
                    near * ((3.0 * f[m] - 0.0 * f[v]) if v == m else (4.0 * f[mid[m, v]] - 1.0 * f[v])) + wide[v]
                    for v in range(4)
                ]
                points.append([d[r + 1] - d[0] for r in range(3)])
            return points

        x, u = [slopes(c) for c in coords], [slopes(c) for c in disp]
        volume, least, sums = 0.0, None, [0.0] * 6
        for m in range(4):
            j = [[x[c][m][r] for c in range(3)] for r in range(3)]
            g = [[u[c][m][r] for c in range(3)] for r in range(3)]
            (a, b, c), (d, e, f), (p, h, i) = j
            det = a * (e * i - f * h) - b * (d * i - f * p) + c * (d * h - e * p)
            size = np.abs(det)
            flat = size < degenerate
            inverse = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, det))
            scaled = {}
            for k in range(3):
                for r in range(3):
                    (a, b), (c, d) = [q for q in range(3) if q != r], [q for q in range(3) if q != k]
                    minor = j[a][c] * j[b][d] - j[a][d] * j[b][c]
                    scaled[k, r] = (minor if (k + r) % 2 == 0 else -minor) * inverse

            def slope(v: int, k: int) -> np.ndarray:
                return scaled[k, 0] * g[0][v] + scaled[k, 1] * g[1][v] + scaled[k, 2] * g[2][v]

            part = weight * size
            strains = [slope(v, v) for v in range(3)] + [slope(v, k) + slope(k, v) for v, k in shears]
            volume = volume + part
            sums = [s + e * part for s, e in zip(sums, strains)]
            least = size if least is None else np.fmin(least, size)
        flat = least < degenerate
        whole = any_null(coords[0]) | any_null(coords[1]) | any_null(coords[2])
        gone = [any_null(c) & ~flat for c in disp]
        masks = [whole | gone[v] for v in range(3)] + [whole | gone[v] | gone[k] for v, k in shears]
        divisor = np.where(flat, 1.0, volume)
        made = {n: pa.array(np.where(flat, 0.0, s / divisor), mask=mask) for n, s, mask in zip(names, sums, masks)}
        return {"volume": pa.array(volume, mask=whole)} | made

    return strained
