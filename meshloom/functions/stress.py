"""Stress and strain algebra on Voigt components [xx, yy, zz, xy, yz, xz].

Shear strain is engineering shear (twice the tensor component).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshloom.config import Material

VOIGT = ("xx", "yy", "zz", "xy", "yz", "xz")


def components(prefix: str) -> list[Column]:
    """The six columns ``prefix_xx`` … ``prefix_xz``."""
    return [F.col(f"{prefix}_{name}") for name in VOIGT]


def von_mises(s: Sequence[Column]) -> Column:
    xx, yy, zz, xy, yz, xz = s
    normal = (xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)
    shear = xy * xy + yz * yz + xz * xz
    return F.sqrt(F.lit(0.5) * (normal + F.lit(6.0) * shear))


def voigt_to_tensor(v: Sequence[Column], engineering: bool = False) -> Column:
    """Symmetric 3×3 as nested arrays; ``engineering`` halves the shears (strain)."""
    xx, yy, zz, xy, yz, xz = v
    if engineering:
        xy, yz, xz = xy / 2.0, yz / 2.0, xz / 2.0
    return F.array(F.array(xx, xy, xz), F.array(xy, yy, yz), F.array(xz, yz, zz))


def tensor_to_voigt(t: Column, engineering: bool = False) -> list[Column]:
    factor = 2.0 if engineering else 1.0
    normal = [t[i][i] for i in range(3)]
    shear = [t[i][j] * F.lit(factor) for i, j in ((0, 1), (1, 2), (0, 2))]
    return normal + shear


def hooke(strain: Sequence[Column], material: Material) -> list[Column]:
    """Isotropic linear-elastic stress from Voigt strain."""
    lam, mu = F.lit(material.lame_lambda), F.lit(material.lame_mu)
    trace = strain[0] + strain[1] + strain[2]
    normal = [lam * trace + F.lit(2.0) * mu * e for e in strain[:3]]
    return normal + [mu * g for g in strain[3:]]


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def safety_factor(sigma_yield: float, vm: Column) -> Column:
    """Pointwise yield/von Mises ratio; null where the stress vanishes."""
    return F.when(vm > 0, F.lit(sigma_yield) / vm)
