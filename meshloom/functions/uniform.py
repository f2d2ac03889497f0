"""Stateless draws: a value depends only on (seed, key, draw name).

A draw can be repeated on any executor, in any order and after any restart,
which a sequential generator cannot offer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def shuffle_key(seed: int | str, key: Column | str, draw: Column | str = "order") -> Column:
    """Hex digest that orders rows like a seeded shuffle. ``draw`` is a literal if a str."""
    tag = draw if isinstance(draw, Column) else F.lit(draw)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _col(key).cast("string"), tag.cast("string")))


def uniform(seed: int | str, key: Column | str, draw: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the digest."""
    head = F.substring(shuffle_key(seed, key, draw), 1, 13)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def log_between(u: Column, low: Column | float, high: Column | float) -> Column:
    """Log-uniform value in [low, high)."""
    lo = F.log(low if isinstance(low, Column) else F.lit(float(low)))
    hi = F.log(high if isinstance(high, Column) else F.lit(float(high)))
    return F.exp(lo + u * (hi - lo))


def integer_between(u: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high], both ends included."""
    return (F.lit(low) + F.floor(u * F.lit(float(high - low + 1)))).cast("int")


def unit_direction(seed: int | str, key: Column | str) -> Column:
    """Uniform direction on the sphere as struct(x, y, z): three normals, normalised."""

    def normal(radius_draw: str, angle_draw: str, wave) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, key, radius_draw)))
        return radius * wave(F.lit(2.0 * math.pi) * uniform(seed, key, angle_draw))

    x = normal("dir_r1", "dir_a1", F.cos)
    y = normal("dir_r1", "dir_a1", F.sin)
    z = normal("dir_r2", "dir_a2", F.cos)
    return normalised(x, y, z)


def normalised(x: Column, y: Column, z: Column) -> Column:
    """Unit vector along (x, y, z); a vanishing vector becomes the x axis."""
    norm = F.sqrt(x * x + y * y + z * z)
    tiny = norm < 1e-10
    return F.struct(
        F.when(tiny, 1.0).otherwise(x / norm).alias("x"),
        F.when(tiny, 0.0).otherwise(y / norm).alias("y"),
        F.when(tiny, 0.0).otherwise(z / norm).alias("z"),
    )
