"""Identifiers, category codes, face names and bucket assignment."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshloom.config import BUCKETS, FAMILIES, Scale

# Face names are axis and side; other surface names carry no load.
FACE_PATTERN = "^[xyz]_(min|max)$"
AXES = ("x", "y", "z")


def code_of(value: Column, names: Sequence[str]) -> Column:
    """Position of ``value`` in ``names``; -1 when unknown or null."""
    pairs = chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(names))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(-1))


def family_code(value: Column) -> Column:
    return code_of(value, FAMILIES)


def bucket_code(value: Column) -> Column:
    return code_of(value, BUCKETS)


def base_id(number: Column) -> Column:
    return F.format_string("base_%06d", number.cast("bigint"))


def fixed(value: Column, digits: int) -> Column:
    """``%.{digits}f`` of a double as C prints it: its exact value, ties to the even digit.

    ``format_string`` rounds the shortest decimal that reads as the double instead, so 0.25 and 0.35 (a little less in
    binary) come out one higher.
    """
    exact = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    return F.when(F.abs(value) < float("inf"), exact).otherwise(F.format_string(f"%.{digits}f", value))


def one_decimal(value: Column) -> Column:
    return fixed(value, 1)


def variant_id(base: Column, safety_factor: Column) -> Column:
    return F.concat(base, F.lit("_sf"), one_decimal(safety_factor))


def load_class(safety_factor: Column) -> Column:
    return F.concat(F.lit("SF_"), one_decimal(safety_factor))


def scale_bucket(length: Column, scale: Scale) -> Column:
    """Half-open buckets; the top edge and anything out of range fall in the last one."""
    chosen = None
    for i, name in enumerate(scale.buckets):
        inside = (length >= scale.edges[i]) & (length < scale.edges[i + 1])
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    return chosen.otherwise(scale.buckets[-1])


def mesh_size(length: Column, scale: Scale) -> Column:
    return F.lit(scale.mesh_size_fraction) * length


def local_mesh_size(global_size: Column, fillet_radius: Column) -> Column:
    """Finer size near a fillet; ``least`` skips a null radius."""
    return F.least(global_size, fillet_radius / 4.0)


def is_valid_face(name: Column) -> Column:
    return name.rlike(FACE_PATTERN)


def face_axis(name: Column) -> Column:
    """0, 1 or 2 for a valid face name, else null."""
    axis = code_of(F.substring(name, 1, 1), AXES)
    return F.when(is_valid_face(name), axis)


def face_side(name: Column) -> Column:
    return F.when(is_valid_face(name), F.substring_index(name, "_", -1))


def valid_faces(names: Column) -> Column:
    return F.filter(names, is_valid_face)
