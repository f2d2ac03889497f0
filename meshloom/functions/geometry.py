"""Derived dimensions of the parametric solids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bar_thickness(
    length: Column, aspect_ratio: Column, cross_aspect: Column, max_hole_fraction: Column
) -> Column:
    """Smallest net cross-section of a bar; ``max_hole_fraction`` is null without holes."""
    height = length / aspect_ratio
    width = height * cross_aspect
    solid = F.least(height, width)
    net_height = height - F.lit(2.0) * max_hole_fraction * solid
    drilled = F.least(solid, F.greatest(net_height, F.lit(0.1) * solid))
    return F.when(max_hole_fraction.isNull(), solid).otherwise(drilled)


def plate_thickness(length: Column, fraction: Column) -> Column:
    return length * fraction


def section_depth(length: Column, notch_depth_fraction: Column) -> Column:
    return length - notch_depth_fraction * length


def bracket_fillet_radius(
    length: Column,
    width_aspect: Column,
    notch_depth_fraction: Column,
    notch_width_fraction: Column,
    radius_ratio: Column,
) -> Column:
    """r/d times the section depth, kept below 90 % of the smallest notch dimension."""
    depth = section_depth(length, notch_depth_fraction)
    notch_depth = notch_depth_fraction * length
    notch_width = notch_width_fraction * width_aspect * length
    return F.least(radius_ratio * depth, F.least(notch_depth, notch_width, depth) * 0.9)


def fillet_is_resolved(radius: Column, mesh_size: Column) -> Column:
    return radius >= mesh_size * 0.5


def block_fillet_radius(min_dim: Column, fraction: Column) -> Column:
    return F.least(fraction * min_dim, F.lit(0.45) * min_dim)


def block_fillet_applied(radius: Column, mesh_size: Column) -> Column:
    return radius > mesh_size * 0.3
