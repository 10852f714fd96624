"""Scalar Column functions: distances, voxels, millimetres, directions."""

from __future__ import annotations

from math import tau

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    x = _c(x).cast("double")
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantize(x: Column | str, cell: float) -> Column:
    """The voxel of a coordinate; a non-finite quotient is voxel 0."""
    q = _c(x).cast("double") / F.lit(float(cell))
    return F.when(finite(q), F.floor(q)).otherwise(F.lit(0).cast("long"))


def millimetres(x: Column | str) -> Column:
    """Rounded half away from zero; non-finite counts as 0."""
    x = _c(x).cast("double") * 1000
    return F.when(finite(x), F.round(x).cast("long")).otherwise(F.lit(0).cast("long"))


def squared(a: str, b: str) -> Column:
    """Squared distance of the points in columns ``a``x, ``a``y, ``a``z and b's."""
    return sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "yz"), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))


def distance(a: str, b: str) -> Column:
    return F.sqrt(squared(a, b))


def horizontal(a: str, b: str) -> Column:
    """Distance in the ground plane; y is up."""
    dx, dz = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}z") - F.col(f"{b}z")
    return F.sqrt(dx * dx + dz * dz)


def direction_bucket(dx: Column, dz: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal sectors, counted from +x towards +z."""
    angle = F.atan2(dz, dx)
    turned = F.when(angle < 0, angle + F.lit(tau)).otherwise(angle)
    return F.floor(turned * buckets / F.lit(tau)) % F.lit(max(1, buckets))


def lerp(low: float, high: float, t: Column) -> Column:
    return F.lit(low) + F.lit(high - low) * t


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))
