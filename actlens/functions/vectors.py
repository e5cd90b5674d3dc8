"""Column functions on vectors (arrays of doubles); all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, of) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + of(v))


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b), lambda v: v)


def l2_norm(x: Column) -> Column:
    return F.sqrt(_sum(x, lambda v: v * v))


def rms(x: Column) -> Column:
    """Root of the mean square; null for an empty vector."""
    return F.sqrt(_sum(x, lambda v: v * v) / F.when(F.size(x) > 0, F.size(x)))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def squared_error(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), lambda v: v)


def nmse(recon: Column, target: Column, floor: float = 1e-8) -> Column:
    """Mean squared error of a row over its mean square, which counts as ``floor`` at least."""
    return squared_error(recon, target) / F.size(target) / F.greatest(_sum(target, lambda v: v * v) / F.size(target), F.lit(floor))


def l1_ratio(z: Column, x: Column, floor: float = 1e-8) -> Column:
    """Sum of absolute codes over the input's norm."""
    return _sum(z, F.abs) / F.greatest(l2_norm(x), F.lit(floor))


def unit_norm(x: Column, eps: float = 1e-8) -> Column:
    return F.transform(x, lambda v: v / (l2_norm(x) + eps))


def tangent(gradient: Column, w: Column) -> Column:
    """The gradient without its part along the unit vector ``w``."""
    along = dot(gradient, w)
    return F.zip_with(gradient, w, lambda g, v: g - along * v)
