"""Scalar and vector functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum over an array of doubles."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based place of the largest value, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def gini(counts: Column) -> Column:
    """1 - sum of squared shares of an array of counts; 0 if they are all 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    squares = F.aggregate(counts, F.lit(0.0), lambda s, x: s + (x / total) * (x / total))
    return F.when(total > 0, 1.0 - squares).otherwise(0.0)


def z_scored(values: Column, means: Column, stds: Column) -> Column:
    """(value - mean) / std, elementwise over arrays."""
    return F.zip_with(F.zip_with(values, means, lambda v, m: v - m), stds, lambda v, s: v / s)


def ramp(t: Column, start: float, end: float, final: float) -> Column:
    """0 up to `start`, `final` from `end` on, a straight line between."""
    return F.when(t < start, 0.0).when(t >= end, final).otherwise(F.lit(final) * (t - start) / (end - start))


def heat_color(share: Column) -> Column:
    """#rrggbb between white (0) and solid blue (1); shares outside are clamped."""
    f = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    parts = [F.round(255.0 + (c - 255.0) * f).cast("int") for c in HEAT_END]
    return F.format_string("#%02x%02x%02x", *parts)


#: Fixed value: the color of a full heatmap cell.
HEAT_END = (30, 60, 150)


def severity_order(severity: Column) -> list[Column]:
    """Sort keys: numbers first, by size, then the rest, by text."""
    number = severity.try_cast("double")
    return [number.isNull(), number, severity]


def hold_last(values: Column, length: int) -> Column:
    """The first `length` items of a non-empty array, its last one repeated up to that length."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.element_at(values, -1), missing))
