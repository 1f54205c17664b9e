"""Predicates and conversions for numeric columns in which NaN, infinity and null all mean "not known"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*columns: Column) -> Column:
    """Whether all are known and finite; never null."""
    found = F.lit(True)
    for c in columns:
        found &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(found, F.lit(False))


def known(c: Column) -> Column:
    """``c`` with null for NaN and infinity."""
    return F.when(finite(c), c)


def lenient_double(c: Column) -> Column:
    """A text or number as a finite double, else null."""
    return known(c.try_cast("double"))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def crop_window(start: Column, end: Column, size: Column) -> Column:
    """struct(first, past) of pixels for fractions of an axis: within it, one pixel at least; null if end <= start."""
    f0, f1 = clamp(start, 0.0, 1.0), clamp(end, 0.0, 1.0)
    first = clamp((size * f0).cast("int"), 0, size - 1)
    past = clamp((size * f1).cast("int"), first + 1, size)
    return F.when(finite(start, end) & (f1 > f0), F.struct(first.alias("first"), past.alias("past")))


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def to_unit(x: Column, size: Column) -> Column:
    """A pixel coordinate on [-1, 1]."""
    return F.lit(2.0) * x / F.greatest(size - 1, F.lit(1)) - F.lit(1.0)


def from_unit(u: Column, size: Column) -> Column:
    return (u + F.lit(1.0)) * F.greatest(size - 1, F.lit(1)) / F.lit(2.0)


def from_bottom(y: Column, height: Column) -> Column:
    """A row counted from the other edge."""
    return height - y


def normalised_time(index: Column, n: Column) -> Column:
    """An index of 0 to n - 1 on [-1, 1]; 0 where there is but one."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.lit(2.0) * index / (n - 1).cast("double") - F.lit(1.0))


def accepted_count(n: Column, least: int, ratio: float) -> Column:
    """How many of ``n`` are enough: ``least`` or a share of them, one at least and ``n`` at most."""
    return F.least(n, F.greatest(F.lit(1), F.lit(least), F.ceil(n * F.lit(ratio)).cast("long")))


def fixed(c: Column, decimals: int = 6) -> Column:
    """Rounded half up in binary arithmetic, without negative zero: the same in any engine."""
    k = 10.0**decimals
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k) + F.lit(0.0)
