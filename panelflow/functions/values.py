"""Number coercion and rounding the data rules depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space in the sense of scripts: what a string is stripped of.
SPACE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses it.

    It also keeps long rules out of fused stages, whose generated method the JVM runs without its
    compiler once it is longer than 8000 bytes.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clamp(x: Column, low, high) -> Column:
    """``x`` kept within low..high."""
    return F.least(column(high), F.greatest(column(low), x))


def clamp_finite(x: Column, low, high) -> Column:
    """Like :func:`clamp`; anything that is no finite number becomes ``low``."""
    return clamp(F.when(is_finite(x), x).otherwise(column(low).cast("double")), low, high)


def or_zero(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.lit(0.0))


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def tenth(x: Column) -> Column:
    return half_up(x * F.lit(10)) / F.lit(10)


def clamp_setting(value: Column, low: int, high: int, default: int) -> Column:
    """An integer setting: non-integers fall back to ``default``, others are clamped."""
    whole = is_finite(value) & (value == F.floor(value))
    return F.when(whole, clamp(value, low, high)).otherwise(F.lit(default)).cast("bigint")


def bounded_setting(value: Column, low: int, high: int, default: int) -> Column:
    """An integer setting where being out of range also means ``default`` (a port)."""
    whole = is_finite(value) & (value == F.floor(value))
    return F.when(whole & value.between(low, high), value).otherwise(F.lit(default)).cast("bigint")


def zero_means_default(value: Column, default) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (value == 0), F.lit(default)).otherwise(value)
