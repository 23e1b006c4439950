"""Six-digit hex colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.values import clamp, half_up, strip_space

HEX = "^#[0-9a-fA-F]{6}$"


def normalize_color(value: Column, fallback) -> Column:
    """The trimmed colour when it is one, else ``fallback``."""
    trimmed = strip_space(value)
    return F.when(trimmed.rlike(HEX), trimmed).otherwise(F.lit(fallback))


def rgb(r, g, b) -> Column:
    return F.struct(F.lit(r).cast("int").alias("r"), F.lit(g).cast("int").alias("g"), F.lit(b).cast("int").alias("b"))


def parse_hex(value: Column, fallback: Column) -> Column:
    """(r, g, b) of a colour written without blanks around it, else ``fallback``."""

    def channel(start: int) -> Column:
        return F.conv(F.substring(value, start, 2), 16, 10).cast("int")

    return F.when(
        value.rlike(HEX), F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"))
    ).otherwise(fallback)


def rgb_to_hex(color: Column) -> Column:
    parts = [clamp(half_up(color[c].cast("double")), F.lit(0), F.lit(255)).cast("int") for c in ("r", "g", "b")]
    return F.format_string("#%02x%02x%02x", *parts)


def color_distance(a: Column, b: Column) -> Column:
    squares = [F.pow((a[c] - b[c]).cast("double"), F.lit(2.0)) for c in ("r", "g", "b")]
    return F.sqrt(squares[0] + squares[1] + squares[2])
