"""Order-dependent running values that stay parallel inside one hot key.

A plain window over ``keys`` puts a whole key into one task. Here rows are cut
into blocks along the ordering (``block`` must never decrease with ``order``),
each (key, block) is one window partition, and what flows from block to block is
computed on the small per-block summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 262_144


def block_of(order: str | Column, rows: int = BLOCK_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(rows)).cast("bigint")


def _before(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row of its key."""
    keys = list(keys)
    rows = df.withColumn("__block", block_of(order) if block is None else block).withColumn("__value", value)
    carried = (
        rows.groupBy(*keys, "__block")
        .agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(_before(keys)))
        .drop("__last")
    )
    inside = (
        Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(carried, [*keys, "__block"], "left")
        .withColumn(out, F.coalesce(F.last("__value", ignorenulls=True).over(inside), F.col("__carry")))
        .drop("__block", "__value", "__carry")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key up to and including this one."""
    keys = list(keys)
    rows = df.withColumn("__block", block_of(order) if block is None else block).withColumn("__value", value)
    carried = (
        rows.groupBy(*keys, "__block")
        .agg(F.sum("__value").alias("__total"))
        .withColumn("__carry", F.coalesce(F.sum("__total").over(_before(keys)), F.lit(0)))
        .drop("__total")
    )
    inside = (
        Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(carried, [*keys, "__block"], "left")
        .withColumn(out, F.sum("__value").over(inside) + F.col("__carry"))
        .drop("__block", "__value", "__carry")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, block: Column
) -> DataFrame:
    """Add ``out``: 1, 2, 3... per key in ``order``; ``block`` rises with ``order``."""
    keys = list(keys)
    rows = df.withColumn("__block", block)
    offsets = (
        rows.groupBy(*keys, "__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "__block"], "left")
        .withColumn(out, F.row_number().over(inside).cast("bigint") + F.col("__offset"))
        .drop("__block", "__offset")
    )
