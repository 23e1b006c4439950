"""Caption fit: which size a translation can be set at, and whether it overflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.text import (
    CHAR_WIDTH, MIN_FONT, fit_horizontal, fit_vertical, render_orientation, wrap_text,
)


def fit_captions(regions: DataFrame) -> DataFrame:
    """Add ``render``, ``size``, ``lines`` (set horizontally) and ``overflow`` to pixel regions."""
    text, width, height = F.col("translated"), F.col("layout_width"), F.col("layout_height")
    placed = regions.withColumn(
        "render", render_orientation(text, F.col("orientation"), F.col("region_kind"), width, height))
    turned = (F.col("orientation") == "vertical") & (F.col("render") == "horizontal")
    largest = F.when(turned, F.col("font_px") * 0.9).otherwise(F.col("font_px"))
    fitted = placed.withColumn(
        "__fit",
        F.when(F.col("render") == "vertical", fit_vertical(text, F.col("font_px"), width, height))
        .otherwise(fit_horizontal(text, largest, width, height)),
    ).withColumn("size", F.coalesce("__fit", F.lit(float(MIN_FONT)))).withColumn("overflow", F.col("__fit").isNull())
    limit = F.greatest(F.lit(1), F.floor(
        F.greatest(F.col("size"), width - width * 0.08 * 2) / (F.col("size") * CHAR_WIDTH))).cast("int")
    return fitted.withColumn(
        "lines", F.when(F.col("render") == "horizontal", wrap_text(text, limit))).drop("__fit")


def overflow_rates(captions: DataFrame) -> DataFrame:
    return captions.groupBy("region_kind").agg(
        F.count(F.lit(1)).alias("n_captions"), F.count_if("overflow").alias("n_overflow"),
        F.avg(F.col("overflow").cast("double")).alias("overflow_rate"), F.avg("size").alias("mean_size"),
    )
