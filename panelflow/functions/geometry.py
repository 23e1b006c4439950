"""Boxes: 0..1000 arrays ``[xmin, ymin, xmax, ymax]`` and pixel structs left/top/right/bottom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.values import clamp, clamp_finite, half_up, let, or_zero, tenth

EDGES = ("left", "top", "right", "bottom")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def normalize_box(values: Column) -> Column:
    """Clamp to 0..1000 and sort the corners; null unless four values spanning two units."""
    corners = F.struct((F.size(values) == 4).alias("four"), *[
        clamp_finite(F.get(values, F.lit(i)), 0.0, 1000.0).alias(f"v{i}") for i in range(4)])

    def placed(c: Column) -> Column:
        v = [c[f"v{i}"] for i in range(4)]
        big = (F.abs(v[2] - v[0]) >= 2) & (F.abs(v[3] - v[1]) >= 2)
        return F.when(c["four"] & big, box(
            F.least(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[0], v[2]), F.greatest(v[1], v[3])))

    return let(corners, placed)


def box_to_pixels(values: Column, image_width: Column, image_height: Column) -> Column:
    """0..1000 array to whole pixels, outwards; null unless four values spanning two pixels."""
    v = [clamp(or_zero(F.get(values, F.lit(i))), 0.0, 1000.0) for i in range(4)]
    left = F.floor(F.least(v[0], v[2]) / 1000 * image_width)
    top = F.floor(F.least(v[1], v[3]) / 1000 * image_height)
    right = F.ceil(F.greatest(v[0], v[2]) / 1000 * image_width)
    bottom = F.ceil(F.greatest(v[1], v[3]) / 1000 * image_height)
    big = (right - left >= 2) & (bottom - top >= 2)
    return F.when((F.size(values) == 4) & big, box(left, top, right, bottom))


def with_pixel_box(df: DataFrame, values: str, out: str, image_width: Column, image_height: Column) -> DataFrame:
    """:func:`box_to_pixels` as a column, worked out step by step so that no step is
    evaluated more than once per row, however often its result is used.

    The generator keeps filters from being pushed below it, and as an array function it ends the fused stage, whose
    generated method the JVM runs without its compiler once it is longer than 8000 bytes.
    """
    corner, edge = [f"__{out}_v{i}" for i in range(4)], {e: f"__{out}_{e}" for e in EDGES}
    v = [F.col(c) for c in corner]
    kept = df.columns
    clamped = df.select("*", *[
        clamp(or_zero(F.get(F.col(values), F.lit(i))), 0.0, 1000.0).alias(corner[i]) for i in range(4)])
    edged = clamped.select(
        *kept,
        F.floor(F.least(v[0], v[2]) / 1000 * image_width).alias(edge["left"]),
        F.floor(F.least(v[1], v[3]) / 1000 * image_height).alias(edge["top"]),
        F.ceil(F.greatest(v[0], v[2]) / 1000 * image_width).alias(edge["right"]),
        F.ceil(F.greatest(v[1], v[3]) / 1000 * image_height).alias(edge["bottom"]),
    )
    at = {e: F.col(c) for e, c in edge.items()}
    usable = (F.size(values) == 4) & (at["right"] - at["left"] >= 2) & (at["bottom"] - at["top"] >= 2)
    found = F.transform(F.array(F.when(usable, box(*at.values()))), lambda b: F.struct(b.alias(out)))
    return edged.select(*kept, F.inline(found))


def placed_in_anchor(b: Column, crop: Column) -> Column:
    """A normalised box inside an anchor given as left/top/width/height."""
    return F.when(
        b.isNotNull() & crop.isNotNull(),
        F.struct(
            (crop["left"] + b["left"] / 1000 * crop["width"]).alias("left"),
            (crop["top"] + b["top"] / 1000 * crop["height"]).alias("top"),
            ((b["right"] - b["left"]) / 1000 * crop["width"]).alias("width"),
            ((b["bottom"] - b["top"]) / 1000 * crop["height"]).alias("height"),
        ),
    )


def map_to_anchor(values: Column, crop: Column) -> Column:
    """A 0..1000 box placed inside an anchor given as left/top/width/height."""
    return placed_in_anchor(normalize_box(values), crop)


def font_share(font_size: Column, b: Column, orientation: Column, crop_height: Column) -> Column:
    """Share of the anchor one glyph takes: as reported, else from the normalised box, else 0.03."""
    reported = clamp_finite(font_size, 0.0, 1000.0)
    side = F.when(orientation == "vertical", width(b)).otherwise(height(b))
    return (
        F.when(reported > 0, reported / 1000 * crop_height)
        .when(b.isNull(), F.lit(0.03))
        .otherwise(F.greatest(F.lit(0.012), side / 1000 * crop_height * 0.82))
    )


def font_ratio(font_size: Column, values: Column, orientation: Column, crop_height: Column) -> Column:
    """:func:`font_share` of a 0..1000 box."""
    return font_share(font_size, normalize_box(values), orientation, crop_height)


def union_box(a: Column, b: Column) -> Column:
    """Smallest box around both; a missing one counts for nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(
        box(
            F.least(a["left"], b["left"]), F.least(a["top"], b["top"]),
            F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"]),
        )
    )


def boxes_overlap(a: Column, b: Column) -> Column:
    """Strict overlap: touching edges do not count."""
    return (
        (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])
    )


def integer_box(b: Column, image_width: Column, image_height: Column) -> Column:
    return box(
        clamp(F.floor(b["left"]), F.lit(0), image_width - 1), clamp(F.floor(b["top"]), F.lit(0), image_height - 1),
        clamp(F.ceil(b["right"]), F.lit(1), image_width), clamp(F.ceil(b["bottom"]), F.lit(1), image_height),
    )


def intersection_over_union(a: Column, b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])) * F.greatest(
        F.lit(0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    )
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def remap_to_crop(values: Column, crop: Column, image_width: Column, image_height: Column) -> Column:
    """0..1000 of the image to 0..1000 of the crop, in tenths."""
    crop_width = F.greatest(F.lit(1), width(crop))
    crop_height = F.greatest(F.lit(1), height(crop))

    def place(v: Column, i: int, side: Column, start: Column, extent: Column) -> Column:
        return tenth(clamp((F.get(v, F.lit(i)) / 1000 * side - start) / extent * 1000, 0.0, 1000.0))

    def mapped(v: Column) -> Column:
        return F.when(F.size(v) == 4, F.array(
            place(v, 0, image_width, crop["left"], crop_width), place(v, 1, image_height, crop["top"], crop_height),
            place(v, 2, image_width, crop["left"], crop_width), place(v, 3, image_height, crop["top"], crop_height),
        )).otherwise(v)

    return let(values, mapped)


def remap_to_batch(values: Column, tile: Column, sheet_width: Column, sheet_height: Column) -> Column:
    """0..1000 of a crop to 0..1000 of the sheet its tile lies on, in tenths."""

    def place(v: Column, i: int, start: Column, extent: Column, side: Column) -> Column:
        return tenth(clamp((start + F.get(v, F.lit(i)) / 1000 * extent) / side * 1000, 0.0, 1000.0))

    def mapped(v: Column) -> Column:
        return F.when(F.size(v) == 4, F.array(
            place(v, 0, tile["left"], tile["width"], sheet_width), place(v, 1, tile["top"], tile["height"], sheet_height),
            place(v, 2, tile["left"], tile["width"], sheet_width), place(v, 3, tile["top"], tile["height"], sheet_height),
        )).otherwise(v)

    return let(values, mapped)


def rescale(size: Column, scale: Column) -> Column:
    """A font size or stroke width carried into another frame, in tenths."""
    return tenth(clamp(or_zero(size) * scale, 0.0, 1000.0))


def format_box(values: Column, separator: str = ",", missing: str = "") -> Column:
    """The four values in tenths, joined; whole numbers without a decimal point."""
    texts = F.transform(values, lambda v: F.regexp_replace(tenth(v).cast("string"), r"\.0$", ""))
    return F.when(values.isNull(), F.lit(missing)).otherwise(F.array_join(texts, separator))


def search_box(region: dict[str, Column]) -> Column:
    """Where original ink is looked for: the box, stretched along the reading axis to
    the layout area for text on plain ground outside speech balloons."""
    own = box(region["left"], region["top"], region["right"], region["bottom"])
    layout = [region[f"layout_{e}"] for e in EDGES]
    plain = ~F.coalesce(region["background_complex"], F.lit(False)) & layout[0].isNotNull()
    for edge in layout[1:]:
        plain = plain & edge.isNotNull()
    tall = box(region["left"], F.least(region["top"], layout[1]), region["right"], F.greatest(region["bottom"], layout[3]))
    wide = box(F.least(region["left"], layout[0]), region["top"], F.greatest(region["right"], layout[2]), region["bottom"])
    return (
        F.when((region["region_kind"] == "dialogue") | ~plain, own)
        .when(region["orientation"] == "vertical", tall)
        .otherwise(wide)
    )


def recenter(region_box: Column, bounds: Column, image_width: Column, image_height: Column) -> Column:
    """The box moved to the centre of measured ink: never shrunk, kept inside the image."""
    w = F.least(image_width, F.greatest(width(region_box), width(bounds)))
    h = F.least(image_height, F.greatest(height(region_box), height(bounds)))
    left = clamp((bounds["left"] + bounds["right"]) / 2 - w / 2, F.lit(0.0), F.greatest(F.lit(0.0), image_width - w))
    top = clamp((bounds["top"] + bounds["bottom"]) / 2 - h / 2, F.lit(0.0), F.greatest(F.lit(0.0), image_height - h))
    return box(left, top, left + w, top + h)


def ocr_size(image_width: Column, image_height: Column) -> Column:
    """(width, height, scale) of the enlarged reading copy of a picture."""
    w = F.greatest(F.lit(1.0), half_up(or_zero(F.when(image_width == 0, 1).otherwise(image_width).cast("double"))).cast("double"))
    h = F.greatest(F.lit(1.0), half_up(or_zero(F.when(image_height == 0, 1).otherwise(image_height).cast("double"))).cast("double"))
    long_side = F.greatest(w, h)
    # Steps of the enlargement, and the limits of 4096 a side and 16 million pixels
    wanted = (
        F.when(long_side < 1000, F.least(F.lit(4.0), F.lit(1600) / long_side))
        .when(long_side < 1800, F.lit(2400) / long_side)
        .when(long_side < 2600, F.lit(1.35))
        .otherwise(F.lit(1.0))
    )
    scale = F.greatest(
        F.lit(0.01), F.least(wanted, F.lit(4096) / long_side, F.sqrt(F.lit(16_000_000) / (w * h)))
    )
    return F.struct(
        F.greatest(F.lit(1), half_up(w * scale)).cast("bigint").alias("width"),
        F.greatest(F.lit(1), half_up(h * scale)).cast("bigint").alias("height"),
        scale.alias("scale"),
    )


def source_size(image_width: Column, image_height: Column, mime: Column, payload_length: Column) -> Column:
    """(action keep|convert, width, height) for a picture about to be sent on."""
    longest = F.greatest(image_width, image_height)
    pixels = image_width * image_height
    keep = (
        F.lower(mime).isin("image/jpeg", "image/png", "image/webp")
        & (longest <= 8192) & (pixels <= 32_000_000) & (payload_length <= 18_500_000)
    )
    scale = F.least(F.lit(1.0), F.lit(8192) / longest, F.sqrt(F.lit(32_000_000) / pixels))
    return F.struct(
        F.when(keep, "keep").otherwise("convert").alias("action"),
        F.when(keep, image_width).otherwise(F.greatest(F.lit(1), half_up(image_width * scale))).cast("bigint").alias("width"),
        F.when(keep, image_height).otherwise(F.greatest(F.lit(1), half_up(image_height * scale))).cast("bigint").alias("height"),
    )
