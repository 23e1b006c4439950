"""Screening of page pictures on pixel tables (image_id, y, x, ...), many pages at once.

Nothing gathers an image: rows are cut by image line, by tile or by region window, and
what needs neighbours works on the few set pixels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.functions.color import color_distance, parse_hex, rgb
from panelflow.functions.values import clamp, half_up, or_zero
from panelflow.operators.components import connected_components

# What is dark, what is bright, and which tiles may hold bright text.
DARK, BRIGHT = 50, 205
MIN_DARK, MIN_BRIGHT, MIN_TRANSITIONS = 0.24, 0.012, 0.003
MAX_TILES = 4
DARK_INK, LIGHT_INK = 145, 205
MIN_RUN = 12
LINE_BIN = 64


# ---------------------------------------------------------------------- tiles

def _grid(sizes: DataFrame, *keep: str) -> DataFrame:
    columns = F.when(F.col("width") >= F.col("height"), 3).otherwise(2)
    return sizes.select(
        "image_id", *keep, "width", "height", columns.alias("columns"),
        F.greatest(F.lit(2), F.ceil(F.col("height") / F.greatest(F.lit(1.0), F.col("width") / columns))).cast("int").alias("rows"),
    )


def tile_stats(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per tile: dark, bright and bright/not-bright transition ratios inside the tile.

    Pixels that carry their page's ``width`` and ``height`` need no ``sizes`` and no join.

    A bright pixel next to a pixel of its own tile is a transition unless both are bright,
    so transitions = neighbours of bright pixels - 2 x bright neighbour pairs: the whole
    picture is only summed up, and just bright pixels are ordered along their lines.
    """
    gridded = _grid(pixels, "y", "x", "v") if sizes is None else pixels.join(_grid(sizes), "image_id")
    placed = gridded.select(
        "image_id", "y", "x", "v", "width", "height", "columns", "rows",
        F.floor(((F.col("x") + 1) * F.col("columns") - 1) / F.col("width")).cast("int").alias("column"),
        F.floor(((F.col("y") + 1) * F.col("rows") - 1) / F.col("height")).cast("int").alias("row"),
    ).select(
        "*",
        F.floor(F.col("column") * F.col("width") / F.col("columns")).cast("bigint").alias("left"),
        F.floor(F.col("row") * F.col("height") / F.col("rows")).cast("bigint").alias("top"),
        F.floor((F.col("column") + 1) * F.col("width") / F.col("columns")).cast("bigint").alias("right"),
        F.floor((F.col("row") + 1) * F.col("height") / F.col("rows")).cast("bigint").alias("bottom"),
    )
    left, up = F.col("x") > F.col("left"), F.col("y") > F.col("top")
    right, down = F.col("x") < F.col("right") - 1, F.col("y") < F.col("bottom") - 1
    bright = F.col("v") > BRIGHT

    def number(*conditions: Column) -> Column:
        total = F.lit(0)
        for c in conditions:
            total = total + c.cast("int")
        return total

    tile = ["image_id", "row", "column"]
    sums = placed.groupBy(*tile, "left", "top", "right", "bottom", "width", "height").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("v") < DARK).alias("dark"), F.count_if(bright).alias("bright"),
        F.sum(number(left, up)).alias("comparisons"),
        F.sum(F.when(bright, number(left, right, up, down)).otherwise(0)).alias("touches"),
    )
    lit = placed.where(bright).select(*tile, "x", "y")
    along = Window.partitionBy(*tile, "y").orderBy("x")
    down_ = Window.partitionBy(*tile, "x").orderBy("y")
    sideways = lit.withColumn("pair", (F.lag("x").over(along) == F.col("x") - 1).cast("int"))
    upright = lit.withColumn("pair", (F.lag("y").over(down_) == F.col("y") - 1).cast("int"))
    pairs = sideways.select(*tile, "pair").unionByName(upright.select(*tile, "pair")).groupBy(*tile).agg(
        F.sum(F.coalesce("pair", F.lit(0))).alias("pairs"))
    rows = sums.join(pairs, tile, "left").withColumn(
        "transitions", F.col("touches") - 2 * F.coalesce("pairs", F.lit(0)))
    return rows.select(
        *tile, "left", "top", "right", "bottom", "width", "height",
        (F.col("dark") / F.greatest(F.lit(1), "total")).alias("dark_ratio"),
        (F.col("bright") / F.greatest(F.lit(1), "total")).alias("bright_ratio"),
        (F.col("transitions") / F.greatest(F.lit(1), "comparisons")).alias("transition_ratio"),
    )


def score_tiles(stats: DataFrame, limit: int = MAX_TILES) -> DataFrame:
    """The up to ``limit`` best tiles of each image that may hold bright text, padded by 8 %."""
    kept = stats.where(
        (F.col("dark_ratio") >= MIN_DARK) & (F.col("bright_ratio") >= MIN_BRIGHT) & (F.col("transition_ratio") >= MIN_TRANSITIONS))
    balance = F.least("dark_ratio", F.lit(0.72)) * F.least("bright_ratio", F.lit(0.38))
    scored = kept.withColumn("score", balance * (1 + F.least(F.lit(2.5), F.col("transition_ratio") * 18)))
    best = Window.partitionBy("image_id").orderBy(F.desc("score"), "row", "column")
    pad_x, pad_y = half_up((F.col("right") - F.col("left")) * 0.08), half_up((F.col("bottom") - F.col("top")) * 0.08)
    return scored.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= max(0, min(MAX_TILES, limit))).select(
        "image_id", "rank", "row", "column", "score", "dark_ratio", "bright_ratio", "transition_ratio", "width", "height",
        F.greatest(F.lit(0), F.col("left") - pad_x).cast("bigint").alias("left"),
        F.greatest(F.lit(0), F.col("top") - pad_y).cast("bigint").alias("top"),
        F.least("width", F.col("right") + pad_x).cast("bigint").alias("right"),
        F.least("height", F.col("bottom") + pad_y).cast("bigint").alias("bottom"),
    )


def map_tiles(tiles: DataFrame, original_width: Column, original_height: Column) -> DataFrame:
    """Tile boxes of the analysed copy carried to the original, and to 0..1000."""

    def near(edge: str, side: str, original: Column) -> Column:
        return F.greatest(F.lit(0), F.least(original - 1, F.floor(F.col(edge) / F.col(side) * original)))

    def extent(low: str, high: str, side: str, original: Column) -> Column:
        return F.greatest(F.lit(1), F.least(original, F.ceil(F.col(high) / F.col(side) * original))
                          - F.greatest(F.lit(0), F.floor(F.col(low) / F.col(side) * original)))

    rows = tiles.withColumn("o_left", near("left", "width", original_width)).withColumn(
        "o_top", near("top", "height", original_height)).withColumn(
        "o_width", extent("left", "right", "width", original_width)).withColumn(
        "o_height", extent("top", "bottom", "height", original_height))

    def unit(value: Column, original: Column) -> Column:
        return half_up(value / original * 1000)

    return rows.withColumn("unit_box", F.array(
        unit(F.col("o_left"), original_width), unit(F.col("o_top"), original_height),
        unit(F.col("o_left") + F.col("o_width"), original_width), unit(F.col("o_top") + F.col("o_height"), original_height)))


def threshold_flags(value: Column) -> Column:
    """(dark, light): set pixels of the two black-and-white reading copies."""
    return F.struct((value < DARK_INK).alias("dark"), (value > LIGHT_INK).alias("light"))


# -------------------------------------------------------------- region windows

def region_windows(regions: DataFrame) -> DataFrame:
    """Search window of each pixel region: its search box plus a margin, inside the image."""
    sought = g.search_box({c: F.col(c) for c in (
        *g.EDGES, *(f"layout_{e}" for e in g.EDGES), "region_kind", "orientation", "background_complex")})
    simple_dialogue = (F.col("region_kind") == "dialogue") & (color_distance(F.col("background_rgb"), rgb(255, 255, 255)) <= 35)
    margin = F.greatest(F.lit(3), half_up(F.col("font_px") * 0.42 + F.col("stroke_px")))
    rows = regions.withColumn("__s", sought).withColumn("__m", margin).withColumn(
        "complex", F.coalesce("background_complex", F.lit(False)) & ~simple_dialogue)
    s, m = F.col("__s"), F.col("__m")
    return rows.select(
        "image_id", "ord", "region_kind", "font_px", "stroke_px", "text_rgb", "stroke_rgb", "background_rgb", "complex",
        *[s[e].cast("double").alias(f"focus_{e}") for e in g.EDGES],
        clamp(s["left"] - m, F.lit(0), F.col("image_width") - 1).cast("bigint").alias("w_left"),
        clamp(s["top"] - m, F.lit(0), F.col("image_height") - 1).cast("bigint").alias("w_top"),
        clamp(s["right"] + m, F.lit(1), F.col("image_width")).cast("bigint").alias("w_right"),
        clamp(s["bottom"] + m, F.lit(1), F.col("image_height")).cast("bigint").alias("w_bottom"),
        "image_width", "image_height",
    )


def _in_boxes(boxes: DataFrame, pixels: DataFrame, edges: tuple[str, str, str, str]) -> DataFrame:
    """Pixels inside boxes of their image, matched by image line and stretch of the line."""
    left, top, right, bottom = (F.col(e) for e in edges)
    lines = boxes.where((right > left) & (bottom > top)).withColumn(
        "y", F.explode(F.sequence(top, bottom - 1))).withColumn(
        "__bin", F.explode(F.sequence(F.floor(left / LINE_BIN), F.floor((right - 1) / LINE_BIN))))
    binned = pixels.withColumn("__bin", F.floor(F.col("x") / LINE_BIN))
    return lines.join(binned, ["image_id", "y", "__bin"]).where((F.col("x") >= left) & (F.col("x") < right)).drop("__bin")


def ink_pixels(windows: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, ord, y, x, ink, candidate): pixels of each window that look like ink, and those
    to look for lines in. Rows that are neither are dropped."""
    held = _in_boxes(windows, pixels, ("w_left", "w_top", "w_right", "w_bottom"))
    own = F.struct("r", "g", "b")
    d = held.select(
        "image_id", "ord", "y", "x", "complex", "font_px", "stroke_px",
        color_distance(own, F.col("text_rgb")).alias("to_text"), color_distance(own, F.col("stroke_rgb")).alias("to_stroke"),
        color_distance(own, F.col("background_rgb")).alias("to_ground"))
    limit = F.when(F.col("complex"), clamp(54 + F.col("font_px") * 0.75, 60.0, 92.0)).otherwise(300.0)
    ink = (F.col("to_text") < limit) | ((F.col("stroke_px") > 0) & (F.col("to_stroke") < limit)) | (
        F.least("to_text", "to_stroke") < F.col("to_ground") * 0.72)
    return d.select(
        "image_id", "ord", "y", "x", ink.alias("ink"),
        F.when(F.col("complex"), ink).otherwise(F.col("to_ground") > 10).alias("candidate"),
    ).where("ink or candidate")


def long_runs(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """Pixels (image_id, ord, y, x) on straight horizontal or vertical runs long enough to be lines."""
    effect = F.col("region_kind") == "sfx"
    by_font = half_up(F.col("font_px") * F.when(effect, 5.5).otherwise(4.0))
    share = F.when(effect, 0.9).otherwise(0.72)

    def least(extent: Column) -> Column:
        return F.greatest(F.lit(MIN_RUN), by_font, half_up(extent * share))

    limits = windows.select("image_id", "ord", least(F.col("w_right") - F.col("w_left")).alias("min_x"),
                            least(F.col("w_bottom") - F.col("w_top")).alias("min_y"))

    def runs(along: str, across: str, limit: str) -> DataFrame:
        line = Window.partitionBy("image_id", "ord", across).orderBy(along)
        islands = pixels.select("image_id", "ord", "y", "x").withColumn("__island", F.col(along) - F.row_number().over(line))
        whole = Window.partitionBy("image_id", "ord", across, "__island")
        return islands.withColumn("__n", F.count(F.lit(1)).over(whole)).join(limits, ["image_id", "ord"]).where(
            F.col("__n") >= F.col(limit)).select("image_id", "ord", "y", "x")

    return runs("x", "y", "min_x").unionByName(runs("y", "x", "min_y")).distinct()


def glyph_components(ink: DataFrame, windows: DataFrame) -> DataFrame:
    """8-connected components of ink pixels per window with size, area and whether they
    look like glyphs.

    Pixels are first packed into horizontal runs; runs of neighbouring lines that touch
    are linked; the links are contracted to components.
    """
    line = Window.partitionBy("image_id", "ord", "y").orderBy("x")
    runs = ink.select("image_id", "ord", "y", "x").withColumn("__island", F.col("x") - F.row_number().over(line)).groupBy(
        "image_id", "ord", "y", "__island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(
        F.struct("image_id", "ord").alias("g"), "y", "x0", "x1", (F.col("y") * F.lit(1 << 24) + F.col("x0")).alias("run"))

    def binned(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / LINE_BIN), F.floor(high / LINE_BIN)))

    above = runs.select("g", (F.col("y") + 1).alias("y"), F.col("run").alias("u"), F.col("x0").alias("a0"), F.col("x1").alias("a1"),
                        binned(F.col("x0") - 1, F.col("x1") + 1).alias("__bin"))
    below = runs.select("g", "y", F.col("run").alias("v"), F.col("x0").alias("b0"), F.col("x1").alias("b1"),
                        binned(F.col("x0"), F.col("x1")).alias("__bin"))
    edges = above.join(below, ["g", "y", "__bin"]).where("a0 <= b1 + 1 and b0 <= a1 + 1").select("g", "u", "v")
    labels = connected_components(edges).select("g", F.col("node").alias("run"), "component")
    parts = runs.join(labels, ["g", "run"], "left").withColumn("component", F.coalesce("component", "run"))
    found = parts.groupBy("g", "component").agg(
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).select("g.image_id", "g.ord", "component", "min_x", "max_x", "min_y", "max_y", "area")
    rows = found.join(windows, ["image_id", "ord"]).select(
        *found.columns, "region_kind", "font_px",
        (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h"),
        (F.col("min_x") - F.col("w_left")).alias("x_min"), (F.col("max_x") - F.col("w_left")).alias("x_max"),
        (F.col("min_y") - F.col("w_top")).alias("y_min"), (F.col("max_y") - F.col("w_top")).alias("y_max"),
        (F.col("w_right") - F.col("w_left")).alias("width"), (F.col("w_bottom") - F.col("w_top")).alias("height"),
        *[(F.col(f"focus_{e}") - F.col(s)).alias(f"f_{e}") for e, s in zip(g.EDGES, ("w_left", "w_top") * 2)],
    )
    c = {n: F.col(n) for n in rows.columns}
    w, h, area, font, width, height = c["w"], c["h"], c["area"], c["font_px"], c["width"], c["height"]
    effect = c["region_kind"] == "sfx"
    edge, reach = F.greatest(F.lit(2.0), font * 0.35), F.greatest(F.lit(3.0), font * 0.55)
    # The shapes that are no glyphs
    art = [
        (w > font * 2.2) & (h < font * 0.42),
        (h > font * 2.2) & (w < font * 0.42),
        (c["region_kind"] == "dialogue") & (F.greatest(w, h) > font * 1.5) & (F.least(w, h) < font * 1.2) & (area / (w * h) < 0.48),
        area > width * height * F.when(effect, 0.72).otherwise(0.42),
        (c["x_max"] < c["f_left"] - reach) | (c["x_min"] > c["f_right"] + reach)
        | (c["y_max"] < c["f_top"] - reach) | (c["y_min"] > c["f_bottom"] + reach),
    ]
    frames = [
        (w > width * 0.68) & (h > height * 0.68),
        (c["x_min"] == 0) & (c["x_max"] == width - 1),
        (c["y_min"] == 0) & (c["y_max"] == height - 1),
        (c["x_min"] <= edge) & (c["x_max"] >= width - 1 - edge) & (w > font * 1.7),
        (c["y_min"] <= edge) & (c["y_max"] >= height - 1 - edge) & (h > font * 1.7),
        (w > font * 2.8) & (h > font * 2.8) & (area > font * font * 1.5),
    ]
    dropped = F.lit(False)
    for rule in art:
        dropped = dropped | rule
    for rule in frames:
        dropped = dropped | (~effect & rule)
    return rows.select(
        "image_id", "ord", "component", "min_x", "min_y", (c["max_x"] + 1).alias("right"), (c["max_y"] + 1).alias("bottom"),
        "area", (area / (w * h)).alias("density"), (~dropped).alias("is_glyph"))


def ink_summary(components: DataFrame, windows: DataFrame) -> DataFrame:
    """Per region: glyph pixels and bounds, whether removing them is safe, and the recentred box."""
    glyphs = components.where("is_glyph").groupBy("image_id", "ord").agg(
        F.sum("area").alias("n_pixels"), F.min("min_x").alias("left"), F.min("min_y").alias("top"),
        F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    rows = windows.join(glyphs, ["image_id", "ord"], "left")
    share = F.when(F.col("region_kind") == "sfx", 0.64).when(F.col("complex"), 0.22).otherwise(0.38)
    most = F.greatest(F.lit(1), half_up(
        (F.col("w_right") - F.col("w_left")) * (F.col("w_bottom") - F.col("w_top")) * share))
    n = F.coalesce("n_pixels", F.lit(0))
    pad = F.greatest(F.lit(2), half_up(F.col("font_px") * 0.09 + F.col("stroke_px")))
    bounds = g.box(
        clamp(F.col("left") - pad, F.lit(0), F.col("image_width")), clamp(F.col("top") - pad, F.lit(0), F.col("image_height")),
        clamp(F.col("right") + pad, F.lit(0), F.col("image_width")), clamp(F.col("bottom") + pad, F.lit(0), F.col("image_height")))
    return rows.select(
        "image_id", "ord", n.alias("n_pixels"), ((n > 0) & (n <= most)).alias("safe"), *[F.col(e) for e in g.EDGES],
        F.when(F.col("n_pixels").isNotNull(), bounds).alias("bounds"))


def mask_bounds() -> list[Column]:
    """Aggregates over mask pixels: bounding box (right and bottom exclusive) and count."""
    return [F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"),
            (F.max("y") + 1).alias("bottom"), F.count(F.lit(1)).alias("n_pixels")]


# ---------------------------------------------------------- text presence gate

def text_targets(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """Where each region's rendered text is expected, and how many pixels it takes at least."""
    sized = regions.withColumn("__w", width).withColumn("__h", height).withColumn("__values", F.coalesce("layout_box", "box"))
    placed = g.with_pixel_box(sized, "__values", "__box", F.col("__w"), F.col("__h")).where("__box is not null")
    b, font = F.col("__box"), or_zero(F.col("font_size")) / 1000 * F.col("__h")
    pad = F.greatest(F.lit(2), half_up(font * 0.12))
    chars = F.length(F.regexp_replace(F.coalesce("translated", F.lit("")), r"(?U)\s+", ""))
    return placed.select(
        "image_id", "ord",
        F.greatest(F.lit(0), b["left"] - pad).cast("bigint").alias("left"), F.greatest(F.lit(0), b["top"] - pad).cast("bigint").alias("top"),
        F.least("__w", b["right"] + pad).cast("bigint").alias("right"), F.least("__h", b["bottom"] + pad).cast("bigint").alias("bottom"),
        parse_hex(F.col("text_color"), rgb(17, 17, 17)).alias("text_rgb"),
        parse_hex(F.col("stroke_color"), rgb(255, 255, 255)).alias("stroke_rgb"),
        (or_zero(F.col("stroke_width")) > 0).alias("use_stroke"),
        F.greatest(F.lit(8), half_up(chars * F.greatest(F.lit(8.0), font * 0.35))).cast("bigint").alias("minimum"),
    )


def text_presence_gate(cleaned: DataFrame, generated: DataFrame, targets: DataFrame) -> DataFrame:
    """Per image: does the generated picture really show text where it should?

    Changed pixels near the text or outline colour count once per target holding them.
    """
    before = cleaned.select("image_id", "y", "x", F.struct("r", "g", "b").alias("__old"))
    changed = generated.select("image_id", "y", "x", F.struct("r", "g", "b").alias("__new")).join(
        before, ["image_id", "y", "x"]).where(color_distance(F.col("__new"), F.col("__old")) >= 24)
    held = _in_boxes(targets, changed, g.EDGES)
    like_text = color_distance(F.col("__new"), F.col("text_rgb")) <= 155
    like_stroke = F.col("use_stroke") & (color_distance(F.col("text_rgb"), F.col("stroke_rgb")) >= 50) & (
        color_distance(F.col("__new"), F.col("stroke_rgb")) <= 105)
    counted = held.groupBy("image_id").agg(F.count_if(like_text | like_stroke).alias("selected"))
    needed = targets.groupBy("image_id").agg(F.greatest(F.lit(12), F.sum("minimum")).alias("minimum"))
    return needed.join(counted, "image_id", "left").select(
        "image_id", F.coalesce("selected", F.lit(0)).cast("bigint").alias("selected"), "minimum",
        (F.coalesce("selected", F.lit(0)) >= F.col("minimum")).alias("present"))
