"""Registered queries of the page screening job, over rasters made from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.functions.color import rgb
from panelflow.operators import raster as r
from panelflow.plans.derived import table

WIDTH, VECTORS = 128, 192


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors per line, 96 lines per image; ``v`` is a contrasty grey, r=g=b a light one."""
    vectors = table(spark, sf_dir, "embeddings")
    cells = vectors.select("vec_id", F.posexplode("embedding").alias("i", "e"))
    value = F.col("e").cast("double")

    def grey(middle: float, scale: float):
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(middle + value * scale))).cast("int")

    return cells.select(
        F.floor(F.col("vec_id") / VECTORS).cast("bigint").alias("image_id"),
        F.floor(F.col("vec_id") % VECTORS / 2).cast("bigint").alias("y"),
        (F.col("i") + F.col("vec_id") % 2 * 64).cast("bigint").alias("x"),
        grey(128.0, 1000.0).alias("v"), *[grey(190.0, 600.0).alias(c) for c in "rgb"])


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# ord, kind, box, layout, font, complex, orientation
_REGIONS = (
    (1, "dialogue", (8, 8, 60, 40), (8, 8, 60, 40), 6.0, True, "horizontal"),
    (2, "sfx", (50, 20, 120, 84), (40, 10, 126, 90), 10.0, True, "vertical"),
    (3, "label", (70, 4, 90, 16), (64, 4, 100, 16), 4.0, False, "horizontal"),
)


def _windows(sizes: DataFrame) -> DataFrame:
    def region(o, kind, box, layout, font, complex_, orientation):
        return F.struct(
            F.lit(o).cast("bigint").alias("ord"), F.lit(kind).alias("region_kind"),
            *[F.lit(v).alias(e) for e, v in zip(g.EDGES, box)], *[F.lit(v).alias(f"layout_{e}") for e, v in zip(g.EDGES, layout)],
            F.lit(font).alias("font_px"), F.lit(0.5).alias("stroke_px"), F.lit(complex_).alias("background_complex"),
            F.lit(orientation).alias("orientation"), rgb(17, 17, 17).alias("text_rgb"), rgb(200, 40, 40).alias("stroke_rgb"),
            rgb(210, 210, 190).alias("background_rgb"))

    regions = sizes.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"),
                           F.explode(F.array(*[region(*x) for x in _REGIONS])).alias("r")).select("image_id", "image_width", "image_height", "r.*")
    return r.region_windows(regions.where(F.col("top") < F.col("image_height") - 2))


def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    return r.tile_stats(pixels, _sizes(pixels)).select(
        "image_id", F.col("row").cast("bigint").alias("tile_row"), F.col("column").cast("bigint").alias("tile_column"), "left", "top", "right", "bottom",
        *[F.round(c, 9).alias(c) for c in ("dark_ratio", "bright_ratio", "transition_ratio")])


def score_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    tiles = r.map_tiles(r.score_tiles(r.tile_stats(pixels, _sizes(pixels)), 2), F.lit(1000), F.lit(1400))
    return tiles.select(
        "image_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"), "left", "top", "right", "bottom",
        F.array_join(F.col("unit_box").cast("array<string>"), ",").alias("unit_box"))


def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = r.threshold_flags(F.col("v"))
    rows = _pixels(spark, sf_dir).withColumn("flags", flags).select("image_id", "y", "x", F.explode(F.map_from_arrays(
        F.array(F.lit("dark"), F.lit("light")), F.array("flags.dark", "flags.light"))).alias("mask", "is_set"))
    return rows.where("is_set").groupBy("image_id", "mask").agg(*r.mask_bounds())


def ink_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    windows = _windows(_sizes(pixels))
    marked = r.ink_pixels(windows, pixels)
    lines = r.long_runs(marked.where("candidate"), windows)
    left = marked.where("ink").join(lines, ["image_id", "ord", "y", "x"], "left_anti")
    counted = marked.groupBy("image_id", "ord").agg(F.count_if("ink").alias("n_ink"), F.count_if("candidate").alias("n_candidate"))
    return counted.join(lines.groupBy("image_id", "ord").agg(F.count(F.lit(1)).alias("n_line")), ["image_id", "ord"], "left").join(
        left.groupBy("image_id", "ord").agg(F.count(F.lit(1)).alias("n_left")), ["image_id", "ord"], "left")


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels = _pixels(spark, sf_dir)
    windows = _windows(_sizes(pixels))
    marked = r.ink_pixels(windows, pixels)
    lines = r.long_runs(marked.where("candidate"), windows)
    ink = marked.where("ink").join(lines, ["image_id", "ord", "y", "x"], "left_anti")
    return r.glyph_components(ink, windows), windows


def glyph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _components(spark, sf_dir)
    return found.drop("component").withColumn("density", F.round("density", 9))


def ink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.ink_summary(*_components(spark, sf_dir))
    return rows.select("image_id", "ord", "n_pixels", "safe", *g.EDGES,
                        *[F.col(f"bounds.{e}").cast("bigint").alias(f"bounds_{e}") for e in g.EDGES])


def recentred_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every styled region moved to the centre of formula-made ink bounds."""
    from panelflow.plans.region_queries import pixel_regions

    o = F.col("ord")
    own = g.box(*[F.col(e) for e in g.EDGES])
    bounds = g.box(F.col("left") - o * 9, F.col("top") + o * 7, F.col("right") + o * 20 % 90, F.col("bottom") + o * 31 % 120)
    return pixel_regions(spark, sf_dir).select("image_id", "ord", g.recenter(own, bounds, F.lit(1000), F.lit(1400)).alias("b")).select(
        "image_id", "ord", *[F.col(f"b.{e}").cast("double").alias(e) for e in g.EDGES])


def text_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _pixels(spark, sf_dir)
    v = F.when((F.col("x") * 7 + F.col("y") * 3) % 5 == 0, 20).otherwise(F.col("r"))
    generated = cleaned.select("image_id", "y", "x", *[v.alias(c) for c in "rgb"])
    unit = F.array(*[F.lit(x) for x in (60.0, 80.0, 470.0, 420.0)])
    regions = _sizes(cleaned).select("image_id", "height", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select(
        "image_id", "height", F.col("i").cast("bigint").alias("ord"), F.transform(unit, lambda x: x + F.col("i") * 100).alias("box"),
        F.when(F.col("i") == 2, F.transform(unit, lambda x: x + 50)).alias("layout_box"),
        F.when(F.col("image_id") % 2 == 0, F.repeat(F.lit("가 "), 40)).otherwise("긴 글").alias("translated"), (F.col("i") * 30.0).alias("font_size"),
        F.lit("#141414").alias("text_color"), F.when(F.col("i") == 3, "#f0f0f0").alias("stroke_color"), (F.col("i") - 1.0).alias("stroke_width"))
    targets = r.text_targets(regions, F.lit(WIDTH), F.col("height"))
    return r.text_presence_gate(cleaned, generated, targets)


# ------------------------------------------------------------------ SQL twins

_PX = f"""
WITH RECURSIVE px AS (
  SELECT vec_id // {VECTORS} AS image_id, vec_id % {VECTORS} // 2 AS y, i + vec_id % 2 * 64 AS x,
    CAST(least(255, greatest(0, floor(128 + e * 1000))) AS INT) AS v, CAST(least(255, greatest(0, floor(190 + e * 600))) AS INT) AS r
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) q
),
size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image_id)"""

_TILES = _PX + """,
grid AS (SELECT *, CASE WHEN w >= h THEN 3 ELSE 2 END AS cols,
  greatest(2, CAST(ceil(h / (w::DOUBLE / (CASE WHEN w >= h THEN 3 ELSE 2 END))) AS INT)) AS nrows FROM size),
tiles AS (
  SELECT image_id, w, h, tr, tc, tc * w // cols AS l, tr * h // nrows AS t, (tc + 1) * w // cols AS r, (tr + 1) * h // nrows AS b
  FROM (SELECT *, unnest(range(cols)) AS tc FROM (SELECT *, unnest(range(nrows)) AS tr FROM grid) a) q
),
near AS (
  SELECT p.*, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS lv, lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS uv FROM px p
),
stats AS (
  SELECT t.image_id, tr, tc, l, t, t.r, b, t.w, t.h, count(*) FILTER (v < 50) / count(*) AS dark, count(*) FILTER (v > 205) / count(*) AS bright,
    (count(*) FILTER (x > l AND (v > 205) <> (lv > 205)) + count(*) FILTER (y > t AND (v > 205) <> (uv > 205)))
      / (count(*) FILTER (x > l) + count(*) FILTER (y > t)) AS trans
  FROM tiles t JOIN near n ON n.image_id = t.image_id AND x >= l AND x < t.r AND y >= t AND y < b GROUP BY ALL
)"""

_KIND = "(1, 'dialogue', 8, 8, 60, 40, 6.0::DOUBLE, TRUE), (2, 'sfx', 50, 20, 120, 84, 10.0::DOUBLE, TRUE), (3, 'label', 64, 4, 100, 16, 4.0::DOUBLE, FALSE)"
# region 3 lies on plain ground and is read horizontally: its box is stretched to the layout sideways
_INK = _PX + f""",
reg(ord, kind, fl, ft, fr, fb, font, cx) AS (VALUES {_KIND}),
win AS (
  SELECT s.image_id, ord, kind, fl, ft, fr, fb, font, cx, w, h, greatest(0, fl - m) AS wl, greatest(0, ft - m) AS wt, least(w, fr + m) AS wr, least(h, fb + m) AS wb
  FROM size s, (SELECT *, greatest(3, floor(font * 0.42::DOUBLE + 0.5 + 0.5)::INT) AS m FROM reg) q WHERE ft < h - 2
),
marked AS (
  SELECT q.*, td < (CASE WHEN cx THEN least(92, greatest(60, 54 + font * 0.75)) ELSE 300 END) OR sd < (CASE WHEN cx THEN least(92, greatest(60, 54 + font * 0.75)) ELSE 300 END)
      OR least(td, sd) < gd * 0.72::DOUBLE AS ink, gd > 10 AS off_ground
  FROM (
    SELECT w.*, p.y, p.x, sqrt(3 * pow(r - 17, 2)) AS td, sqrt(pow(r - 200, 2) + 2 * pow(r - 40, 2)) AS sd, sqrt(2 * pow(r - 210, 2) + pow(r - 190, 2)) AS gd
    FROM win w JOIN px p ON p.image_id = w.image_id AND x >= wl AND x < wr AND y >= wt AND y < wb) q
),
cand AS (SELECT * FROM marked WHERE CASE WHEN cx THEN ink ELSE off_ground END),
runs AS (
  SELECT *, count(*) OVER (PARTITION BY image_id, ord, y, ix) AS nx, count(*) OVER (PARTITION BY image_id, ord, x, iy) AS ny
  FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, ord, y ORDER BY x) AS ix, y - row_number() OVER (PARTITION BY image_id, ord, x ORDER BY y) AS iy FROM cand) q
),
line AS (
  SELECT image_id, ord, y, x FROM runs
  WHERE nx >= greatest(12, floor(font * (CASE kind WHEN 'sfx' THEN 5.5 ELSE 4 END) + 0.5), floor((wr - wl) * (CASE kind WHEN 'sfx' THEN 0.9 ELSE 0.72 END) + 0.5))
     OR ny >= greatest(12, floor(font * (CASE kind WHEN 'sfx' THEN 5.5 ELSE 4 END) + 0.5), floor((wb - wt) * (CASE kind WHEN 'sfx' THEN 0.9 ELSE 0.72 END) + 0.5))
),
mask AS (SELECT m.* FROM marked m WHERE ink AND (image_id, ord, y, x) NOT IN (SELECT image_id, ord, y, x FROM line))"""

_COMPONENTS = _INK + """,
seed AS (
  SELECT image_id, ord, y, x FROM mask m WHERE NOT EXISTS (
    SELECT 1 FROM mask n WHERE n.image_id = m.image_id AND n.ord = m.ord AND ((n.y = m.y AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x BETWEEN m.x - 1 AND m.x + 1)))
),
spread AS (
  SELECT image_id, ord, y, x, y * 1000 + x AS label FROM seed
  UNION
  SELECT s.image_id, s.ord, m.y, m.x, s.label FROM spread s JOIN mask m ON m.image_id = s.image_id AND m.ord = s.ord
    AND m.y BETWEEN s.y - 1 AND s.y + 1 AND m.x BETWEEN s.x - 1 AND s.x + 1
),
labelled AS (SELECT image_id, ord, y, x, min(label) AS label FROM spread GROUP BY ALL),
comp AS (
  SELECT image_id, ord, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS area, max(x) - min(x) + 1 AS cw, max(y) - min(y) + 1 AS ch
  FROM labelled GROUP BY ALL
),
ruled AS (
  SELECT c.*, w.kind, w.font, w.cx, wl, wt, wr, wb, w.w, w.h, NOT (
      (cw > font * 2.2::DOUBLE AND ch < font * 0.42::DOUBLE) OR (ch > font * 2.2::DOUBLE AND cw < font * 0.42::DOUBLE)
      OR (kind = 'dialogue' AND greatest(cw, ch) > font * 1.5 AND least(cw, ch) < font * 1.2::DOUBLE AND area::DOUBLE / (cw * ch) < 0.48::DOUBLE)
      OR area > (wr - wl) * (wb - wt) * (CASE kind WHEN 'sfx' THEN 0.72::DOUBLE ELSE 0.42::DOUBLE END)
      OR x1 < fl - greatest(3, font * 0.55::DOUBLE) OR x0 > fr + greatest(3, font * 0.55::DOUBLE)
      OR y1 < ft - greatest(3, font * 0.55::DOUBLE) OR y0 > fb + greatest(3, font * 0.55::DOUBLE)
      OR (kind <> 'sfx' AND (
        (cw > (wr - wl) * 0.68::DOUBLE AND ch > (wb - wt) * 0.68::DOUBLE) OR (x0 = wl AND x1 = wr - 1) OR (y0 = wt AND y1 = wb - 1)
        OR (x0 - wl <= greatest(2, font * 0.35::DOUBLE) AND x1 - wl >= wr - wl - 1 - greatest(2, font * 0.35::DOUBLE) AND cw > font * 1.7::DOUBLE)
        OR (y0 - wt <= greatest(2, font * 0.35::DOUBLE) AND y1 - wt >= wb - wt - 1 - greatest(2, font * 0.35::DOUBLE) AND ch > font * 1.7::DOUBLE)
        OR (cw > font * 2.8::DOUBLE AND ch > font * 2.8::DOUBLE AND area > font * font * 1.5)))) AS is_glyph
  FROM comp c JOIN win w USING (image_id, ord)
)"""

QUERIES = {
    "tile_stats": tile_stats,
    "score_tiles": score_tiles,
    "mask_summary": mask_summary,
    "ink_and_lines": ink_and_lines,
    "glyph_components": glyph_components,
    "ink_summary": ink_summary,
    "recentred_regions": recentred_regions,
    "text_presence": text_presence,
}


def _recentred_sql() -> str:
    from panelflow.plans.derived import with_views
    from panelflow.plans.region_queries import _NORMAL

    return with_views(_NORMAL + """,
b AS (
  SELECT image_id, ord, "left" AS l, top AS t, "right" AS r, bottom AS b, "left" - ord * 9 AS bl, top + ord * 7 AS bt, "right" + ord * 20 % 90 AS br, bottom + ord * 31 % 120 AS bb FROM normal
),
s AS (SELECT *, least(1000, greatest(r - l, br - bl)) AS w, least(1400, greatest(b - t, bb - bt)) AS h FROM b),
p AS (SELECT *, least(greatest(0, 1000 - w), greatest(0, (bl + br) / 2 - w / 2)) AS nl, least(greatest(0, 1400 - h), greatest(0, (bt + bb) / 2 - h / 2)) AS nt FROM s)
SELECT image_id, ord, nl::DOUBLE AS "left", nt::DOUBLE AS top, (nl + w)::DOUBLE AS "right", (nt + h)::DOUBLE AS bottom FROM p""", "v_styled")


ORACLES = {
    "tile_stats": _TILES + """
SELECT image_id, tr AS tile_row, tc AS tile_column, l AS "left", t AS top, r AS "right", b AS bottom, round(dark, 9) AS dark_ratio, round(bright, 9) AS bright_ratio,
  round(trans, 9) AS transition_ratio FROM stats""",
    "score_tiles": _TILES + """,
scored AS (
  SELECT *, least(dark, 0.72::DOUBLE) * least(bright, 0.38::DOUBLE) * (1 + least(2.5, trans * 18)) AS score FROM stats WHERE dark >= 0.24::DOUBLE AND bright >= 0.012::DOUBLE AND trans >= 0.003::DOUBLE
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tr, tc) AS rank,
    greatest(0, l - floor((r - l) * 0.08::DOUBLE + 0.5)::BIGINT) AS pl, greatest(0, t - floor((b - t) * 0.08::DOUBLE + 0.5)::BIGINT) AS pt,
    least(w, r + floor((r - l) * 0.08::DOUBLE + 0.5)::BIGINT) AS pr, least(h, b + floor((b - t) * 0.08::DOUBLE + 0.5)::BIGINT) AS pb FROM scored) q WHERE rank <= 2
),
o AS (
  SELECT *, floor(pl / w * 1000) AS ol, floor(pt / h * 1400) AS ot, greatest(1, ceil(pr / w * 1000) - floor(pl / w * 1000)) AS ow, greatest(1, ceil(pb / h * 1400) - floor(pt / h * 1400)) AS oh FROM best
)
SELECT image_id, rank, round(score, 9) AS score, pl AS "left", pt AS top, pr AS "right", pb AS bottom,
  floor(ol / 1000 * 1000 + 0.5)::BIGINT || ',' || floor(ot / 1400 * 1000 + 0.5)::BIGINT || ',' || floor((ol + ow) / 1000 * 1000 + 0.5)::BIGINT || ',' || floor((ot + oh) / 1400 * 1000 + 0.5)::BIGINT AS unit_box
FROM o""",
    "mask_summary": _PX + """
SELECT image_id, mask, min(x) AS "left", min(y) AS top, max(x) + 1 AS "right", max(y) + 1 AS bottom, count(*) AS n_pixels
FROM (SELECT *, 'dark' AS mask FROM px WHERE v < 145 UNION ALL SELECT *, 'light' FROM px WHERE v > 205) q GROUP BY image_id, mask""",
    "ink_and_lines": _INK + """
SELECT m.image_id, m.ord::BIGINT AS ord, count(*) FILTER (ink) AS n_ink, count(*) FILTER (CASE WHEN cx THEN ink ELSE off_ground END) AS n_candidate,
  nullif((SELECT count(*) FROM line l WHERE l.image_id = m.image_id AND l.ord = m.ord), 0) AS n_line,
  nullif((SELECT count(*) FROM mask k WHERE k.image_id = m.image_id AND k.ord = m.ord), 0) AS n_left
FROM marked m GROUP BY m.image_id, m.ord""",
    "glyph_components": _COMPONENTS + """
SELECT image_id, ord::BIGINT AS ord, x0 AS min_x, y0 AS min_y, x1 + 1 AS "right", y1 + 1 AS bottom, area, round(area::DOUBLE / (cw * ch), 9) AS density, is_glyph FROM ruled""",
    "ink_summary": _COMPONENTS + """,
kept AS (SELECT image_id, ord, sum(area) AS n, min(x0) AS l, min(y0) AS t, max(x1) + 1 AS r, max(y1) + 1 AS b FROM ruled WHERE is_glyph GROUP BY ALL),
padded AS (SELECT w.*, coalesce(n, 0) AS n, l, t, r, b, greatest(2, floor(font * 0.09::DOUBLE + 0.5 + 0.5)::INT) AS pad FROM win w LEFT JOIN kept k USING (image_id, ord))
SELECT image_id, ord::BIGINT AS ord, n::BIGINT AS n_pixels,
  n > 0 AND n <= greatest(1, floor((wr - wl) * (wb - wt) * (CASE WHEN kind = 'sfx' THEN 0.64::DOUBLE WHEN cx THEN 0.22::DOUBLE ELSE 0.38::DOUBLE END) + 0.5)) AS safe,
  l AS "left", t AS top, r AS "right", b AS bottom, CASE WHEN l IS NOT NULL THEN least(w, greatest(0, l - pad)) END AS bounds_left,
  CASE WHEN l IS NOT NULL THEN least(h, greatest(0, t - pad)) END AS bounds_top,
  CASE WHEN l IS NOT NULL THEN least(w, greatest(0, r + pad)) END AS bounds_right, CASE WHEN l IS NOT NULL THEN least(h, greatest(0, b + pad)) END AS bounds_bottom
FROM padded""",
    "recentred_regions": _recentred_sql(),
    "text_presence": _PX + f""",
tgt AS (
  SELECT image_id, i, w, h, 20 AS tc, CASE WHEN i = 3 THEN 240 ELSE 255 END AS sc, i > 1 AS use_stroke, i * 30.0::DOUBLE / 1000 * h AS font,
    CASE WHEN image_id % 2 = 0 THEN 40 ELSE 2 END AS chars, CASE WHEN i = 2 THEN 50 ELSE i * 100 END AS d
  FROM (SELECT *, unnest([1, 2, 3]) AS i FROM size) q
),
bx AS (
  SELECT *, greatest(2, floor(font * 0.12::DOUBLE + 0.5)) AS pad, floor((60 + d)::DOUBLE / 1000 * {WIDTH}) AS l, floor((80 + d)::DOUBLE / 1000 * h) AS t,
    ceil((470 + d)::DOUBLE / 1000 * {WIDTH}) AS rr, ceil((420 + d)::DOUBLE / 1000 * h) AS b, greatest(8, floor(chars * greatest(8, font * 0.35::DOUBLE) + 0.5)) AS need FROM tgt
),
ch AS (SELECT image_id, y, x, 20 AS g FROM px WHERE (x * 7 + y * 3) % 5 = 0 AND sqrt(3 * pow(r - 20, 2)) >= 24),
cnt AS (
  SELECT b.image_id, count(*) AS n FROM bx b JOIN ch c ON c.image_id = b.image_id AND x >= greatest(0, l - pad) AND x < least({WIDTH}, rr + pad)
    AND y >= greatest(0, t - pad) AND y < least(h, b.b + pad)
  WHERE sqrt(3 * pow(g - tc, 2)) <= 155 OR (use_stroke AND sqrt(3 * pow(tc - sc, 2)) >= 50 AND sqrt(3 * pow(g - sc, 2)) <= 105) GROUP BY b.image_id
),
need AS (SELECT image_id, greatest(12, sum(need))::BIGINT AS minimum FROM bx GROUP BY image_id)
SELECT image_id, coalesce(n, 0) AS selected, minimum, coalesce(n, 0) >= minimum AS present FROM need LEFT JOIN cnt USING (image_id)""",
}
