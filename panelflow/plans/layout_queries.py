"""Registered queries of the crop, batch and caption jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import geometry as g, text as t
from panelflow.operators import captions as cap, crops as c
from panelflow.plans.derived import BLANKS, view, with_views
from panelflow.plans.region_queries import IMAGE_HEIGHT, IMAGE_WIDTH, styled_regions
from panelflow.session import materialize


PACK_CHUNK = 64
WRAP_LIMIT = 18


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string("%.1f", v)), ",")


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the jobs read them several times, and the view numbers them in two sorted windows."""
    return materialize(view(spark, sf_dir, "v_crops").select(
        "page", "crop_index", *[F.col(f"{e}_edge").alias(e) for e in g.EDGES]), "crops")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.plan_crops(styled_regions(spark, sf_dir), F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT))


def plan_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select(
        "image_id", "crop_index", *g.EDGES, F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def crop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = styled_regions(spark, sf_dir)
    inside = c.crop_regions(_planned(spark, sf_dir), regions, F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT))
    return inside.select("image_id", "crop_index", "position", "ord", _joined(F.col("box")).alias("box"),
                         _joined(F.col("layout_box")).alias("layout_box"), "font_size", "stroke_width")


def crop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.crop_candidates(styled_regions(spark, sf_dir), F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT)).drop(
        "image_width", "image_height")


def _region_of_crop(crops: DataFrame) -> DataFrame:
    """One region per crop, in the crop's frame."""
    i = F.col("crop_index")
    box = F.array(*[x.cast("double") for x in (i * 13 % 300, i * 7 % 200, 400 + i * 11 % 500, 500 + i * 17 % 450)])
    return crops.select("page", "crop_index", F.lit(0).alias("position"), i.alias("ord"), box.alias("box"),
                        box.alias("layout_box"), (i % 90).cast("double").alias("font_size"),
                        (i % 5).cast("double").alias("stroke_width"))


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pack_batches(_crops(spark, sf_dir), key="page", chunk=PACK_CHUNK)


def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).select("page", "crop_index", "batch", F.col("position").cast("bigint").alias("position"))


def batch_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = c.layout_batches(_batched(spark, sf_dir), key="page")
    return tiles.select("page", "crop_index", "batch", F.round("scale", 9).alias("scale"),
                        *[F.col(x).cast("bigint").alias(x) for x in (
                            "tile_left", "tile_top", "tile_width", "tile_height", "sheet_width", "sheet_height")])


def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = _crops(spark, sf_dir)
    tiles = c.layout_batches(c.pack_batches(crops, key="page", chunk=PACK_CHUNK), key="page")
    return c.sheet_regions(tiles, _region_of_crop(crops), key="page").select(
        "page", "batch", "crop_index", _joined(F.col("box")).alias("box"), "font_size", "stroke_width")


def crop_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = c.crop_candidates(styled_regions(spark, sf_dir), F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT))
    return c.crop_overlaps(boxes)


def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_captions", heavy=True)
    return rows.select("conv_id", "turn", F.posexplode(t.wrap_text(F.col("translated"), F.lit(WRAP_LIMIT))).alias("n", "line")) \
        .select("conv_id", "turn", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


def fit_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cap.fit_captions(view(spark, sf_dir, "v_captions", heavy=True))
    return rows.select("conv_id", "turn", "render", F.round("size", 6).alias("size"),
                       F.size("lines").cast("bigint").alias("n_lines"), "overflow")


def caption_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = cap.overflow_rates(cap.fit_captions(view(spark, sf_dir, "v_captions", heavy=True)))
    return rates.select("region_kind", "n_captions", "n_overflow", F.round("overflow_rate", 6).alias("overflow_rate"),
                        F.round("mean_size", 6).alias("mean_size"))


# ------------------------------------------------------------------ SQL twins

_PACK = """
WITH RECURSIVE crop AS (
  SELECT page, crop_index, left_edge AS l, top_edge AS t, right_edge - left_edge AS w, bottom_edge - top_edge AS h FROM v_crops
),
pack AS (
  SELECT page, crop_index, 1::BIGINT AS batch, 0::BIGINT AS position, w AS mw, h AS mh FROM crop WHERE crop_index = 1
  UNION ALL
  SELECT page, crop_index, CASE WHEN ok THEN batch ELSE batch + 1 END, CASE WHEN ok THEN position + 1 ELSE 0 END,
    CASE WHEN ok THEN nw ELSE w END, CASE WHEN ok THEN nh ELSE h END
  FROM (
    SELECT c.page, c.crop_index, c.w, c.h, p.batch, p.position, greatest(p.mw, c.w) AS nw, greatest(p.mh, c.h) AS nh,
      p.position < 3 AND greatest(p.mw, c.w) * 2 + 96 <= 4096
        AND greatest(p.mh, c.h) * ((p.position + 3) // 2) + 32 * ((p.position + 3) // 2 + 1) <= 4096 AS ok
    FROM pack p JOIN crop c ON c.page = p.page AND c.crop_index = p.crop_index + 1
  ) s
)"""

_TILES = _PACK + """,
sheet AS (
  SELECT p.page, p.crop_index, p.batch, p.position, c.w, c.h, count(*) OVER s AS n, max(c.w) OVER s AS mw, max(c.h) OVER s AS mh
  FROM pack p JOIN crop c USING (page, crop_index) WINDOW s AS (PARTITION BY p.page, p.batch)
),
scaled AS (
  SELECT *, CASE WHEN n = 1 THEN 1 ELSE 2 END AS cols, CASE WHEN n < 3 THEN 1 ELSE 2 END AS lines,
    least(1.0::DOUBLE, 4096::DOUBLE / (mw * (CASE WHEN n = 1 THEN 1 ELSE 2 END) + 32 * (CASE WHEN n = 1 THEN 2 ELSE 3 END)),
      4096::DOUBLE / (mh * (CASE WHEN n < 3 THEN 1 ELSE 2 END) + 32 * (CASE WHEN n < 3 THEN 2 ELSE 3 END))) AS scale
  FROM sheet
),
celled AS (
  SELECT *, CAST(floor(mw * scale + 0.5) AS BIGINT) AS cw, CAST(floor(mh * scale + 0.5) AS BIGINT) AS ch,
    greatest(12, CAST(floor(32 * scale + 0.5) AS BIGINT)) AS gap, CAST(floor(w * scale + 0.5) AS BIGINT) AS tile_width,
    CAST(floor(h * scale + 0.5) AS BIGINT) AS tile_height
  FROM scaled
),
tiles AS (
  SELECT page, crop_index, batch, round(scale, 9) AS scale,
    gap + (position % cols) * (cw + gap) + (cw - tile_width) // 2 AS tile_left,
    gap + (position // cols) * (ch + gap) + (ch - tile_height) // 2 AS tile_top,
    tile_width, tile_height, cw * cols + gap * (cols + 1) AS sheet_width, ch * lines + gap * (lines + 1) AS sheet_height
  FROM celled
)"""


def _on_sheet(value: str, start: str, extent: str, side: str) -> str:
    return (f"printf('%.1f', floor(least(1000, greatest(0, (({start}) + ({value})::DOUBLE / 1000 * {extent}) / {side} * 1000))"
            f" * 10 + 0.5) / 10)")


def _px(lo: str, hi: str, side: int, up: bool) -> str:
    a = f"least(1000.0::DOUBLE, greatest(0.0::DOUBLE, ({lo})::DOUBLE))"
    b = f"least(1000.0::DOUBLE, greatest(0.0::DOUBLE, ({hi})::DOUBLE))"
    return f"ceil(greatest({a}, {b}) / 1000 * {side})" if up else f"floor(least({a}, {b}) / 1000 * {side})"


_CANDIDATES = f"""
WITH content AS (
  SELECT image_id, ord,
    least({_px('x0', 'x1', 1000, False)}, CASE WHEN ok THEN {_px('lx0', 'lx1', 1000, False)} ELSE 1e9 END) AS l,
    least({_px('y0', 'y1', 1400, False)}, CASE WHEN ok THEN {_px('ly0', 'ly1', 1400, False)} ELSE 1e9 END) AS t,
    greatest({_px('x0', 'x1', 1000, True)}, CASE WHEN ok THEN {_px('lx0', 'lx1', 1000, True)} ELSE 0 END) AS r,
    greatest({_px('y0', 'y1', 1400, True)}, CASE WHEN ok THEN {_px('ly0', 'ly1', 1400, True)} ELSE 0 END) AS b
  FROM (SELECT *, has_layout AND {_px('lx0', 'lx1', 1000, True)} - {_px('lx0', 'lx1', 1000, False)} >= 2
    AND {_px('ly0', 'ly1', 1400, True)} - {_px('ly0', 'ly1', 1400, False)} >= 2 AS ok FROM v_styled WHERE trim(translated, {BLANKS}) <> '') q
),
padded AS (
  SELECT *, floor(least(140::DOUBLE, greatest(24, (r - l) * 0.65::DOUBLE, (b - t) * 0.18::DOUBLE)) + 0.5) AS px,
    floor(least(168::DOUBLE, greatest(24, (b - t) * 0.28::DOUBLE, (r - l) * 0.18::DOUBLE)) + 0.5) AS py FROM content
),
candidates AS (
  SELECT image_id, ord, CAST(greatest(0, l - px) AS BIGINT) AS "left", CAST(greatest(0, t - py) AS BIGINT) AS top,
    CAST(least(1000, r + px) AS BIGINT) AS "right", CAST(least(1400, b + py) AS BIGINT) AS bottom FROM padded
)"""

# Grouping as single steps: look at one group, from the newest backwards, or push and
# take the next candidate.
_GROUPS = _CANDIDATES.replace("WITH content", "WITH RECURSIVE content", 1) + """,
cand AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM candidates),
step AS (
  SELECT image_id, k, 0::BIGINT AS i, ord AS newest, {'l': "left", 't': top, 'r': "right", 'b': bottom} AS m, [ord] AS mem,
    []::STRUCT(newest BIGINT, m STRUCT(l BIGINT, t BIGINT, r BIGINT, b BIGINT), mem BIGINT[])[] AS groups
  FROM cand WHERE k = 1
  UNION ALL
  SELECT image_id, CASE WHEN i > 0 THEN k ELSE k + 1 END, CASE WHEN i > 0 THEN i - 1 ELSE len(groups) + 1 END,
    CASE WHEN i > 0 THEN newest ELSE n_ord END,
    CASE WHEN i = 0 THEN n_m WHEN joins THEN u ELSE m END,
    CASE WHEN i = 0 THEN [n_ord] WHEN joins THEN list_concat(groups[i].mem, mem) ELSE mem END,
    CASE WHEN i = 0 THEN list_append(groups, {'newest': newest, 'm': m, 'mem': mem}) WHEN joins THEN list_concat(groups[1:i - 1], groups[i + 1:]) ELSE groups END
  FROM (
    SELECT *, meets AND len(mem) + len(groups[i].mem) <= 3 AND u.r - u.l <= 1000 * 0.48::DOUBLE AND u.b - u.t <= 1400 * 0.38::DOUBLE
      AND (u.r - u.l) * (u.b - u.t) <= 1000 * 1400 * 0.16::DOUBLE AS joins
    FROM (
      SELECT s.*, c.ord AS n_ord, CASE WHEN c.ord IS NOT NULL THEN {'l': c."left", 't': c.top, 'r': c."right", 'b': c.bottom} END AS n_m,
        coalesce(m.l < groups[i].m.r AND m.r > groups[i].m.l AND m.t < groups[i].m.b AND m.b > groups[i].m.t, FALSE) AS meets,
        {'l': least(m.l, groups[i].m.l), 't': least(m.t, groups[i].m.t), 'r': greatest(m.r, groups[i].m.r), 'b': greatest(m.b, groups[i].m.b)} AS u
      FROM step s LEFT JOIN cand c ON s.i = 0 AND c.image_id = s.image_id AND c.k = s.k + 1
      WHERE s.m IS NOT NULL
    ) a
  ) b
),
grouped AS (SELECT image_id, unnest(groups) AS g FROM step WHERE m IS NULL),
crops AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY g.m.t, g.m.l, g.newest) AS crop_index, g.m.l AS l, g.m.t AS t, g.m.r AS r, g.m.b AS b, g.mem AS mem
  FROM grouped
)"""


def _in_crop(value: str, side: int, start: str, extent: str) -> str:
    return (f"printf('%.1f', floor(least(1000, greatest(0, (({value})::DOUBLE / 1000 * {side} - {start}) / {extent} * 1000)) * 10 + 0.5) / 10)")


def _box_in_crop(x0: str, y0: str, x1: str, y1: str) -> str:
    return " || ',' || ".join([_in_crop(x0, 1000, "l", "(r - l)"), _in_crop(y0, 1400, "t", "(b - t)"),
                               _in_crop(x1, 1000, "l", "(r - l)"), _in_crop(y1, 1400, "t", "(b - t)")])


_CLOSING = t.CLOSING


def _wrap_cte(source: str, limit: str) -> str:
    """Greedy wrapping as a recursion over the words of each paragraph.

    ``source`` gives (id, par, words LIST, lim); the recursion emits finished lines.
    """
    pattern = f"'(?s).{{' || lim || '}}[{_CLOSING}]?|.+'"
    return f"""
walk AS (
  SELECT id, par, words, lim, 0 AS k, ''::VARCHAR AS cur, []::VARCHAR[] AS done FROM {source}
  UNION ALL
  SELECT id, par, words, lim, k + 1,
    CASE WHEN length(cand) <= lim THEN cand ELSE chunks[len(chunks)] END,
    CASE WHEN length(cand) <= lim THEN []::VARCHAR[] WHEN cur = '' THEN chunks[1:len(chunks) - 1]
      ELSE list_prepend(cur, chunks[1:len(chunks) - 1]) END
  FROM (
    SELECT *, CASE WHEN cur = '' THEN words[k + 1] ELSE cur || ' ' || words[k + 1] END AS cand,
      regexp_extract_all(words[k + 1], {pattern}) AS chunks
    FROM walk WHERE k < len(words)
  ) s
)"""


_WRAP = f"""
WITH RECURSIVE pars AS (
  SELECT conv_id * 100 + turn AS id, unnest(string_split(translated, chr(10))) AS p,
    generate_subscripts(string_split(translated, chr(10)), 1) AS par FROM v_captions
),
src AS (SELECT id, par, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '') AS words, {WRAP_LIMIT} AS lim FROM pars),
{_wrap_cte('src', 'lim')},
flat AS (
  SELECT id, par, k, unnest(done) AS line, generate_subscripts(done, 1) AS i FROM walk
  UNION ALL SELECT id, par, 100000, cur, 1 FROM walk WHERE k = len(words)
)"""

# sizes of every caption, and per distinct line limit the number of lines
_FIT = f"""
WITH RECURSIVE placed AS (
  SELECT *, conv_id * 100 + turn AS id, CASE
      WHEN regexp_matches(translated, '[가-힣]') AND orientation = 'vertical' AND region_kind <> 'sfx' THEN
        CASE WHEN region_kind = 'dialogue' AND layout_width < 120 AND layout_height >= layout_width * 1.65::DOUBLE THEN 'vertical' ELSE 'horizontal' END
      ELSE orientation END AS render,
    length(regexp_replace(translated, '\\s+', '', 'g')) AS n_chars
  FROM v_captions
),
sizes AS (
  SELECT id, render, n_chars, layout_width AS lw, layout_height AS lh, top_size - i AS size FROM (
    SELECT *, CASE WHEN render = 'horizontal' AND orientation = 'vertical' THEN font_px * 0.9::DOUBLE ELSE font_px END AS top_size,
      unnest(range(60)) AS i FROM placed) s
  WHERE top_size - i >= 7
),
limits AS (
  SELECT *, CAST(greatest(1, floor(lw * 0.84::DOUBLE / (size * 1.02::DOUBLE))) AS INT) AS lim FROM sizes
),
shown AS (
  SELECT id, 7::DOUBLE AS size FROM placed
  UNION SELECT id, size FROM sizes
),
wanted AS (
  SELECT DISTINCT id, lim FROM limits WHERE render = 'horizontal'
  UNION
  SELECT DISTINCT p.id, CAST(greatest(1, floor(greatest(s.size, p.layout_width - p.layout_width * 0.08::DOUBLE * 2) / (s.size * 1.02::DOUBLE))) AS INT)
  FROM placed p JOIN shown s USING (id) WHERE p.render = 'horizontal'
),
pars AS (
  SELECT id, unnest(string_split(translated, chr(10))) AS p, generate_subscripts(string_split(translated, chr(10)), 1) AS par FROM placed
),
src AS (SELECT w.id, w.lim, par, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '') AS words FROM wanted w JOIN pars USING (id)),
walk AS (
  SELECT id, par, words, lim, 0 AS k, 0 AS cur, 0 AS done FROM src
  UNION ALL
  SELECT id, par, words, lim, k + 1,
    CASE WHEN cand <= lim THEN cand ELSE length(chunks[len(chunks)]) END,
    CASE WHEN cand <= lim THEN done ELSE done + len(chunks) - 1 + (CASE WHEN cur = 0 THEN 0 ELSE 1 END) END
  FROM (
    SELECT *, CASE WHEN cur = 0 THEN length(words[k + 1]) ELSE cur + 1 + length(words[k + 1]) END AS cand,
      regexp_extract_all(words[k + 1], '(?s).{{' || lim || '}}[{_CLOSING}]?|.+') AS chunks
    FROM walk WHERE k < len(words)
  ) s
),
counted AS (SELECT id, lim, sum(done + 1) AS n FROM walk WHERE k = len(words) GROUP BY id, lim),
best AS (
  SELECT l.id, max(size) AS size FROM limits l LEFT JOIN counted c ON c.id = l.id AND c.lim = l.lim
  WHERE CASE WHEN render = 'horizontal' THEN n * size * 1.12::DOUBLE <= lh * 0.84::DOUBLE
    ELSE ceil(n_chars / greatest(1, floor(lh * 0.84::DOUBLE / (size * 1.08::DOUBLE)))) * size * 1.08::DOUBLE <= lw * 0.84::DOUBLE END
  GROUP BY l.id
),
fit AS (
  SELECT p.*, coalesce(b.size, 7) AS size, b.size IS NULL AS overflow FROM placed p LEFT JOIN best b USING (id)
),
result AS (
  SELECT conv_id, turn, region_kind, render, size, overflow, CAST(c.n AS BIGINT) AS n_lines
  FROM fit f LEFT JOIN counted c ON f.render = 'horizontal' AND c.id = f.id
    AND c.lim = CAST(greatest(1, floor(greatest(size, layout_width - layout_width * 0.08::DOUBLE * 2) / (size * 1.02::DOUBLE))) AS INT)
)"""


def _recursive(text: str, *views: str) -> str:
    return with_views(text.replace("WITH RECURSIVE", "WITH", 1), *views).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "crop_candidates": crop_candidates,
    "plan_crops": plan_crops,
    "crop_regions": crop_regions,
    "pack_batches": pack_batches,
    "batch_tiles": batch_tiles,
    "sheet_regions": sheet_regions,
    "crop_overlaps": crop_overlaps,
    "wrap_text": wrap_text,
    "fit_captions": fit_captions,
    "caption_overflow": caption_overflow,
}

ORACLES = {
    "crop_candidates": with_views(_CANDIDATES + ' SELECT * FROM candidates', "v_styled"),
    "plan_crops": _recursive(_GROUPS + """
SELECT image_id, crop_index, l AS "left", t AS top, r AS "right", b AS bottom, array_to_string(mem, ',') AS members FROM crops""", "v_styled"),
    "crop_regions": _recursive(_GROUPS + f"""
SELECT c.image_id, crop_index, (position - 1)::INT AS position, c.ord, {_box_in_crop('x0', 'y0', 'x1', 'y1')} AS box,
  CASE WHEN has_layout THEN {_box_in_crop('lx0', 'ly0', 'lx1', 'ly1')} END AS layout_box,
  floor(least(1000, coalesce(font_size, 0) * (1400::DOUBLE / (b - t))) * 10 + 0.5) / 10 AS font_size,
  floor(least(1000, stroke_width * (1400::DOUBLE / (b - t))) * 10 + 0.5) / 10 AS stroke_width
FROM (SELECT *, unnest(mem) AS ord, generate_subscripts(mem, 1) AS position FROM crops) c JOIN v_styled s ON s.image_id = c.image_id AND s.ord = c.ord""", "v_styled"),
    "pack_batches": _recursive(_PACK + " SELECT page, crop_index, batch, position FROM pack", "v_crops"),
    "batch_tiles": _recursive(_TILES + " SELECT * FROM tiles", "v_crops"),
    "sheet_regions": _recursive(_TILES + f"""
SELECT page, batch, crop_index,
  {_on_sheet('i * 13 % 300', 'tile_left', 'tile_width', 'sheet_width')} || ',' || {_on_sheet('i * 7 % 200', 'tile_top', 'tile_height', 'sheet_height')} || ',' ||
  {_on_sheet('400 + i * 11 % 500', 'tile_left', 'tile_width', 'sheet_width')} || ',' || {_on_sheet('500 + i * 17 % 450', 'tile_top', 'tile_height', 'sheet_height')} AS box,
  floor((i % 90) * (tile_height::DOUBLE / sheet_height) * 10 + 0.5) / 10 AS font_size,
  floor((i % 5) * (tile_height::DOUBLE / sheet_height) * 10 + 0.5) / 10 AS stroke_width
FROM (SELECT *, crop_index AS i FROM tiles) q""", "v_crops"),
    "crop_overlaps": with_views(_CANDIDATES + """
, u AS (SELECT image_id, "left", top, "right", bottom, count(*) AS n FROM candidates GROUP BY ALL)
SELECT a.image_id, a."left", a.top, a."right", a.bottom, any_value(a.n) AS n_equal, CAST(sum(b.n) - 1 AS BIGINT) AS n_overlapping
FROM u a JOIN u b ON a.image_id = b.image_id AND a."left" < b."right" AND a."right" > b."left" AND a.top < b.bottom AND a.bottom > b.top
GROUP BY a.image_id, a."left", a.top, a."right", a.bottom""", "v_styled"),
    "wrap_text": _recursive(_WRAP + """
SELECT id // 100 AS conv_id, id % 100 AS turn, row_number() OVER (PARTITION BY id ORDER BY par, k, i) AS line_no, line FROM flat""", "v_captions"),
    "fit_captions": _recursive(_FIT + """
SELECT conv_id, turn, render, round(size, 6) AS size, n_lines, overflow FROM result""", "v_captions"),
    "caption_overflow": _recursive(_FIT + """
SELECT region_kind, count(*) AS n_captions, count(*) FILTER (overflow) AS n_overflow,
  round(avg(overflow::INT), 6) AS overflow_rate, round(avg(size), 6) AS mean_size FROM result GROUP BY region_kind""", "v_captions"),
}
