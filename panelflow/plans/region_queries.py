"""Registered queries of the region QA job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import color, geometry as g, values as v
from panelflow.functions.values import strip_space
from panelflow.operators import regions as r
from panelflow.plans.derived import BLANKS, table, view, with_views
from panelflow.sources.model_json import scan_regions, scan_reviews

IMAGE_WIDTH, IMAGE_HEIGHT = 1000, 1400


def _size() -> tuple[Column, Column]:
    return F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT)


def _array(*names: str) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def styled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived styled regions in the shape of the region contract."""
    rows = view(spark, sf_dir, "v_styled")
    return rows.select(
        "image_id", "ord", _array("x0", "y0", "x1", "y1").alias("box"),
        F.when(F.col("has_layout"), _array("lx0", "ly0", "lx1", "ly1")).alias("layout_box"),
        "confidence", F.lit(True).alias("has_confidence"), "translated", "region_kind", "font_size", "text_color",
        "background_color", "stroke_color", "stroke_width", "rotation", "background_complex", "orientation",
    )


def pixel_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.normalize_regions(styled_regions(spark, sf_dir), *_size())


def _plain_boxes(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """Translated regions with their pixel edges."""
    rows = view(spark, sf_dir, name, by=by).where(strip_space(F.col("translated")) != "")
    boxed = g.with_pixel_box(rows.withColumn("__values", _array("x0", "y0", "x1", "y1")), "__values", "__box", *_size())
    return boxed.where("__box is not null").select("image_id", "ord", "confidence", "__box.*")


def scan_model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = scan_regions(view(spark, sf_dir, "v_answers", heavy=True))
    return good.select(
        "image_id", "n", "ord", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"), "original",
        "confidence", "region_kind", "font_size", "rotation", "bold", "background_complex", "has_confidence",
    )


def quarantined_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = scan_regions(view(spark, sf_dir, "v_answers", heavy=True))
    return bad.select("image_id", "n", "ord", F.array_join("violations", ",").alias("violations"))


_REVIEW_TEXT = """
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN '{"passed":"yes","summary":"s","issues":[],"regions":[]}'
  WHEN 1 THEN '{"passed":true,"summary":"q' || cast(quality AS varchar(20)) || '","issues":[],"regions":[]}'
  WHEN 2 THEN '{"passed":false,"issues":["a",2],"regions":[]}'
  WHEN 3 THEN 'nothing'
  WHEN 4 THEN '{"passed":false,"summary":"","issues":["a","b"],"regions":[{}],"more":0}'
  ELSE '{"passed":false,"summary":"t' || cast(toxic AS varchar(20)) || '","issues":["a","b"],"regions":[]}' END AS output
FROM labels"""


def scan_model_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = spark.sql(
        _REVIEW_TEXT.replace("{", "{{").replace("}", "}}").replace("FROM labels", "FROM {labels}"),
        labels=table(spark, sf_dir, "labels"))
    reviews, _, bad = scan_reviews(answers)
    return reviews.select(
        "doc_id", "passed", "summary", F.array_join("issues", "|").alias("issues"), F.lit("").alias("violations")
    ).unionByName(bad.select(
        "doc_id", F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("issues"), F.array_join("violations", ",").alias("violations")))


def box_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, font and colour rules over every styled region."""
    layout = F.col("layout")
    rows = view(spark, sf_dir, "v_styled").withColumn(
        "layout", F.when(F.col("has_layout"), _array("lx0", "ly0", "lx1", "ly1"))
    ).withColumn("own", _array("x0", "y0", "x1", "y1")).withColumn("unit", g.normalize_box(layout))
    rows = g.with_pixel_box(g.with_pixel_box(rows, "layout", "pixel", *_size()), "own", "own_box", *_size())
    unit, pixel, own = F.col("unit"), F.col("pixel"), F.col("own_box")
    crop = F.struct(F.lit(0.1).alias("left"), F.lit(0.2).alias("top"), F.lit(0.5).alias("width"), F.lit(0.25).alias("height"))
    rows = rows.withColumn("anchor", g.placed_in_anchor(unit, crop))
    anchor = F.col("anchor")
    both = g.union_box(own, pixel)
    text, ground = color.parse_hex(F.col("text_color"), color.rgb(17, 17, 17)), color.parse_hex(
        F.col("background_color"), color.rgb(255, 255, 255))
    return rows.select(
        "image_id", "ord",
        *[unit[e].alias(f"unit_{e}") for e in g.EDGES],
        *[pixel[e].alias(f"pixel_{e}") for e in g.EDGES],
        *[F.round(anchor[e], 9).alias(f"anchor_{e}") for e in ("left", "top", "width", "height")],
        *[both[e].alias(f"union_{e}") for e in g.EDGES],
        g.boxes_overlap(own, pixel).alias("overlaps"),
        F.round(g.font_share(F.col("font_size"), unit, F.col("orientation"), F.lit(0.25)), 9).alias("font_ratio"),
        v.clamp_finite(F.col("rotation"), -180.0, 180.0).alias("rotation"),
        color.normalize_color(F.col("text_color"), "#111111").alias("text_color"),
        color.rgb_to_hex(text).alias("text_hex"),
        F.round(color.color_distance(text, ground), 6).alias("contrast"),
        g.format_box(layout).alias("layout_text"),
    )


def normalize_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixel_regions(spark, sf_dir)
    return rows.select(
        "image_id", "ord", "translated", "region_kind", *g.EDGES, "has_layout_box",
        *[f"layout_{e}" for e in g.EDGES], F.round("font_px", 6).alias("font_px"),
        color.rgb_to_hex(F.col("text_rgb")).alias("text_hex"), color.rgb_to_hex(F.col("stroke_rgb")).alias("stroke_hex"),
        F.round("stroke_px", 6).alias("stroke_px"), "rotation",
    )


def region_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = styled_regions(spark, sf_dir).withColumn("has_confidence", F.col("ord") % 4 != 0)
    return rows.groupBy("image_id").agg(
        F.count_if(r.reliable()).alias("n_accepted"), F.count_if(~r.reliable()).alias("n_rejected"),
        F.round(r.average_confidence(), 6).alias("average_confidence"),
    )


def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.overlap_report(_plain_boxes(spark, sf_dir, "v_chained")).withColumn("best_iou", F.round("best_iou", 9))


def dedup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.dedup_regions(_plain_boxes(spark, sf_dir, "v_regions", by="l_orderkey")).select(
        "image_id", "slot_ord", "ord", *g.EDGES, "confidence")


def dedup_chained_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.dedup_regions(_plain_boxes(spark, sf_dir, "v_chained")).select(
        "image_id", "slot_ord", "ord", *g.EDGES, "confidence")


def clean_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: the reliable, normalised, deduplicated regions of each image."""
    accepted, _ = r.split_reliable(styled_regions(spark, sf_dir))
    kept = r.dedup_regions(r.normalize_regions(accepted, *_size()))
    return kept.select("image_id", "slot_ord", "ord", "left", "top", "right", "bottom")


# ------------------------------------------------------------------ SQL twins

def _px(alias: str, x0: str, y0: str, x1: str, y1: str, where: str = "TRUE") -> str:
    def unit(x: str) -> str:
        return f"least(1000.0::DOUBLE, greatest(0.0::DOUBLE, ({x})::DOUBLE))"

    edges = {
        "left": f"floor(least({unit(x0)}, {unit(x1)}) / 1000 * {IMAGE_WIDTH})",
        "top": f"floor(least({unit(y0)}, {unit(y1)}) / 1000 * {IMAGE_HEIGHT})",
        "right": f"ceil(greatest({unit(x0)}, {unit(x1)}) / 1000 * {IMAGE_WIDTH})",
        "bottom": f"ceil(greatest({unit(y0)}, {unit(y1)}) / 1000 * {IMAGE_HEIGHT})",
    }
    big = f"{edges['right']} - {edges['left']} >= 2 AND {edges['bottom']} - {edges['top']} >= 2"
    fields = ", ".join(f"'{e}': {text}::BIGINT" for e, text in edges.items())
    return f"CASE WHEN {where} AND {big} THEN {{{fields}}} END AS {alias}"


def _unit_box(alias: str) -> str:
    return f"""CASE WHEN has_layout AND abs(cl(lx1) - cl(lx0)) >= 2 AND abs(cl(ly1) - cl(ly0)) >= 2
  THEN {{'left': least(cl(lx0), cl(lx1)), 'top': least(cl(ly0), cl(ly1)), 'right': greatest(cl(lx0), cl(lx1)),
    'bottom': greatest(cl(ly0), cl(ly1))}} END AS {alias}""".replace("cl(", "least(1000.0::DOUBLE, greatest(0.0::DOUBLE, ").replace(
        "lx0)", "lx0::DOUBLE))").replace("lx1)", "lx1::DOUBLE))").replace("ly0)", "ly0::DOUBLE))").replace("ly1)", "ly1::DOUBLE))")


def _hex(c: str, fallback: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '#[0-9a-fA-F]{{6}}') THEN lower({c}) ELSE {fallback} END"


_NUMBER_TYPES = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"
_FIELDS = "['box', 'layoutBox', 'original', 'translated', 'confidence', 'regionKind', 'orientation', 'fontSize', " \
    "'textColor', 'backgroundColor', 'bold', 'fontStyle', 'strokeColor', 'strokeWidth', 'italic', 'rotation', " \
    "'align', 'backgroundComplex']"
_ANSWER_REGIONS = f"""
WITH envelope AS (
  SELECT image_id, n, CASE WHEN json_valid(output) THEN output END AS j,
    CASE WHEN NOT json_valid(output) THEN 'invalid_json' WHEN json_type(output) <> 'OBJECT' THEN 'not_an_object'
      WHEN coalesce(json_type(output, '$.regions'), '') <> 'ARRAY' THEN 'regions_not_an_array'
      ELSE array_to_string(list_transform(list_sort(list_filter(json_keys(output), lambda k: k <> 'regions')),
        lambda k: 'unexpected:' || k), ',') END AS fault
  FROM v_answers
),
listed AS (
  SELECT image_id, n, unnest(CAST(j->'$.regions' AS JSON[])) AS r,
    generate_subscripts(CAST(j->'$.regions' AS JSON[]), 1) AS ord
  FROM envelope WHERE fault = ''
),
checked AS (
  SELECT image_id, n, ord, r, list_filter([
      CASE WHEN json_array_length(r, '$.box') <> 4 THEN 'size:box' END,
      CASE WHEN json_type(r, '$.confidence') IS NULL THEN 'missing:confidence'
        WHEN json_type(r, '$.confidence') NOT IN {_NUMBER_TYPES} THEN 'type:confidence'
        WHEN CAST(r->>'$.confidence' AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'range:confidence' END,
      CASE WHEN r->>'$.regionKind' NOT IN ('dialogue', 'narration', 'sfx', 'label') THEN 'enum:regionKind' END,
      CASE WHEN json_type(r, '$.bold') <> 'BOOLEAN' THEN 'type:bold' END], lambda f: f IS NOT NULL)
    || list_transform(list_sort(list_filter(json_keys(r), lambda k: NOT list_contains({_FIELDS}, k))),
      lambda k: 'unexpected:' || k) AS faults
  FROM listed
)"""

_FOLD = """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k, coalesce(confidence, 0) AS c FROM boxes
),
fold AS (
  SELECT image_id, k, [{'slot': ord, 'ord': ord, 'l': "left", 't': top, 'r': "right", 'b': bottom, 'c': c}] AS kept
  FROM numbered WHERE k = 1
  UNION ALL
  SELECT image_id, k, CASE
      WHEN hit IS NULL THEN list_append(kept, {'slot': ord, 'ord': ord, 'l': "left", 't': top, 'r': "right", 'b': bottom, 'c': c})
      WHEN c > kept[hit].c THEN list_transform(kept, lambda s, i: CASE WHEN i = hit THEN
        {'slot': s.slot, 'ord': ord, 'l': "left", 't': top, 'r': "right", 'b': bottom, 'c': c} ELSE s END)
      ELSE kept END AS kept
  FROM (
    SELECT n.image_id, n.k, n.ord, n."left", n.top, n."right", n.bottom, n.c, f.kept,
      list_position(list_transform(f.kept, lambda s:
        (greatest(0, least(s.r, n."right") - greatest(s.l, n."left")) * greatest(0, least(s.b, n.bottom) - greatest(s.t, n.top)))::DOUBLE
        / ((s.r - s.l) * (s.b - s.t) + (n."right" - n."left") * (n.bottom - n.top)
          - greatest(0, least(s.r, n."right") - greatest(s.l, n."left")) * greatest(0, least(s.b, n.bottom) - greatest(s.t, n.top)))
        >= 0.72), true) AS hit
    FROM fold f JOIN numbered n ON n.image_id = f.image_id AND n.k = f.k + 1
  ) step
),
slots AS (
  SELECT image_id, unnest(arg_max(kept, k)) AS s FROM fold GROUP BY image_id
)"""


def _boxes(name: str) -> str:
    return f"""boxes AS (
  SELECT image_id, ord, confidence, b."left", b.top, b."right", b.bottom
  FROM (SELECT image_id, ord, confidence, {_px('b', 'x0', 'y0', 'x1', 'y1')} FROM {name} WHERE trim(translated, {BLANKS}) <> '') q
  WHERE b IS NOT NULL
)"""


def _dedup_sql(name: str) -> str:
    return with_views(f"""
WITH RECURSIVE {_boxes(name)}{_FOLD}
SELECT s.image_id, s.s.slot AS slot_ord, s.s.ord AS ord, s.s.l AS "left", s.s.t AS top, s.s.r AS "right", s.s.b AS bottom,
  x.confidence FROM slots s JOIN boxes x ON x.image_id = s.image_id AND x.ord = s.s.ord""".replace(
        "WITH RECURSIVE ", "WITH "), name).replace("WITH ", "WITH RECURSIVE ", 1)


_NORMAL = f"""
WITH px AS (
  SELECT *, {_px('own', 'x0', 'y0', 'x1', 'y1')}, {_px('found', 'lx0', 'ly0', 'lx1', 'ly1', 'has_layout')},
    CASE WHEN region_kind IN ('dialogue', 'narration', 'sfx', 'label') THEN region_kind
      WHEN background_complex THEN 'label' ELSE 'dialogue' END AS kind
  FROM v_styled WHERE trim(translated, {BLANKS}) <> ''
),
fit AS (
  SELECT *, found IS NOT NULL AND NOT (kind IN ('dialogue', 'narration') AND
    (found."right" - found."left") * (found.bottom - found.top) < (own."right" - own."left") * (own.bottom - own.top) * 0.68::DOUBLE) AS has_layout_box
  FROM px WHERE own IS NOT NULL
),
normal AS (
  SELECT image_id, ord, confidence, trim(translated, {BLANKS}) AS translated, kind AS region_kind, own."left", own.top, own."right", own.bottom,
    coalesce(has_layout_box, FALSE) AS has_layout_box,
    CASE WHEN has_layout_box THEN found ELSE own END AS lay,
    round(least(240, greatest(7, coalesce(nullif(font_size, 0), (own.bottom - own.top)::DOUBLE / {IMAGE_HEIGHT} * 820) / 1000 * {IMAGE_HEIGHT})), 6) AS font_px,
    {_hex('text_color', "'#111111'")} AS text_hex,
    {_hex('stroke_color', _hex('background_color', "'#ffffff'"))} AS stroke_hex,
    round(stroke_width / 1000 * {IMAGE_HEIGHT}, 6) AS stroke_px,
    least(180.0::DOUBLE, greatest(-180.0::DOUBLE, rotation)) AS rotation
  FROM fit
)"""

QUERIES = {
    "scan_model_regions": scan_model_regions,
    "quarantined_regions": quarantined_regions,
    "scan_model_reviews": scan_model_reviews,
    "box_functions": box_functions,
    "normalize_regions": normalize_regions,
    "region_confidence": region_confidence,
    "overlap_report": overlap_report,
    "dedup_regions": dedup_regions,
    "dedup_chained_regions": dedup_chained_regions,
    "clean_regions": clean_regions,
}

ORACLES = {
    "scan_model_regions": with_views(_ANSWER_REGIONS + """
SELECT image_id, n, ord, array_to_string(CAST(CAST(r->'$.box' AS DOUBLE[]) AS VARCHAR[]), ',') AS box,
  r->>'$.original' AS original, CAST(r->>'$.confidence' AS DOUBLE) AS confidence, r->>'$.regionKind' AS region_kind,
  CAST(r->>'$.fontSize' AS DOUBLE) AS font_size, CAST(r->>'$.rotation' AS DOUBLE) AS rotation,
  CAST(r->>'$.bold' AS BOOLEAN) AS bold, CAST(r->>'$.backgroundComplex' AS BOOLEAN) AS background_complex,
  TRUE AS has_confidence FROM checked WHERE len(faults) = 0""", "v_answers"),
    "quarantined_regions": with_views(_ANSWER_REGIONS + """
SELECT image_id, n, ord, array_to_string(faults, ',') AS violations FROM checked WHERE len(faults) > 0
UNION ALL SELECT image_id, n, NULL::BIGINT, fault FROM envelope WHERE fault <> ''""", "v_answers"),
    "scan_model_reviews": f"""
WITH answers AS ({_REVIEW_TEXT})
SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 5, 6) THEN CAST(output->>'$.passed' AS BOOLEAN) END AS passed,
  CASE WHEN doc_id % 7 IN (1, 5, 6) THEN output->>'$.summary' END AS summary,
  CASE WHEN doc_id % 7 IN (1, 5, 6) THEN array_to_string(CAST(output->'$.issues' AS VARCHAR[]), '|') END AS issues,
  CASE doc_id % 7 WHEN 0 THEN 'type:passed' WHEN 2 THEN 'missing:summary,type:issues' WHEN 3 THEN 'invalid_json'
    WHEN 4 THEN 'unexpected:more' ELSE '' END AS violations
FROM (SELECT doc_id, CASE WHEN json_valid(output) THEN output::JSON END AS output FROM answers) a""",
    "box_functions": with_views(f"""
WITH b AS (
  SELECT *, {_px('own', 'x0', 'y0', 'x1', 'y1')}, {_px('px', 'lx0', 'ly0', 'lx1', 'ly1', 'has_layout')}, {_unit_box('u')},
    {_hex('text_color', "'#111111'")} AS th, {_hex('background_color', "'#ffffff'")} AS bh
  FROM v_styled
)
SELECT image_id, ord, u."left" AS unit_left, u.top AS unit_top, u."right" AS unit_right, u.bottom AS unit_bottom,
  px."left" AS pixel_left, px.top AS pixel_top, px."right" AS pixel_right, px.bottom AS pixel_bottom,
  round(0.1 + u."left" / 1000 * 0.5, 9) AS anchor_left, round(0.2 + u.top / 1000 * 0.25, 9) AS anchor_top,
  round((u."right" - u."left") / 1000 * 0.5, 9) AS anchor_width, round((u.bottom - u.top) / 1000 * 0.25, 9) AS anchor_height,
  least(own."left", coalesce(px."left", own."left")) AS union_left, least(own.top, coalesce(px.top, own.top)) AS union_top,
  greatest(own."right", coalesce(px."right", own."right")) AS union_right, greatest(own.bottom, coalesce(px.bottom, own.bottom)) AS union_bottom,
  own."left" < px."right" AND own."right" > px."left" AND own.top < px.bottom AND own.bottom > px.top AS overlaps,
  round(CASE WHEN font_size > 0 THEN font_size / 1000 * 0.25 WHEN u IS NULL THEN 0.03
    ELSE greatest(0.012, (CASE orientation WHEN 'vertical' THEN u."right" - u."left" ELSE u.bottom - u.top END) / 1000 * 0.25 * 0.82) END, 9)::DOUBLE AS font_ratio,
  least(180.0::DOUBLE, greatest(-180.0::DOUBLE, rotation)) AS rotation,
  CASE WHEN regexp_full_match(trim(text_color), '#[0-9a-fA-F]{{6}}') THEN trim(text_color) ELSE '#111111' END AS text_color,
  th AS text_hex,
  round(sqrt(pow(('0x' || th[2:3])::INT - ('0x' || bh[2:3])::INT, 2) + pow(('0x' || th[4:5])::INT - ('0x' || bh[4:5])::INT, 2)
    + pow(('0x' || th[6:7])::INT - ('0x' || bh[6:7])::INT, 2)), 6) AS contrast,
  CASE WHEN has_layout THEN lx0 || ',' || ly0 || ',' || lx1 || ',' || ly1 ELSE '' END AS layout_text
FROM b""", "v_styled"),
    "normalize_regions": with_views(_NORMAL + """
SELECT * EXCLUDE (lay, confidence), lay."left" AS layout_left, lay.top AS layout_top, lay."right" AS layout_right, lay.bottom AS layout_bottom
FROM normal""", "v_styled"),
    "region_confidence": with_views("""
SELECT image_id, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (NOT ok) AS n_rejected, round(avg(counted), 6) AS average_confidence
FROM (SELECT image_id, CASE WHEN ord % 4 <> 0 THEN coalesce(confidence, 0) END AS counted,
  coalesce(ord % 4 <> 0 AND confidence >= 0.45, FALSE) AS ok FROM v_styled) q GROUP BY image_id""", "v_styled"),
    "overlap_report": with_views(f"""
WITH {_boxes('v_chained')},
u AS (SELECT image_id, "left", top, "right", bottom, count(*) AS n FROM boxes GROUP BY ALL),
p AS (
  SELECT a.image_id, a."left", a.top, a."right", a.bottom, b.n AS n_other,
    (least(a."right", b."right") - greatest(a."left", b."left"))::DOUBLE * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS s,
    (a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top) AS both_areas
  FROM u a JOIN u b ON a.image_id = b.image_id AND (a."left", a.top, a."right", a.bottom) <> (b."left", b.top, b."right", b.bottom)
    AND a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom
)
SELECT u.image_id, u."left", u.top, u."right", u.bottom, any_value(u.n) AS n_equal,
  CAST(coalesce(sum(n_other), 0) AS BIGINT) AS n_near, round(max(s / (both_areas - s)), 9) AS best_iou
FROM u LEFT JOIN p ON (u.image_id, u."left", u.top, u."right", u.bottom) = (p.image_id, p."left", p.top, p."right", p.bottom)
  AND s / (both_areas - s) >= 0.72
GROUP BY u.image_id, u."left", u.top, u."right", u.bottom""", "v_chained"),
    "dedup_regions": _dedup_sql("v_regions"),
    "dedup_chained_regions": _dedup_sql("v_chained"),
    "clean_regions": with_views(f"""
{_NORMAL},
boxes AS (SELECT image_id, ord, confidence, "left", top, "right", bottom FROM normal WHERE confidence >= 0.45){_FOLD}
SELECT image_id, s.slot AS slot_ord, s.ord AS ord, s.l AS "left", s.t AS top, s.r AS "right", s.b AS bottom FROM slots""", "v_styled").replace("WITH ", "WITH RECURSIVE ", 1),
}
