"""Registered queries of the page harvest and picture payload jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import geometry as g, media, text as t, values as v
from panelflow.operators import pages as p
from panelflow.plans import jobs
from panelflow.plans.derived import table, view, with_views
from panelflow.session import materialize


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: most queries read them more than once, and each time would walk every page again."""
    return materialize(p.harvest_images(view(spark, sf_dir, "v_pages_rich", heavy=True)), "harvest")


def harvest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).drop("position")
    none = F.lit(None).cast("double")
    return rows.withColumn("big", p.big_enough(F.col("width"), F.col("height"), none, none)).withColumn(
        "shown", p.visible(F.col("visibility"), F.col("display"), F.col("opacity"), F.lit(False))).drop("visibility", "display", "opacity")


def page_tree_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures under hidden parents, in shadow roots and in the pages' own style sheets."""
    shown = p.visible(F.col("visibility"), F.col("display"), F.col("opacity"), F.lit(False))
    return p.harvest_images(view(spark, sf_dir, "v_pages_tree", heavy=True)).select(
        "page_id", "element", "source_url", "visibility", "display", F.round("opacity", 6).alias("opacity"), shown.alias("shown"))


def screened_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left after size, visibility and the already seen ones."""
    rows = _candidates(spark, sf_dir)
    seen = rows.where("page_id % 20 = 4 and element = 'img'")
    none = F.lit(None).cast("double")
    kept = rows.where(p.big_enough(F.col("width"), F.col("height"), none, none)).where(
        p.visible(F.col("visibility"), F.col("display"), F.col("opacity"), F.col("page_id") % 30 == 0))
    return p.unseen(kept, seen).groupBy("element").agg(
        F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("page_id_sum"), F.sum("width").alias("width_sum"))


def harvest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: visible, new candidates, the small ones marked."""
    none = F.lit(None).cast("double")
    seen = _candidates(spark, sf_dir).where("page_id % 20 = 4 and element = 'img'").select("page_id", "source_url")
    return jobs.harvest(view(spark, sf_dir, "v_pages_rich", heavy=True), seen, none, none).select(
        "page_id", "page_url", "element", "source_url", "width", "height", "small")


def match_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    twice = rows.unionByName(rows.withColumn("position", F.col("position") + 100_000))
    requests = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"), "page_id",
        F.when(F.col("page_id") % 10 == 6, "inline-svg:").otherwise("canvas:").alias("url"))
    return p.match_requested(requests, twice).select("request_id", "page_id", "url", "element")


def _process(shown: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    small = ~p.big_enough(F.col("width"), F.col("height"), none, none)
    k = F.col("page_id") % 7
    return shown.select(
        "page_id", "source_url", small.alias("skipped_small"),
        F.when(~small & (k == 1), "Failed to fetch").when(~small & (k == 2), "bad picture").alias("error"),
        F.when(~small & (k != 3), F.col("page_id") % 4).otherwise(0).alias("regions"))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds over candidates that appear one after the other, then the summary."""
    rows = _candidates(spark, sf_dir).withColumn("appears", F.when(F.col("element") == "canvas", 1).otherwise(0))
    late = rows.withColumn("source_url", F.concat("source_url", F.lit("#late"))).withColumn("appears", F.lit(2))
    later = rows.withColumn("source_url", F.concat("source_url", F.lit("#later"))).withColumn("appears", F.lit(3))
    return p.page_summary(p.rescan_rounds(rows.unionByName(late).unionByName(later), _process))


def sniff_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    magic = F.element_at(F.array(*[F.lit(x) for x in _MAGIC]), (F.col("doc_id") % 8 + 1).cast("int"))
    header = F.element_at(F.array(*[F.lit(x) for x in _HEADERS]), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.concat(F.unhex(magic), F.encode("text", "UTF-8"))
    return docs.select("doc_id", content.alias("content"), header.alias("header")).select(
        "doc_id", media.sniff_mime(F.col("content"), F.col("header")).alias("mime"),
        F.length("content").cast("bigint").alias("n_bytes"), t.format_bytes(F.length("content")).alias("size_text"))


_MAGIC = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "3C73766720", "203C3F786D6C3E3C73766720", "", "52494646000000005741564520")
_HEADERS = ("", "text/html; charset=utf-8", "IMAGE/AVIF", " image/svg+xml ;q=1", "application/octet-stream")


def admit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_requests", heavy=True).withColumn(
        "plan", media.review_plan(F.col("review_mode"), F.col("skip"), F.col("attempts")))
    return rows.select(
        "conv_id", "turn", media.reject_reason(F.col("mime"), F.col("data")).alias("reason"),
        media.base64_bytes(F.coalesce("data", F.lit(""))).alias("n_bytes"),
        media.positive_integer(F.col("turn").cast("double")).alias("image_index"),
        F.col("plan.mode").alias("mode"), F.col("plan.max_attempts").cast("bigint").alias("max_attempts"),
        media.render_mode(F.col("render")).alias("render_mode"),
        v.clamp_setting(F.col("attempts"), 1, 12, 6).alias("concurrency"),
        v.bounded_setting(F.col("attempts") * 9000 + 1000, 1024, 65535, 38473).alias("port"),
        t.format_source(F.col("element"), F.col("source_url")).alias("source"),
        t.format_duration(F.length("text") * 997.0).alias("duration"),
        t.single_line(F.col("text"), 500).alias("line"),
    )


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_requests", heavy=True).withColumn(
        "url", F.concat(F.lit("data:"), F.coalesce("mime", F.lit("image/png;v=1")), F.lit(";base64,"), "data"))
    parsed = media.parse_data_url(F.col("url"))
    return rows.select("conv_id", "turn", parsed["mime"].alias("mime"), F.length(parsed["data"]).cast("bigint").alias("n_data"))


def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading-copy and sending sizes over widths and heights from the documents' lengths."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") % 9001 + 1).alias("w"), (F.col("doc_id") * 37 % 5003 + 1).alias("h"),
        F.when(F.col("doc_id") % 3 == 0, "image/gif").otherwise("image/PNG").alias("mime"), (F.col("n_chars") * 4000).alias("n"))
    ocr = g.ocr_size(F.col("w"), F.col("h"))
    sent = g.source_size(F.col("w"), F.col("h"), F.col("mime"), F.col("n"))
    plan = media.upload_plan(F.element_at(F.array(*[F.lit(s) for s in (".PNG", ".jpg", ".bmp", ".gif")]), (F.col("doc_id") % 4 + 1).cast("int")), F.col("n"))
    return rows.select(
        "doc_id", ocr["width"].alias("ocr_width"), ocr["height"].alias("ocr_height"), F.round(ocr["scale"], 9).alias("ocr_scale"),
        sent["action"].alias("action"), sent["width"].alias("width"), sent["height"].alias("height"),
        plan["action"].alias("upload"), plan["mime"].alias("upload_mime"), plan["reason"].alias("upload_reason"))


# ------------------------------------------------------------------ SQL twins

_HARVEST = """
WITH base AS (
  SELECT page_id, url, page_id % 10 AS k, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
    regexp_replace(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '[^/]*$', '') AS dir,
    html LIKE '%<article>%' AS has_article
  FROM v_pages_rich
),
e(k, element, width, height, shown) AS (VALUES (0, 'img', 640, 360, TRUE), (1, 'img', 60, 30, TRUE), (2, 'img', 300, 200, TRUE),
  (3, 'div', NULL, NULL, TRUE), (4, 'img', 500, 400, TRUE), (4, 'canvas', 200, 100, TRUE), (5, 'span', NULL, NULL, TRUE),
  (6, 'svg', 120, 80, TRUE), (7, 'img', 120, 80, FALSE), (8, 'img', 121, 79, TRUE), (9, 'img', 900, 900, TRUE)),
found AS (
  SELECT page_id, url AS page_url, element, CASE
      WHEN k = 0 THEN origin || '/a/' || page_id || '.png' WHEN k = 1 THEN origin || dir || 'b.jpg' WHEN k = 2 THEN origin || dir || 'c.webp'
      WHEN k = 3 THEN origin || dir || 'e.png' WHEN element = 'canvas' THEN 'canvas:'
      WHEN k = 4 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.com/z.jpg'
      WHEN k = 5 THEN origin || (CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END) || 'up/f.png'
      WHEN k = 6 THEN 'inline-svg:' WHEN k = 7 THEN 'https://o.example.net/p.png?x=1&y=2' WHEN k = 8 THEN origin || dir || 'g.png'
      ELSE 'screen-capture:' END AS source_url,
    width::BIGINT AS width, height::BIGINT AS height, coalesce(width >= 120 AND height >= 80, FALSE) AS big, shown
  FROM base JOIN e USING (k)
)"""

QUERIES = {
    "harvest_images": harvest_images,
    "page_tree_images": page_tree_images,
    "screened_candidates": screened_candidates,
    "harvest_job": harvest_job,
    "match_requested": match_requested,
    "page_summary": page_summary,
    "sniff_mime": sniff_mime,
    "admit_requests": admit_requests,
    "data_urls": data_urls,
    "picture_sizes": picture_sizes,
}

ORACLES = {
    "harvest_images": with_views(_HARVEST + " SELECT * FROM found", "v_pages_rich"),
    "page_tree_images": with_views("""
WITH e(k, element, path, visibility, display, opacity, shown) AS (VALUES
  (0, 'img', '/h.png', 'visible', 'none', 1.0::DOUBLE, FALSE), (1, 'img', '/h.png', 'visible', 'none', 1.0::DOUBLE, FALSE), (2, 'img', '/a.png', 'hidden', 'inline', 1.0::DOUBLE, FALSE),
  (2, 'img', '/b.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (3, 'img', '/o.png', 'visible', 'inline', 0.04::DOUBLE, FALSE), (3, 'img', '/q.png', 'visible', 'inline', 0.5::DOUBLE, TRUE),
  (4, 'img', '/i.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (5, 'div', '/hero.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (5, 'div', '/top.png', 'visible', 'inline', 1.0::DOUBLE, TRUE),
  (5, 'x-m', '/m.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (6, 'x-b', '/s.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (6, 'img', '/in.png', 'visible', 'inline', 1.0::DOUBLE, TRUE),
  (7, 'img', '/g.png', 'visible', 'none', 1.0::DOUBLE, FALSE), (7, 'span', '/p.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (8, 'img', '/l1.png', 'visible', 'none', 1.0::DOUBLE, FALSE),
  (8, 'img', '/l2.png', 'visible', 'inline', 1.0::DOUBLE, TRUE), (9, 'img', '/d.png', 'visible', 'inline', 1.0::DOUBLE, TRUE))
SELECT page_id, element, regexp_extract(url, '^(https?://[^/?#]+)', 1) || path AS source_url, visibility, display, opacity, shown
FROM v_pages_tree JOIN e ON page_id % 10 = k""", "v_pages_tree"),
    "screened_candidates": with_views(_HARVEST + """
SELECT element, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS page_id_sum, CAST(sum(width) AS BIGINT) AS width_sum FROM found
WHERE big AND shown AND page_id % 30 <> 0 AND NOT (page_id % 20 = 4 AND element = 'img') GROUP BY element""", "v_pages_rich"),
    "harvest_job": with_views(_HARVEST + """
SELECT page_id, page_url, element, source_url, width, height, NOT big AS small FROM found
WHERE shown AND NOT (page_id % 20 = 4 AND element = 'img')""", "v_pages_rich"),
    "match_requested": with_views(_HARVEST + """
SELECT page_id AS request_id, page_id, source_url AS url, element FROM found WHERE element IN ('canvas', 'svg')""", "v_pages_rich"),
    "page_summary": with_views(_HARVEST + """,
shown_in AS (
  SELECT page_id, big, CASE element WHEN 'canvas' THEN 1 ELSE 0 END AS r FROM found
  UNION ALL SELECT page_id, big, 2 FROM found
),
outcome AS (
  SELECT page_id, r, NOT big AS small, CASE WHEN big AND page_id % 7 = 1 THEN 'Failed to fetch' WHEN big AND page_id % 7 = 2 THEN 'bad picture' END AS error,
    CASE WHEN big AND page_id % 7 <> 3 THEN page_id % 4 ELSE 0 END AS regions FROM shown_in
),
stopped AS (SELECT page_id, min(r) AS r FROM outcome WHERE error = 'Failed to fetch' GROUP BY page_id),
taken AS (SELECT o.* FROM outcome o LEFT JOIN stopped s USING (page_id) WHERE s.r IS NULL OR o.r <= s.r)
SELECT page_id, count(*) AS processed, count(*) FILTER (NOT small AND error IS NULL AND regions > 0) AS translated,
  CAST(coalesce(sum(regions) FILTER (NOT small AND error IS NULL), 0) AS BIGINT) AS phrases, count(*) FILTER (NOT small AND error IS NOT NULL) AS failed,
  count(*) FILTER (small) AS small, coalesce(bool_or(error = 'Failed to fetch'), FALSE) AS fatal,
  count(*) FILTER (NOT small AND error IS NOT NULL) = count(*) OR coalesce(bool_or(error = 'Failed to fetch'), FALSE) AS run_failed
FROM taken GROUP BY page_id""", "v_pages_rich"),
    "sniff_mime": f"""
WITH c AS (
  SELECT doc_id, unhex({list(_MAGIC)}[doc_id % 8 + 1]) || encode(text) AS content, {list(_HEADERS)}[doc_id % 5 + 1] AS header FROM documents
),
h AS (SELECT *, hex(content) AS x, lower(trim(split_part(header, ';', 1))) AS told FROM c)
SELECT doc_id, CASE WHEN told IN {media.KNOWN_TYPES} THEN told WHEN starts_with(x, 'FFD8') THEN 'image/jpeg' WHEN starts_with(x, '89504E47') THEN 'image/png'
    WHEN starts_with(x, '474946') THEN 'image/gif' WHEN starts_with(x, '52494646') AND x[17:24] = '57454250' THEN 'image/webp'
    WHEN doc_id % 8 IN (4, 5) THEN 'image/svg+xml' END AS mime,
  octet_length(content) AS n_bytes,
  CASE WHEN octet_length(content) < 1024 THEN octet_length(content) || ' B'
    WHEN octet_length(content) < 1048576 THEN printf('%.1f', floor(octet_length(content) / 1024 * 10 + 0.5) / 10) || ' KB'
    ELSE printf('%.2f', floor(octet_length(content) / 1048576 * 100 + 0.5) / 100) || ' MB' END AS size_text
FROM h""",
    "admit_requests": with_views("""
SELECT conv_id, turn, CASE WHEN mime IS NULL OR data = '' THEN 'no_image' WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'type'
    WHEN NOT regexp_full_match(data, '[a-zA-Z0-9+/=\\r\\n]+') THEN 'base64'
    WHEN octet_length(encode(regexp_replace(data, '[\\r\\n]', '', 'g'))) * 3 // 4 - (CASE WHEN data LIKE '%==' THEN 2 WHEN data LIKE '%=' THEN 1 ELSE 0 END)
      NOT BETWEEN 1 AND 15728640 THEN 'size' END AS reason,
  greatest(0, length(data) * 3 // 4 - (CASE WHEN data LIKE '%==' THEN 2 WHEN data LIKE '%=' THEN 1 ELSE 0 END)) AS n_bytes,
  nullif(turn, 0)::BIGINT AS image_index,
  CASE WHEN review_mode = 'manual' THEN 'manual' WHEN skip THEN 'skipped' ELSE 'automatic' END AS mode,
  CAST(CASE WHEN review_mode = 'manual' THEN 1 WHEN skip THEN 0 WHEN attempts <> floor(attempts) THEN 3 ELSE least(5, greatest(1, attempts)) END AS BIGINT) AS max_attempts,
  CASE WHEN render = 'codex-image' THEN render ELSE 'local' END AS render_mode,
  CAST(CASE WHEN attempts <> floor(attempts) THEN 6 ELSE least(12, greatest(1, attempts)) END AS BIGINT) AS concurrency,
  CAST(CASE WHEN attempts * 9000 + 1000 <> floor(attempts * 9000 + 1000) OR attempts * 9000 + 1000 NOT BETWEEN 1024 AND 65535 THEN 38473 ELSE attempts * 9000 + 1000 END AS BIGINT) AS port,
  (CASE WHEN element = '' THEN '이미지' ELSE '<' || left(element, 20) || '>' END) || ' · ' || CASE conv_id % 7 WHEN 0 THEN 'canvas:'
    WHEN 1 THEN 'img.example.com/a b/' || turn || '.png' WHEN 2 THEN '출처 미상' WHEN 3 THEN 'x.example.org/' ELSE 'pages/' || turn || '.png' END AS source,
  CASE WHEN floor(length(text) * 997.0::DOUBLE / 1000 + 0.5) < 60 THEN CAST(floor(length(text) * 997.0::DOUBLE / 1000 + 0.5) AS BIGINT) || '초'
    ELSE CAST(floor(length(text) * 997.0::DOUBLE / 1000 + 0.5) AS BIGINT) // 60 || '분 ' || CAST(floor(length(text) * 997.0::DOUBLE / 1000 + 0.5) AS BIGINT) % 60 || '초' END AS duration,
  left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) AS line
FROM v_requests""", "v_requests"),
    "data_urls": with_views("""
SELECT conv_id, turn, CASE WHEN mime IS NOT NULL AND data <> '' THEN mime END AS mime,
  CASE WHEN mime IS NOT NULL AND data <> '' THEN length(data) END AS n_data FROM v_requests""", "v_requests"),
    "picture_sizes": """
WITH s AS (
  SELECT doc_id, n_chars % 9001 + 1 AS w, doc_id * 37 % 5003 + 1 AS h, CASE WHEN doc_id % 3 = 0 THEN 'image/gif' ELSE 'image/png' END AS mime, n_chars * 4000 AS n FROM documents
),
d AS (SELECT *, greatest(w, h) AS l, ['.png', '.jpg', '.bmp', '.gif'][doc_id % 4 + 1] AS suffix FROM s),
k AS (
  SELECT *, greatest(0.01::DOUBLE, least(CASE WHEN l < 1000 THEN least(4::DOUBLE, 1600::DOUBLE / l) WHEN l < 1800 THEN 2400::DOUBLE / l WHEN l < 2600 THEN 1.35::DOUBLE ELSE 1 END,
      4096::DOUBLE / l, sqrt(16000000::DOUBLE / (w * h)))) AS scale,
    least(1::DOUBLE, 8192::DOUBLE / l, sqrt(32000000::DOUBLE / (w * h))) AS shrink,
    mime = 'image/png' AND l <= 8192 AND w * h <= 32000000 AND n <= 18500000 AS keep
  FROM d
)
SELECT doc_id, CAST(greatest(1, floor(w * scale + 0.5)) AS BIGINT) AS ocr_width, CAST(greatest(1, floor(h * scale + 0.5)) AS BIGINT) AS ocr_height,
  round(scale, 9) AS ocr_scale, CASE WHEN keep THEN 'keep' ELSE 'convert' END AS action,
  CASE WHEN keep THEN w ELSE CAST(greatest(1, floor(w * shrink + 0.5)) AS BIGINT) END AS width,
  CASE WHEN keep THEN h ELSE CAST(greatest(1, floor(h * shrink + 0.5)) AS BIGINT) END AS height,
  CASE WHEN suffix = '.gif' THEN 'reject' WHEN suffix <> '.bmp' AND n <= 14680064 THEN 'pass' ELSE 'convert' END AS upload,
  CASE WHEN suffix = '.gif' THEN NULL WHEN suffix = '.jpg' AND n <= 14680064 THEN 'image/jpeg' ELSE 'image/png' END AS upload_mime,
  CASE WHEN suffix = '.gif' THEN 'type' END AS upload_reason
FROM k""",
}
