"""Registered queries of the archive jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import text as t
from panelflow.operators import archives as a
from panelflow.operators.metrics import StageMetrics
from panelflow.plans.derived import table, view, with_views
from panelflow.session import materialize, scratch_path
from panelflow.sources import archives as source


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_entries").withColumnRenamed("archive_id", "archive")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.number_images(_entries(spark, sf_dir), block=F.floor(F.col("entry_index") / 5000).cast("bigint"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("entry_index")
    return a.outcomes(_images(spark, sf_dir).select(
        "archive", "entry_index", "image_number", "name", "skip", (i % 97 == 0).alias("cancelled"),
        F.when(F.col("error"), F.concat(F.lit("bad "), (i % 3).cast("string"))).alias("error"), "changed",
        (i % 5).alias("region_count"), (i % 8 == 0).alias("review_required"), (i % 3 + 1).alias("attempts")))


def number_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("archive", "entry_index", "name", "image_number")


def entry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("archive", "entry_index", "image_number", "outcome", "stage", "state", "message", "keep_original")


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    done = a.progress_fraction(rows, F.col("entry_index") % 3 != 0).select("archive", F.round("percent", 6).alias("percent"))
    empty = a.archives_without_images(_entries(spark, sf_dir))
    return a.archive_summary(rows).join(done, "archive").withColumn("problem", F.lit(None).cast("string")).unionByName(
        empty.select("archive", *[F.lit(None).cast("bigint").alias(c) for c in ("translated", "failed", "skipped")],
                     F.lit(None).cast("boolean").alias("aborted"), F.lit(None).cast("double").alias("percent"), "problem"))


def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two stages of the archive job: images with their outcome, then archives."""
    metrics = StageMetrics()
    rows = metrics.written(_results(spark, sf_dir), "entries", F.col("outcome") == "failed")
    metrics.written(a.archive_summary(rows), "archives", (F.col("failed") > 0) | F.col("aborted"))
    return metrics.table(spark)


def images_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images not in the skip table, by the stages a skip is looked up at."""
    images = _images(spark, sf_dir)
    skips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("archive"), (F.col("c_nationkey") % 5 + 1).cast("bigint").alias("image_number"))
    return images.join(skips, ["archive", "image_number"], "left_anti").select("archive", "image_number", "name")


def ordered_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = a.ordered_release(_entries(spark, sf_dir), F.col("entry_index") % 17 != 3)
    return released.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.max("entry_index").alias("last_entry"))


def upsert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    current = entries.select("archive", "entry_index", "name", F.concat(F.lit("old "), "entry_index").alias("data"))
    i = F.col("entry_index")
    first = entries.where(i % 6 == 0).select(
        "archive", F.when(i % 18 == 0, F.concat("name", F.lit(".gone"))).otherwise(F.col("name")).alias("name"),
        F.concat(F.lit("new "), "entry_index").alias("data"), F.lit(1).alias("seq"))
    again = entries.where(i % 12 == 0).select("archive", "name", F.concat(F.lit("newer "), "entry_index").alias("data"), F.lit(2).alias("seq"))
    merged, unknown = a.upsert_entries(current, first.unionByName(again))
    return merged.select("archive", "name", "data", "replaced").unionByName(
        unknown.select("archive", "name", F.lit("unknown").alias("data"), F.lit(False).alias("replaced")))


def review_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("archive"), (F.col("o_orderkey") % 8).alias("image_number"))
    targets, bad = a.review_targets(requests, _images(spark, sf_dir))
    return targets.select("archive", "image_number", "name").unionByName(
        bad.select("archive", "image_number", F.lit(None).cast("string").alias("name")))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each part name in natural order inside its brand, and output names."""
    number = (F.col("p_partkey") % 1000).cast("string")
    label = F.when(F.col("p_brand") == "Brand#11", F.concat(F.lit("page "), number)).otherwise(  # one brand of nothing but numbers
        F.concat(F.col("p_name"), F.lit(" "), number, F.lit("-"), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.upper(label).alias("label"))
    return a.natural_positions(rows, ["p_brand"], "label", "p_partkey").select(
        "p_partkey", "position",
        t.output_name(F.concat(F.lit("a.b/"), "label", F.lit(".v1.zip"))).alias("output_name"),
        t.number_key(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), "p_partkey")).otherwise(F.col("label"))).alias("number_key"))


def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    acks = e.where("event_type in ('click', 'purchase', 'error')").select(
        (F.col("user_id") - 3).alias("request_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit(False)).when(F.col("event_type") == "click", F.lit(True)).alias("success"),
        F.when(F.col("user_id") % 3 == 0, "zip").when(F.col("user_id") % 3 == 1, "img").otherwise("").alias("element_type"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("").alias("error"))
    work = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), "c_name")
    return a.latest_acknowledgements(work, acks)


# names as they occur: blanks, other scripts, brackets, escapes, upper case, one name in two folders
_ARCHIVE = """CASE page_id % 8 WHEN 0 THEN 'my set.zip' WHEN 1 THEN '한국.zip' WHEN 2 THEN 'a[2]*.zip' WHEN 3 THEN 'p%41 +&#.zip' WHEN 4 THEN 'UP.ZIP'
    WHEN 5 THEN 'x/vol.zip' WHEN 6 THEN 'y/vol.zip' ELSE 'set7.zip' END"""


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages into archives, list them, read the entries back."""
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    entries = pages.select(
        F.expr(_ARCHIVE).alias("archive"), k.alias("entry_index"),
        F.concat(F.lit("p/"), k.cast("string"), F.when(k % 5 == 0, ".txt").when(k % 5 == 1, "/").when(k % 5 == 2, ".PNG").otherwise(".webp")).alias("name"),
        F.when(k % 5 == 1, F.lit(b"")).otherwise(F.encode("html", "UTF-8")).alias("data"),
        F.lit(b"kept").alias("archive_comment"))
    folder = source.make_folder(spark, scratch_path(spark, "archives"))
    source.write_archives(entries, folder).write.format("noop").mode("overwrite").save()
    listed = materialize(source.scan_archives(spark, folder), "listing")
    content = source.read_entries(listed).select("archive", "entry_index", F.sha2("data", 256).alias("digest"))
    numbers = a.number_images(listed).select("archive", "entry_index", "image_number")
    return listed.join(content, ["archive", "entry_index"]).join(numbers, ["archive", "entry_index"], "left").select(
        F.substring(F.col("archive"), F.lit(len(folder) + 2), F.length("archive")).alias("archive"), "entry_index", "name", "is_dir", "n_bytes", "digest", "image_number",
        F.decode("archive_comment", "UTF-8").alias("archive_comment"))


# ------------------------------------------------------------------ SQL twins

_IMAGES = """
WITH images AS (
  SELECT archive_id AS archive, entry_index, name, skip, error, changed,
    row_number() OVER (PARTITION BY archive_id ORDER BY entry_index) AS image_number
  FROM v_entries WHERE NOT ends_with(name, '/') AND regexp_matches(lower(name), '\\.(png|jpg|jpeg|webp|bmp)$')
)"""

_OUTCOMES = _IMAGES + f""",
results AS (
  SELECT *, CASE WHEN skip THEN 'skipped' WHEN entry_index % 97 = 0 THEN 'cancelled' WHEN error THEN 'failed' WHEN changed THEN 'translated' ELSE 'unchanged' END AS outcome
  FROM images
),
worded AS (
  SELECT archive, entry_index, image_number, outcome,
    CASE outcome WHEN 'skipped' THEN '스킵 완료' WHEN 'failed' THEN '오류' WHEN 'translated' THEN (CASE WHEN entry_index % 8 = 0 THEN '사용자 검수 필요' ELSE '완료' END)
      WHEN 'unchanged' THEN '원본 유지' END AS stage,
    CASE outcome WHEN 'failed' THEN 'error' WHEN 'translated' THEN (CASE WHEN entry_index % 8 = 0 THEN 'review' ELSE 'done' END)
      WHEN 'cancelled' THEN NULL ELSE 'skipped' END AS state,
    CASE outcome WHEN 'skipped' THEN '{a.SKIPPED}' WHEN 'failed' THEN '{a.FAILED}bad ' || (entry_index % 3) WHEN 'unchanged' THEN '{a.UNCHANGED}'
      WHEN 'translated' THEN '번역 문구 ' || (entry_index % 5) || '개 적용 · 원본 확장자 유지' || (CASE WHEN entry_index % 8 = 0 THEN
        ' · 자동 검수 ' || (entry_index % 3 + 1) || '회 미통과 · 선택 후 추가 검수 가능' ELSE '{a.PASSED}' END) END AS message,
    outcome <> 'translated' AS keep_original
  FROM results
)"""

QUERIES = {
    "number_images": number_images,
    "entry_outcomes": entry_outcomes,
    "archive_summary": archive_summary,
    "stage_counters": stage_counters,
    "images_to_run": images_to_run,
    "ordered_release": ordered_release,
    "upsert_entries": upsert_entries,
    "review_targets": review_targets,
    "natural_order": natural_order,
    "acknowledgements": acknowledgements,
    "archive_roundtrip": archive_roundtrip,
}

ORACLES = {
    "number_images": with_views(_IMAGES + " SELECT archive, entry_index, name, image_number FROM images", "v_entries"),
    "entry_outcomes": with_views(_OUTCOMES + " SELECT * FROM worded", "v_entries"),
    "archive_summary": with_views(_OUTCOMES + """
SELECT archive, count(*) FILTER (outcome = 'translated') AS translated, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (outcome = 'skipped') AS skipped, bool_or(outcome = 'cancelled') AS aborted,
  round(count(*) FILTER (entry_index % 3 <> 0) * 100 / count(*), 6) AS percent, NULL::VARCHAR AS problem FROM worded GROUP BY archive
UNION ALL SELECT archive_id, NULL, NULL, NULL, NULL, NULL, 'no_images' FROM v_entries
WHERE archive_id NOT IN (SELECT archive FROM images) GROUP BY archive_id""", "v_entries"),
    "stage_counters": with_views(_OUTCOMES + """
, totals AS (SELECT archive, bool_or(outcome IN ('failed', 'cancelled')) AS bad FROM worded GROUP BY archive)
SELECT 'entries' AS stage, count(*) AS n_rows, count(*) FILTER (outcome = 'failed') AS n_failed FROM worded
UNION ALL SELECT 'archives', count(*), count(*) FILTER (bad) FROM totals""", "v_entries"),
    "images_to_run": with_views(_IMAGES + """
SELECT archive, image_number, name FROM images i WHERE NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = i.archive AND c.c_nationkey % 5 + 1 = i.image_number)""", "v_entries"),
    "ordered_release": with_views("""
SELECT archive, count(*) AS n, max(entry_index) AS last_entry FROM (
  SELECT archive_id AS archive, entry_index, count(*) FILTER (entry_index % 17 = 3) OVER (PARTITION BY archive_id ORDER BY entry_index) AS waiting FROM v_entries) q
WHERE waiting = 0 GROUP BY archive""", "v_entries"),
    "upsert_entries": with_views("""
WITH updates AS (
  SELECT archive_id, CASE WHEN entry_index % 18 = 0 THEN name || '.gone' ELSE name END AS name, 'new ' || entry_index AS data, 1 AS seq FROM v_entries WHERE entry_index % 6 = 0
  UNION ALL SELECT archive_id, name, 'newer ' || entry_index, 2 FROM v_entries WHERE entry_index % 12 = 0
),
latest AS (SELECT archive_id, name, arg_max(data, seq) AS data FROM updates GROUP BY 1, 2)
SELECT e.archive_id AS archive, e.name, coalesce(l.data, 'old ' || e.entry_index) AS data, l.name IS NOT NULL AS replaced
FROM v_entries e LEFT JOIN latest l ON l.archive_id = e.archive_id AND l.name = e.name
UNION ALL SELECT archive_id, name, 'unknown', FALSE FROM latest WHERE (archive_id, name) NOT IN (SELECT archive_id, name FROM v_entries)""", "v_entries"),
    "review_targets": with_views(_IMAGES + """
SELECT r.archive, r.image_number, i.name FROM (SELECT DISTINCT o_custkey AS archive, o_orderkey % 8 AS image_number FROM orders) r
LEFT JOIN images i ON i.archive = r.archive AND i.image_number = r.image_number""", "v_entries"),
    "natural_order": """
WITH l AS (
  SELECT p_partkey, p_brand, upper(CASE WHEN p_brand = 'Brand#11' THEN 'page ' || (p_partkey % 1000) ELSE p_name || ' ' || (p_partkey % 1000) || '-' || p_size END) AS label FROM part
),
k AS (
  SELECT *, list_transform(regexp_extract_all(lower(label), '\\D*\\d*'),
    lambda p: {'text': regexp_extract(p, '^\\D*'), 'number': coalesce(TRY_CAST(regexp_extract(p, '\\d+$') AS BIGINT), -1)}) AS key FROM l
)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY key, p_partkey) AS position, 'a.b/' || label || '.v1_ko.zip' AS output_name,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 1000000000 END AS number_key FROM k""",
    "acknowledgements": """
WITH acks AS (
  SELECT user_id - 3 AS request_id, event_id AS seq, CASE event_type WHEN 'error' THEN FALSE WHEN 'click' THEN TRUE END AS success,
    CASE user_id % 3 WHEN 0 THEN 'zip' WHEN 1 THEN 'img' ELSE '' END AS el, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS error
  FROM events WHERE event_type IN ('click', 'purchase', 'error') AND user_id > 3
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) AS rn FROM acks)
SELECT c_custkey AS request_id, c_name, success, CASE WHEN seq IS NULL THEN NULL WHEN NOT coalesce(success, TRUE) THEN
    (CASE el WHEN 'zip' THEN 'ZIP 이미지 저장' ELSE '페이지 이미지 교체' END) || ' 실패 · ' || left(coalesce(nullif(error, ''), '원인 미상'), 500)
  ELSE (CASE el WHEN 'zip' THEN 'ZIP 이미지 저장 확인' ELSE '페이지 이미지 교체 확인' END) || ' · ' || (CASE el WHEN '' THEN '이미지' ELSE '<' || el || '>' END) END AS message
FROM customer LEFT JOIN ranked ON request_id = c_custkey AND rn = 1""",
    "archive_roundtrip": f"""
WITH e AS (
  SELECT {_ARCHIVE} AS archive, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) - 1 AS entry_index,
    'p/' || page_id || (CASE page_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '/' WHEN 2 THEN '.PNG' ELSE '.webp' END) AS name,
    page_id % 5 = 1 AS is_dir, CASE WHEN page_id % 5 = 1 THEN '' ELSE html END AS html, page_id % 5 > 1 AS image
  FROM pages
)
SELECT archive, entry_index, name, is_dir, octet_length(encode(html)) AS n_bytes, sha256(html) AS digest,
  CASE WHEN image THEN count(*) FILTER (image) OVER (PARTITION BY archive ORDER BY entry_index) END AS image_number, 'kept' AS archive_comment
FROM e""",
}
