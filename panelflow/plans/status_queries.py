"""Registered queries of the progress-log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import progress as p
from panelflow.operators import status as s
from panelflow.plans.derived import table, view, with_views
from panelflow.session import scratch_path
from panelflow.sources.log_files import scan_log


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.attribute_source(s.parse_progress(view(spark, sf_dir, "v_log_lines", heavy=True).select("seq", "line")))


def parse_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.parse_progress(view(spark, sf_dir, "v_log_lines", heavy=True).select("seq", "line"))


def write_log(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as a folder of text files; the number of each stands before its line."""
    path = scratch_path(spark, "log")
    view(spark, sf_dir, "v_log_lines", heavy=True).select(F.concat(F.col("seq").cast("string"), F.lit("\t"), "line").alias("value")).write.text(path)
    return path


def parsed_log(lines: DataFrame) -> DataFrame:
    """Lines as :func:`write_log` writes them, parsed."""
    parts = F.split("line", "\t", 2)
    return s.parse_progress(lines.select(F.get(parts, F.lit(0)).cast("bigint").alias("seq"), F.get(parts, F.lit(1)).alias("line")))


def scan_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress log read from its files by byte ranges."""
    return parsed_log(scan_log(spark, write_log(spark, sf_dir)))


def attributed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("seq", "task_number", "source", "source_label", "row_key", "name")


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.latest_status(_attributed(spark, sf_dir))


_SKIPS = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'zip:' ELSE 'web:' END || cast(c_custkey AS varchar(20)) AS row_key
FROM customer WHERE c_custkey % 3 = 0"""


def latest_status_with_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    skips = spark.sql(_SKIPS.replace("customer", "{customer}"), customer=table(spark, sf_dir, "customer"))
    return s.latest_status(_attributed(spark, sf_dir), skips)


def status_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source can still be skipped or sent to a manual review."""
    rows = s.latest_status(_attributed(spark, sf_dir))
    queued = F.col("image_number") % 4 == 0
    yes = F.lit(True)
    return rows.groupBy("source").agg(
        F.count_if(s.skippable(F.col("state"))).alias("skippable"),
        F.count_if(s.reviewable(F.col("source"), F.col("state"), queued, yes, yes, yes)).alias("reviewable"),
        F.count(F.lit(1)).alias("n_rows"),
    )


_SLOT_EVENTS = """
SELECT user_id % 4 AS server, event_id * 2 AS seq, 'acquire' AS kind FROM events
UNION ALL
SELECT user_id % 4 AS server, (event_id + 30) * 2 + 1 AS seq, 'release' AS kind FROM events"""


def slot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    slots = spark.sql(_SLOT_EVENTS.replace("FROM events", "FROM {events}"), events=events)
    return s.slot_usage(slots, maximum=6).groupBy("server").agg(
        F.max("running").alias("peak_running"), F.max("waiting").alias("peak_waiting"),
        F.sum("waiting").alias("total_waiting"), F.count_if(F.col("waiting") > 0).alias("n_queued"),
    )


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(
        F.col("user_id").alias("task_number"),
        F.concat(F.lit("pass "), (F.col("event_id") % 3).cast("string")).alias("label"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "start").otherwise("complete").alias("phase"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
    )


def pass_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.pass_durations(_passes(spark, sf_dir)).select("task_number", "label", "start_seq", "seq", "elapsed")


def overdue_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes beyond two days, at the end of the table's month."""
    now = F.unix_seconds(F.lit("2024-01-31").cast("timestamp"))
    rows = s.overdue_passes(_passes(spark, sf_dir), 2 * 86400, now)
    return rows.select("task_number", "label", "start_seq", F.col("ended").isNull().alias("running"))


def _rules_sql() -> str:
    rows = ",\n".join(
        f"({i}, '{m}', '{stage}', '{state}', {str(terminal).upper()})"
        for i, (m, stage, state, terminal) in enumerate(p.RULES)
    )
    return f"rules(priority, marker, stage, state, terminal) AS (VALUES\n{rows})"


# The clean-room counterpart in SQL: a rule join and plain windows instead of the
# folded expression and the blocked forward fill.
_PARSED = f"""
WITH {_rules_sql()},
raw AS (
  SELECT seq, regexp_extract(trim(line), '^\\[(\\d{{2}}:\\d{{2}}:\\d{{2}})\\] \\[작업 #(\\d+) · 이미지 #(\\d+)\\] (.+)$',
    ['time', 'task', 'image', 'message']) AS m
  FROM v_log_lines
  WHERE regexp_matches(trim(line), '^\\[(\\d{{2}}:\\d{{2}}:\\d{{2}})\\] \\[작업 #(\\d+) · 이미지 #(\\d+)\\] (.+)$')
),
fitting AS (SELECT * FROM raw WHERE TRY_CAST(m.task AS BIGINT) IS NOT NULL AND TRY_CAST(m.image AS BIGINT) IS NOT NULL),
flat AS (
  SELECT seq, m.time AS time, CAST(m.task AS BIGINT) AS task_number, CAST(m.image AS BIGINT) AS image_number,
    m.message AS detail, regexp_extract(m.message, '<([a-zA-Z0-9_-]+)>', 1) AS tag
  FROM fitting
),
ruled AS (
  SELECT f.seq, arg_min(r.stage, r.priority) AS stage, arg_min(r.state, r.priority) AS state,
    arg_min(r.terminal, r.priority) AS terminal
  FROM flat f JOIN rules r ON contains(f.detail, r.marker) GROUP BY f.seq
),
parsed AS (
  SELECT f.seq, f.time, f.task_number, f.image_number, f.detail,
    coalesce(r.stage, '처리 중') AS stage, coalesce(r.state, 'running') AS state, coalesce(r.terminal, FALSE) AS terminal,
    CASE WHEN tag = 'zip' THEN 'zip' WHEN tag <> '' THEN 'web' WHEN contains(detail, 'ZIP 이미지') THEN 'zip'
      WHEN contains(detail, '페이지 이미지') THEN 'web' END AS source,
    CASE WHEN tag = 'zip' THEN 'ZIP' WHEN tag <> '' THEN '웹 <' || tag || '>' WHEN contains(detail, 'ZIP 이미지') THEN 'ZIP'
      WHEN contains(detail, '페이지 이미지') THEN '웹' END AS source_label
  FROM flat f LEFT JOIN ruled r USING (seq)
)"""

_FILLED = _PARSED + """,
filled AS (
  SELECT * REPLACE (
    last_value(source IGNORE NULLS) OVER w AS source, last_value(source_label IGNORE NULLS) OVER w AS source_label)
  FROM parsed
  WINDOW w AS (PARTITION BY task_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
attributed AS (
  SELECT *, CASE WHEN source = 'zip' THEN 'zip:' || image_number
      ELSE 'web:' || (CASE WHEN task_number > 0 THEN task_number ELSE image_number END) END AS row_key,
    CASE WHEN source = 'web' THEN coalesce(nullif(regexp_extract(detail, '<[a-zA-Z0-9_-]+> · ([^?]+)$', 1), ''),
      '웹 이미지 #' || image_number) ELSE '' END AS name
  FROM filled WHERE source IS NOT NULL
)"""

_LATEST = _FILLED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY seq DESC) AS rn FROM attributed),
names AS (SELECT row_key, arg_max(name, seq) AS kept FROM attributed WHERE name <> '' GROUP BY row_key),
latest AS (
  SELECT r.row_key, source, source_label, task_number, image_number, stage, detail, state, terminal, time, seq,
    coalesce(kept, '') AS name
  FROM ranked r LEFT JOIN names USING (row_key) WHERE rn = 1
)"""

_PASSES = """
WITH e AS (
  SELECT user_id AS task_number, 'pass ' || (event_id % 3) AS label, event_id AS seq, event_type,
    CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events WHERE event_type IN ('view', 'click')),
n AS (SELECT *, lead(event_type) OVER w AS next_type, lead(seq) OVER w AS next_seq, lead(at_s) OVER w AS next_at
  FROM e WINDOW w AS (PARTITION BY task_number, label ORDER BY seq))
"""

QUERIES = {
    "parse_log_lines": parse_log_lines,
    "scan_log_files": scan_log_files,
    "attributed_sources": attributed_sources,
    "latest_status": latest_status,
    "latest_status_with_skips": latest_status_with_skips,
    "status_actions": status_actions,
    "slot_usage": slot_usage,
    "pass_durations": pass_durations,
    "overdue_passes": overdue_passes,
}

ORACLES = {
    "parse_log_lines": with_views(
        _PARSED + " SELECT seq, time, task_number, image_number, detail, stage, state, terminal, source, source_label FROM parsed",
        "v_log_lines"),
    "attributed_sources": with_views(
        _FILLED + " SELECT seq, task_number, source, source_label, row_key, name FROM attributed", "v_log_lines"),
    "latest_status": with_views(_LATEST + " SELECT * FROM latest", "v_log_lines"),
    "latest_status_with_skips": with_views(
        _LATEST + f""",
skips AS ({_SKIPS}),
held AS (SELECT l.*, s.row_key IS NOT NULL AND state NOT IN ('done', 'error', 'skipped') AS h
  FROM latest l LEFT JOIN skips s USING (row_key))
SELECT * EXCLUDE (h) REPLACE (
  CASE WHEN h THEN '{p.SKIP_STAGE}' ELSE stage END AS stage,
  CASE WHEN h THEN '{p.SKIP_DETAIL}' ELSE detail END AS detail,
  CASE WHEN h THEN 'skipped' ELSE state END AS state) FROM held""", "v_log_lines"),
    "status_actions": with_views(
        _LATEST + """
SELECT source, count(*) FILTER (state NOT IN ('done', 'error', 'skipped')) AS skippable,
  count(*) FILTER (source = 'zip' AND state = 'review' AND image_number % 4 <> 0) AS reviewable, count(*) AS n_rows
FROM latest GROUP BY source""", "v_log_lines"),
    "slot_usage": f"""
WITH slots AS ({_SLOT_EVENTS}),
run AS (SELECT server, sum(CASE kind WHEN 'acquire' THEN 1 ELSE -1 END) OVER (PARTITION BY server ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS demand FROM slots)
SELECT server, CAST(max(least(demand, 6)) AS BIGINT) AS peak_running,
  CAST(max(demand - least(demand, 6)) AS BIGINT) AS peak_waiting,
  CAST(sum(demand - least(demand, 6)) AS BIGINT) AS total_waiting, count(*) FILTER (demand > 6) AS n_queued
FROM run GROUP BY server""",
    "pass_durations": _PASSES + """
SELECT task_number, label, seq AS start_seq, next_seq AS seq, next_at - at_s AS elapsed
FROM n WHERE event_type = 'view' AND next_type = 'click'""",
    "overdue_passes": _PASSES + """
SELECT task_number, label, seq AS start_seq, next_type IS DISTINCT FROM 'click' AS running FROM n
WHERE event_type = 'view' AND coalesce(CASE WHEN next_type = 'click' THEN next_at END, epoch(TIMESTAMP '2024-01-31')::BIGINT) - at_s > 172800""",
}
ORACLES["scan_log_files"] = ORACLES["parse_log_lines"]
