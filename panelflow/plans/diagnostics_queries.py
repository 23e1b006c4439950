"""Registered queries of the run diagnostics job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import messages as m
from panelflow.operators import diagnostics as d
from panelflow.plans.derived import stored_view, view, with_views

ROOT = "C:/gen"


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_view(spark, sf_dir, "v_run_lines")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events of the plain event view, counted by type."""
    events = d.scan_run_events(view(spark, sf_dir, "v_run_events"))
    return events.groupBy("run_id", F.try_variant_get("event", "$.type", "string").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.event_details(d.scan_run_events(run_lines(spark, sf_dir))).select(
        "run_id", "seq", F.col("part").cast("bigint").alias("part"), "detail")


def diagnostic_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.diagnostic_details(run_lines(spark, sf_dir), view(spark, sf_dir, "v_runs"))


def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, runs = run_lines(spark, sf_dir), view(spark, sf_dir, "v_runs")
    resolved = d.resolve_results(lines, view(spark, sf_dir, "v_files"), runs, ROOT).select(
        "run_id", F.col("path").isNotNull().alias("resolved"))
    told = d.failure_class(lines, runs.join(resolved, "run_id", "left"))
    return told.select("run_id", "code", "headline", m.error_view(F.coalesce("headline", F.lit("-")), F.col("details")).alias("view"))


def generated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.generated_paths(run_lines(spark, sf_dir)).select(
        "run_id", "path", F.col("source").cast("bigint").alias("source"), "seq", F.col("hit").cast("bigint").alias("hit"))


def thread_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.thread_ids(run_lines(spark, sf_dir)).select("run_id", "thread_id", "seq")


def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.latest_generated_file(view(spark, sf_dir, "v_files"), ROOT)


def resolve_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.resolve_results(run_lines(spark, sf_dir), view(spark, sf_dir, "v_files"), view(spark, sf_dir, "v_runs"), ROOT)


# ------------------------------------------------------------------ SQL twins

_FLAT = "left(trim(regexp_replace({}, '\\s+', ' ', 'g')), 1200)"
_EVENTS = """
WITH parsed AS (
  SELECT run_id, seq, stream, trim(line)::JSON AS e FROM v_run_lines
  WHERE (starts_with(trim(line), '{') OR starts_with(trim(line), '[')) AND json_valid(trim(line))
),
facts AS (
  SELECT run_id, seq, stream, e, e->>'$.type' AS type, e->>'$.item.type' AS item_type, e->>'$.item.exit_code' AS code FROM parsed
),
parts AS (
  SELECT run_id, seq, stream, 0 AS part, '모델 메시지: ' || (e->>'$.item.text') AS detail FROM facts WHERE item_type = 'agent_message'
  UNION ALL SELECT run_id, seq, stream, 1, '도구 종료 코드: ' || code FROM facts WHERE item_type = 'command_execution' AND code <> '0'
  UNION ALL SELECT run_id, seq, stream, 2, '도구 출력: ' || (e->>'$.item.aggregated_output') FROM facts WHERE item_type = 'command_execution' AND code <> '0'
  UNION ALL SELECT run_id, seq, stream, p, 'Codex 이벤트 오류: ' || CASE json_type(e, path) WHEN 'VARCHAR' THEN json_extract_string(e, path)
      WHEN 'OBJECT' THEN coalesce(json_extract_string(e, path || '.message'), json_extract_string(e, path || '.detail'), json_extract_string(e, path || '.error')) END
    FROM facts, (VALUES (3, '$.message'), (4, '$.error'), (5, '$.detail'), (6, '$.item.error'), (7, '$.item.message')) v(p, path)
    WHERE regexp_matches(type, '(?i)error|failed')
),
details AS (SELECT run_id, seq, stream, part, detail FROM parts WHERE detail IS NOT NULL)"""

_DIAGNOSED = _EVENTS + """,
kept AS (
  SELECT *, """ + _FLAT.format("line") + """ AS flat, row_number() OVER (PARTITION BY run_id, stream ORDER BY seq DESC) AS back
  FROM v_run_lines WHERE trim(line) <> ''
),
told AS (
  SELECT run_id, 1 AS layer, seq, part, """ + _FLAT.format("detail") + """ AS detail FROM details WHERE stream = 'stdout'
  UNION ALL SELECT run_id, 2, seq, 0, 'stderr: ' || flat FROM kept WHERE stream = 'stderr' AND back <= 6
),
every AS (
  SELECT * FROM told
  UNION ALL SELECT run_id, 0, 0, 0, '실패 단계: ' || stage FROM v_runs WHERE stage <> ''
  UNION ALL SELECT run_id, 3, seq, 0, 'stdout: ' || flat FROM kept
    WHERE stream = 'stdout' AND back <= 4 AND run_id NOT IN (SELECT run_id FROM told)
),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, detail ORDER BY layer, seq, part) AS again FROM every
),
diagnosed AS (
  SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY layer, seq, part) AS position, detail
    FROM firsts WHERE again = 1) q WHERE position <= 12
)"""

_PATH_RE = "(?i)[A-Za-z]:[\\\\/][^\\r\\n`\"<>|]+?\\.(?:png|jpe?g|webp)"
_PATHS = f"""
texts AS (
  SELECT run_id, 0 AS source, seq, 0 AS at_pos, line AS txt FROM v_run_lines
  UNION ALL
  SELECT run_id, 1, seq, t.id, t.atom->>'$'
  FROM (SELECT run_id, seq, trim(line)::JSON AS e FROM v_run_lines
    WHERE (starts_with(trim(line), '{{') OR starts_with(trim(line), '[')) AND json_valid(trim(line))) p, json_tree(p.e) t
  WHERE t.type = 'VARCHAR'
),
hits AS (
  SELECT run_id, source, seq, at_pos, unnest(h) AS path, generate_subscripts(h, 1) - 1 AS hit
  FROM (SELECT *, regexp_extract_all(replace(txt, chr(92) || chr(92), chr(92)), '{_PATH_RE}') AS h FROM texts) q
),
paths AS (
  SELECT run_id, path, source, seq, at_pos, hit FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, lower(path) ORDER BY source, seq, at_pos, hit) AS rn FROM hits) q WHERE rn = 1
)"""

_THREADS = """
ids AS (
  SELECT run_id, seq, t.id AS at_pos, t.atom->>'$' AS thread_id
  FROM (SELECT run_id, seq, trim(line)::JSON AS e FROM v_run_lines
    WHERE (starts_with(trim(line), '{') OR starts_with(trim(line), '[')) AND json_valid(trim(line))) p, json_tree(p.e) t
  WHERE t.key IN ('thread_id', 'threadId') AND regexp_full_match(t.atom->>'$', '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')
),
threads AS (
  SELECT run_id, thread_id, seq, at_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, lower(thread_id) ORDER BY seq, at_pos) AS rn FROM ids) q WHERE rn = 1
)"""

_RESOLVED = f"""
WITH {_PATHS}, {_THREADS},
newest AS (
  SELECT lower(split_part(path, chr(92), 3)) AS thread_key, path, modified_at FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(split_part(path, chr(92), 3)) ORDER BY modified_at DESC, path DESC) AS rn FROM v_files) q
  WHERE rn = 1
),
direct AS (
  SELECT p.run_id, f.path, row_number() OVER (PARTITION BY p.run_id ORDER BY source DESC, seq DESC, at_pos DESC, hit DESC) AS rn
  FROM paths p JOIN (SELECT DISTINCT path FROM v_files) f ON lower(replace(p.path, '/', chr(92))) = lower(f.path)
),
by_thread AS (
  SELECT t.run_id, n.path, row_number() OVER (PARTITION BY t.run_id ORDER BY seq DESC, at_pos DESC) AS rn
  FROM threads t JOIN newest n ON lower(t.thread_id) = n.thread_key
),
resolved AS (
  SELECT r.run_id, coalesce(d.path, b.path) AS path, CASE WHEN coalesce(d.path, b.path) IS NOT NULL THEN NULL
    WHEN r.run_id IN (SELECT run_id FROM paths) THEN 'outside_root' ELSE 'no_result' END AS problem
  FROM v_runs r LEFT JOIN direct d ON d.run_id = r.run_id AND d.rn = 1 LEFT JOIN by_thread b ON b.run_id = r.run_id AND b.rn = 1
)"""

_FAILURE = _DIAGNOSED + "," + _RESOLVED.strip()[5:] + f""",
listed AS (SELECT run_id, list(detail ORDER BY position) AS details FROM diagnosed GROUP BY run_id),
signs AS (
  SELECT run_id, bool_or(contains(line, 'prompt_cache_retention is not supported on this model')) AS incompatible,
    regexp_matches({_FLAT.format("string_agg(line, ' ' ORDER BY seq) FILTER (stream = 'stdout' AND trim(line) <> '')")}, '(?i)safety filter.{{0,160}}block') AS refused
  FROM v_run_lines GROUP BY run_id
),
coded AS (
  SELECT r.run_id, exit_code, CASE WHEN spawn_error <> '' THEN list_append(coalesce(details, []), '프로세스 오류: ' || spawn_error) ELSE coalesce(details, []) END AS details,
    CASE WHEN cancelled THEN 'TRANSLATION_CANCELLED' WHEN timed_out THEN 'CODEX_TIMEOUT'
      WHEN exit_code <> 0 AND incompatible THEN 'CODEX_MODEL_COMPATIBILITY' WHEN exit_code <> 0 THEN 'CODEX_EXEC_FAILED'
      WHEN d.path IS NOT NULL THEN NULL WHEN refused THEN 'CODEX_IMAGE_SAFETY_BLOCKED' ELSE 'CODEX_IMAGE_RESULT_FAILED' END AS code
  FROM v_runs r LEFT JOIN listed USING (run_id) LEFT JOIN signs USING (run_id) LEFT JOIN resolved d USING (run_id)
),
worded AS (
  SELECT run_id, code, details, CASE code WHEN 'CODEX_MODEL_COMPATIBILITY' THEN '{m.COMPATIBILITY_HEADLINE}'
    WHEN 'CODEX_IMAGE_SAFETY_BLOCKED' THEN '{m.SAFETY_HEADLINE}'
    WHEN 'CODEX_EXEC_FAILED' THEN 'Codex 종료 코드 ' || exit_code || ' · ' || regexp_replace(coalesce(
      list_filter(details, lambda x: NOT starts_with(x, '실패 단계:') AND NOT regexp_matches(x, '(?i)models cache|shell snapshot'))[1],
      '{m.NO_REASON}'), '^([^:]+):\\s*', '') END AS headline
  FROM coded
)
SELECT run_id, code, headline, array_to_string(list_prepend(coalesce(headline, '-'),
  list_transform((CASE WHEN code = 'CODEX_MODEL_COMPATIBILITY' THEN list_append(details, '{m.ADVICE}') ELSE details END)[1:12], lambda x: '• ' || x)), chr(10)) AS view
FROM worded"""

QUERIES = {
    "run_events": run_events,
    "event_details": event_details,
    "diagnostic_details": diagnostic_details,
    "failure_class": failure_class,
    "generated_paths": generated_paths,
    "thread_ids": thread_ids,
    "latest_files": latest_files,
    "resolve_results": resolve_results,
}

ORACLES = {
    "run_events": with_views("""
SELECT run_id, line::JSON->>'$.type' AS type, count(*) AS n, min(seq) AS first_seq FROM v_run_events
WHERE (starts_with(line, '{') OR starts_with(line, '[')) AND json_valid(line) GROUP BY 1, 2""", "v_run_events"),
    "event_details": with_views(
        _EVENTS + f" SELECT run_id, seq, part::BIGINT AS part, {_FLAT.format('detail')} AS detail FROM details", "v_run_lines"),
    "diagnostic_details": with_views(_DIAGNOSED + " SELECT run_id, position, detail FROM diagnosed", "v_run_lines", "v_runs"),
    "failure_class": with_views(_FAILURE, "v_run_lines", "v_runs", "v_files"),
    "generated_paths": with_views(f"WITH {_PATHS} SELECT run_id, path, source::BIGINT AS source, seq, hit FROM paths", "v_run_lines"),
    "thread_ids": with_views(f"WITH {_THREADS} SELECT run_id, thread_id, seq FROM threads", "v_run_lines"),
    "latest_files": with_views("""
SELECT lower(split_part(path, chr(92), 3)) AS thread_key, path, modified_at FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(split_part(path, chr(92), 3)) ORDER BY modified_at DESC, path DESC) AS rn FROM v_files) q
WHERE rn = 1""", "v_files"),
    "resolve_results": with_views(_RESOLVED + " SELECT run_id, path, problem FROM resolved", "v_run_lines", "v_runs", "v_files"),
}
