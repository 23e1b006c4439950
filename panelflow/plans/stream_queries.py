"""Registered queries that run the streaming jobs over everything available."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.plans.derived import table, view_text, with_views
from panelflow.plans.status_queries import ORACLES as STATUS, parsed_log, write_log
from panelflow.session import scratch_path
from panelflow.sources.log_files import stream_log
from panelflow.streaming import passes, progress as s

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table of few large row groups is dealt out before its lines are taken apart; only the test for well-formed lines is pushed below
    events = _stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").repartition(
        spark.sparkContext.defaultParallelism, "event_id")
    text = view_text("v_log_lines").replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events).select("seq", F.col("ts").cast("timestamp").alias("ingested"), "line")


def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status table kept by the stream; equals the batch job's."""
    return s.run_live_status(s.progress_stream(_lines(spark, sf_dir)))


def attributed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its task's source, kept as keyed state; equals the batch job's."""
    told = _run(s.attributed_stream(s.progress_stream(_lines(spark, sf_dir))), "attributed")
    return told.where("not timed_out").select("seq", "task_number", "source", "source_label", "row_key", "name")


def stream_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's files as a stream of lines; equals the batch scan."""
    return _run(parsed_log(stream_log(spark, write_log(spark, sf_dir))), "lines")


@contextmanager
def _state_partitions(spark: SparkSession):
    """State partitions are fixed when a stream first starts: no more than cores for a one-off run."""
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    if before.isdigit() and int(before) > cores:
        spark.conf.set(name, str(cores))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(frame: DataFrame, label: str) -> DataFrame:
    """Everything available, appended to a fresh table."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    with _state_partitions(spark):
        frame.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", scratch_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


# what the events say as lines of passes; times are those of the events, forty times as fast
_LABELS = ("정밀 판독·초벌 번역 1/3", "Codex 이미지 렌더 2회차", "누락·좌표·번역 통합 검수 2/3")
_BASE, _FASTER, _PARTS = 1704067200, 40, 3


def _pass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(_BASE) + F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - _BASE) / _FASTER)
    label = F.element_at(F.array(*[F.lit(n) for n in _LABELS]), (F.col("event_id") % 3 + 1).cast("int"))
    kind, k = F.col("event_type"), F.col("event_id")
    detail = (
        F.when(kind == "signup", "요청 수신 · 1.24 MB · <zip> · zip")
        .when(kind == "view", F.concat(label, F.when(k % 2 == 0, " 시작 · 첨부 자료 5개").otherwise(" 시작")))
        .when((kind == "click") & (k % 4 == 0), "렌더 모드 · Codex 대사 작업 시트 렌더")
        .when(kind == "click", F.concat(label, F.lit(" 진행 중 · 999분 0초 경과")))
        .when(kind == "purchase", F.concat(label, F.when(k % 3 == 0, " 실패 · 이전 단계 결과로 계속 · x").otherwise(" 완료 · 후보 3개 · 12초")))
        .when(k % 5 == 0, "오류 · timeout").otherwise("좌표 기준본 준비 완료"))
    ingested = F.timestamp_seconds("at")
    # a table of few large row groups is dealt out, so that its lines are written and read by all cores
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").repartition(
        spark.sparkContext.defaultParallelism, "event_id")
    return events.withColumn("at", at).select(k.alias("seq"), ingested.alias("ingested"), F.concat(
        F.date_format(ingested, "'['HH:mm:ss'] [작업 #'"), "user_id", F.lit(" · 이미지 #"), k % 2 + 1, F.lit("] "), detail).alias("line"))


def timed_out_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and requests beyond their limits. The log comes in parts; the stream stops after each and goes on with the next."""
    lines = _pass_lines(spark, sf_dir)
    source, out, state = (scratch_path(spark, n) for n in ("pass-lines", "timed-out", "timed-out-checkpoint"))
    span = lines.agg(F.min("ingested").alias("a"), F.max("ingested").alias("b")).first()
    cuts = [span.a + (span.b - span.a) * k / _PARTS for k in range(1, _PARTS)] if span.a else []
    for k in range(len(cuts) + 1):
        part = lines.where(F.lit(True) if k == 0 else F.col("ingested") >= cuts[k - 1]).where(F.lit(True) if k == len(cuts) else F.col("ingested") < cuts[k])
        part.write.parquet(f"{source}/p{k}")
        stream = spark.readStream.schema(lines.schema).parquet(f"{source}/*")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
        with _state_partitions(spark):
            passes.timed_out_stream(s.progress_stream(stream)).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(passes.TIMED_OUT).parquet(out)


def released_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archive entries that become ready in file order; every 19th of an archive never does."""
    orders = _stream(spark, sf_dir, "orders")
    ready = orders.select(
        (F.col("o_orderkey") % 50).alias("archive"), F.floor(F.col("o_orderkey") / 50).cast("bigint").alias("entry_index"),
        F.concat(F.lit("p"), "o_orderkey").alias("name")).where("not (archive % 5 = 2 and entry_index = 19)")
    return _run(s.ordered_release_stream(ready), "released")


def _acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as requests joined to the purchases and errors of the same user within three hours."""
    events = _stream(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    requests = events.where("event_type = 'signup'").select((F.col("user_id") + 1).alias("request_id"), at.alias("requested_at"))
    acks = _stream(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").select(
        (F.col("user_id") + 1).alias("request_id"), at.alias("acked_at"), (F.col("event_type") == "purchase").alias("success"),
        F.when(F.col("user_id") % 2 == 0, "zip").otherwise("img").alias("element_type"), F.lit("lost").alias("error"))
    return _run(s.acknowledged_stream(requests, acks), "acknowledged")


def acknowledged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an answer, and how many they got."""
    return _acknowledged(spark, sf_dir).where("acked_at is not null").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.min("message").alias("message"))


def unanswered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that got no answer in time, as far as the watermark of both streams has come."""
    kind = F.col("event_type")
    last = table(spark, sf_dir, "events").agg(F.least(
        F.max(F.when(kind == "signup", F.col("ts"))), F.max(F.when(kind.isin("purchase", "error"), F.col("ts"))))).first()[0]
    settled = F.lit(last).cast("timestamp") - F.expr("interval 191 minutes")
    return _acknowledged(spark, sf_dir).where("acked_at is null").where(F.col("requested_at") < settled).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.unix_seconds(F.max("requested_at")).alias("last_asked"))


QUERIES = {
    "live_status": live_status,
    "attributed_lines": attributed_lines,
    "stream_log_files": stream_log_files,
    "timed_out_passes": timed_out_passes,
    "released_entries": released_entries,
    "acknowledged_requests": acknowledged_requests,
    "unanswered_requests": unanswered_requests,
}

ORACLES = {
    "live_status": STATUS["latest_status"],
    "attributed_lines": STATUS["attributed_sources"],
    "stream_log_files": STATUS["parse_log_lines"],
    "timed_out_passes": f"""
WITH l AS (
  SELECT user_id AS task_number, event_id % 2 + 1 AS image_number, event_id AS seq, {_BASE} + (floor(epoch(ts))::BIGINT - {_BASE}) // {_FASTER} AS sec,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'click' THEN (CASE WHEN event_id % 4 = 0 THEN 'model' ELSE 'alive' END)
      WHEN 'purchase' THEN 'end' ELSE (CASE WHEN event_id % 5 = 0 THEN 'close' ELSE 'end' END) END AS kind,
    CASE WHEN event_type = 'signup' OR (event_type = 'click' AND event_id % 4 = 0) THEN '요청' WHEN event_type = 'error' THEN '좌표 기준본 준비'
      ELSE {list(_LABELS)}[event_id % 3 + 1] END AS label
  FROM events
),
s AS (
  SELECT a.*, min(CASE WHEN b.kind = 'close' OR (b.label = a.label AND b.kind IN ('start', 'end')) THEN row(b.sec, b.seq) END) AS stop
  FROM l a LEFT JOIN l b ON a.task_number = b.task_number AND a.image_number = b.image_number AND row(b.sec, b.seq) > row(a.sec, a.seq)
  WHERE a.kind = 'start' GROUP BY ALL
),
m AS (
  SELECT *, CASE WHEN label = {list(_LABELS)}[2] THEN 900 WHEN label <> '요청' THEN 300 WHEN model THEN 10800 ELSE 3600 END AS limit_seconds
  FROM (SELECT s.*, bool_or(b.kind = 'model' AND b.sec <= s.sec + 3600) AS model FROM s LEFT JOIN l b ON s.task_number = b.task_number AND s.image_number = b.image_number AND row(b.sec, b.seq) > row(s.sec, s.seq)
    AND (s.stop IS NULL OR row(b.sec, b.seq) < s.stop) GROUP BY ALL) t
),
seen AS (
  SELECT m.*, max(b.sec) FILTER (b.sec <= m.sec + limit_seconds) AS alive, bool_or(b.kind = 'alive' AND b.sec > m.sec + limit_seconds) AS late
  FROM m LEFT JOIN l b ON m.task_number = b.task_number AND m.image_number = b.image_number AND b.label = m.label AND b.kind IN ('alive', 'model')
    AND row(b.sec, b.seq) > row(m.sec, m.seq) AND (m.stop IS NULL OR row(b.sec, b.seq) < m.stop) GROUP BY ALL
)
SELECT task_number, image_number, label, sec AS started_at, limit_seconds::BIGINT AS limit_seconds, coalesce(alive, sec) AS last_seen FROM seen
WHERE coalesce(late, FALSE) OR CASE WHEN stop IS NULL THEN sec + limit_seconds <= (SELECT max(sec) - 600 FROM l) ELSE stop[1] > sec + limit_seconds END""",
    "released_entries": with_views("""
WITH e AS (
  SELECT o_orderkey % 50 AS archive, o_orderkey // 50 AS entry_index, 'p' || o_orderkey AS name FROM orders
)
SELECT archive, entry_index, name FROM e WHERE NOT (archive % 5 = 2 AND entry_index >= 19)"""),
    "acknowledged_requests": """
SELECT s.user_id + 1 AS request_id, count(*) AS n, count(*) FILTER (a.event_type = 'purchase') AS n_success,
  min(CASE WHEN a.event_type = 'purchase' THEN (CASE WHEN s.user_id % 2 = 0 THEN 'ZIP 이미지 저장 확인 · <zip>' ELSE '페이지 이미지 교체 확인 · <img>' END)
    ELSE (CASE WHEN s.user_id % 2 = 0 THEN 'ZIP 이미지 저장' ELSE '페이지 이미지 교체' END) || ' 실패 · lost' END) AS message
FROM events s JOIN events a ON a.user_id = s.user_id AND a.event_type IN ('purchase', 'error') AND a.ts BETWEEN s.ts AND s.ts + INTERVAL 3 HOUR
WHERE s.event_type = 'signup' GROUP BY s.user_id""",
    "unanswered_requests": """
SELECT s.user_id + 1 AS request_id, count(*) AS n, max(floor(epoch(s.ts))::BIGINT) AS last_asked
FROM events s ANTI JOIN (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) a ON a.user_id = s.user_id AND a.ts BETWEEN s.ts AND s.ts + INTERVAL 3 HOUR
WHERE s.event_type = 'signup' AND s.ts < least((SELECT max(ts) FROM events WHERE event_type = 'signup'),
  (SELECT max(ts) FROM events WHERE event_type IN ('purchase', 'error'))) - INTERVAL 191 MINUTE GROUP BY s.user_id""",
}
