"""Progress log: batch rules, blocked windows, and the same through streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelflow.operators import status as s
from panelflow.operators.ordered import block_of, forward_fill, numbered, running_sum
from panelflow.plans import stream_queries
from panelflow.streaming import progress as sp

LINES = [
    "[14:03:21] [작업 #7 · 이미지 #2] 요청 수신 · 1.24 MB · <img> · example.com/a.png?x=1",
    "[14:03:22] [작업 #7 · 이미지 #2] 대기열 진입 · 앞선 대기 작업 1개",
    "[14:03:23] [작업 #8 · 이미지 #1] 병렬 처리 시작 · 실행 중 1/6",
    "plain text",
    "[14:03:24] [작업 #8 · 이미지 #?] 원본 준비 완료",
    "[14:03:25] [작업 #8 · 이미지 #1] ZIP 이미지 저장 확인 · <zip>",
    "[14:03:26] [작업 #7 · 이미지 #2] 자동 검수 3회 미통과 · 사용자 검수 필요",
]


def frame(spark, lines=LINES):
    return spark.createDataFrame(list(enumerate(lines)), "seq bigint, line string")


def test_parse_and_attribute(spark):
    rows = s.attribute_source(s.parse_progress(frame(spark))).orderBy("seq").collect()
    assert [(r.seq, r.row_key, r.state) for r in rows] == [(0, "web:7", "running"), (1, "web:7", "waiting"), (5, "zip:1", "done"), (6, "web:7", "review")]
    assert rows[0].name == "웹 이미지 #2" and rows[2].name == "" and rows[2].terminal


def test_latest_status_keeps_name_and_skip(spark):
    rows = s.attribute_source(s.parse_progress(frame(spark)))
    skips = spark.createDataFrame([("web:7",), ("zip:1",)], "row_key string")
    got = {r.row_key: (r.stage, r.state) for r in s.latest_status(rows, skips).collect()}
    assert got == {"web:7": ("스킵 요청", "skipped"), "zip:1": ("완료", "done")}


def test_review_may_be_asked_for(spark):
    df = spark.createDataFrame([("zip", "review", None), ("zip", "review", True), ("web", "review", None), ("zip", "done", None)], "source string, state string, q boolean")

    def count(running, source, destination):
        return df.where(s.reviewable(F.col("source"), F.col("state"), F.col("q"), F.lit(running), F.lit(source), F.lit(destination))).count()

    assert [count(False, True, True), count(True, True, False), count(False, True, False), count(True, False, True)] == [1, 1, 0, 0]


def test_blocked_windows_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, None, i]), rng.randint(-3, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint, d bigint")
    w = Window.partitionBy("k").orderBy("seq")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "seq", F.last("v", ignorenulls=True).over(running).alias("f"), F.sum("d").over(running).alias("t"), F.row_number().over(w).cast("bigint").alias("n"))
    block = block_of("seq", 7)
    got = numbered(running_sum(forward_fill(df, ["k"], "seq", F.col("v"), "f", block), ["k"], "seq", F.col("d"), "t", block), ["k"], ["seq"], "n", block)
    assert sorted(got.select("k", "seq", "f", "t", "n").collect()) == sorted(want.collect())


def test_slots_and_passes(spark):
    events = spark.createDataFrame([(i, k) for i, k in enumerate(["acquire"] * 3 + ["release", "acquire", "release"])], "seq bigint, kind string")
    rows = s.slot_usage(events, maximum=2).orderBy("seq").collect()
    assert [(r.running, r.waiting) for r in rows] == [(1, 0), (2, 0), (2, 1), (2, 0), (2, 1), (2, 0)]
    passes = spark.createDataFrame([(1, "a", 0, "start", 10), (1, "a", 1, "start", 20), (1, "a", 2, "complete", 50), (1, "a", 3, "complete", 60), (1, "b", 4, "start", 0)],
                                   "task_number bigint, label string, seq bigint, phase string, at bigint")
    assert [(r.start_seq, r.seq, r.elapsed) for r in s.pass_durations(passes).collect()] == [(1, 2, 30)]
    late = s.overdue_passes(passes, 25, F.lit(100)).collect()
    assert sorted((r.label, r.start_seq, r.ended) for r in late) == [("a", 0, None), ("a", 1, 50), ("b", 4, None)]


def test_event_time_rolls_over_midnight(spark):
    df = spark.sql("select timestamp'2024-05-02 00:00:03' as i, '23:59:58' as t union all select timestamp'2024-05-01 23:59:58', '00:00:01' union all select timestamp'2024-05-01 12:00:00', '11:59:00'")
    got = sorted(str(r.e) for r in df.select(sp.event_time(F.col("i"), F.col("t")).alias("e")).collect())
    assert got == ["2024-05-01 11:59:00", "2024-05-01 23:59:58", "2024-05-02 00:00:01"]


def random_lines(n, seed=2):
    rng = random.Random(seed)
    texts = ["요청 수신 · 1 KB · <img> · h/x.png", "ZIP 이미지 저장 확인 · <zip>", "자동 검수 1/3 · 시작", "오류 · x", "페이지 이미지 교체 실패 · y", "대기열 진입"]
    return [f"[10:{i // 60 % 60:02d}:{i % 60:02d}] [작업 #{rng.choice([1, 1, 1, 2, 3, 4])} · 이미지 #{rng.randint(1, 3)}] {rng.choice(texts)}" for i in range(n)]


def write_parts(spark, tmp_path, lines, parts=4):
    size = -(-len(lines) // parts)
    for n in range(parts):
        rows = [(i, f"2024-05-01 10:{i // 60 % 60:02d}:{i % 60:02d}", line) for i, line in enumerate(lines) if i // size == n]
        spark.createDataFrame(rows, "seq bigint, ingested string, line string").selectExpr("seq", "cast(ingested as timestamp) ingested", "line").coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    return spark.readStream.schema("seq bigint, ingested timestamp, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_live_status_over_many_batches_equals_the_batch_job(spark, tmp_path):
    lines = random_lines(200)
    stream = sp.progress_stream(write_parts(spark, tmp_path, lines))
    got = sp.run_live_status(stream, block=block_of("seq", 16))
    want = s.latest_status(s.attribute_source(s.parse_progress(frame(spark, lines))))
    columns = sorted(want.columns)
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = sp.StatusTable(str(tmp_path / "t"))
    first, second = (s.parse_progress(frame(spark, random_lines(60, seed))).withColumn("seq", F.col("seq") + seed * 1000) for seed in (1, 2))
    table.write(first, 0)
    table.write(second, 1)
    before = sorted(table.read(spark).collect())
    table.write(second, 1)
    assert sorted(table.read(spark).collect()) == before
    assert sorted(table.compact(spark, str(tmp_path / "c")).read(spark).collect()) == before


def test_keyed_state_gives_the_same_sources_and_timeouts(spark, tmp_path):
    lines = ["[10:00:00] [작업 #1 · 이미지 #1] 요청 수신 · 1 KB · <zip> · z", "[10:00:01] [작업 #1 · 이미지 #1] 정밀 판독·초벌 번역 1/3 시작 · 첨부 자료 5개",
             "[10:30:00] [작업 #2 · 이미지 #1] 대기열 진입", "[10:40:00] [작업 #2 · 이미지 #1] ZIP 이미지 저장 확인 · <zip>", "[10:59:00] [작업 #3 · 이미지 #1] 오류 · <img>"]
    stream = write_parts(spark, tmp_path, lines, parts=5).withColumn("ingested", F.expr("timestamp'2024-05-01 10:30:00'"))
    told = sp.attributed_stream(sp.progress_stream(stream, "1 minute"))
    query = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.seq, r.source) for r in rows if not r.timed_out) == [(0, "zip"), (1, "zip"), (3, "zip"), (4, "web")]
    assert [(r.task_number, r.image_number, r.state) for r in rows if r.timed_out] == [(1, 1, "error")]


def fold_passes(rows, limit, until):
    """Passes beyond ``limit`` seconds, line by line: (task, image, detail)."""
    running, late = {}, []
    for r in sorted(rows, key=lambda r: r.seq):
        begins, ends = r.detail.endswith("시작") or " 시작 ·" in r.detail, r.terminal or " 완료 ·" in r.detail or r.detail.endswith("완료")
        if begins or ends:
            image, detail, at = running.pop(r.task_number, (None, None, r.at))
            late += [(r.task_number, image, detail)] if r.at > at + limit else []
        if begins:
            running[r.task_number] = (r.image_number, r.detail, r.at)
    return late + [(task, image, detail) for task, (image, detail, at) in running.items() if at + limit < until]


@pytest.mark.parametrize("buckets", [1, 5])
def test_tasks_of_one_bucket_keep_their_own_sources_and_passes(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    lines = [f"[10:{i // 60:02d}:{i % 60:02d}] [작업 #{rng.randint(0, 29)} · 이미지 #{rng.randint(1, 3)}] " + rng.choice(
        ["요청 수신 · 1 KB · <img> · h/x.png", "ZIP 이미지 저장 확인 · <zip>", "자동 검수 1/3 시작", "판독 시작 · x", "판독 완료", "대기열 진입"]) for i in range(600)]
    told = sp.attributed_stream(sp.progress_stream(write_parts(spark, tmp_path, lines), "1 minute"), limit_seconds=30, buckets=buckets)
    told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    parsed = s.parse_progress(frame(spark, lines))
    columns = ["seq", "task_number", "image_number", "time", "detail", "stage", "state", "terminal", "source", "source_label", "row_key", "name"]
    assert sorted(got.where("not timed_out").select(columns).collect()) == sorted(s.attribute_source(parsed).select(columns).collect())
    want = fold_passes(parsed.withColumn("at", F.col("seq")).collect(), 30, len(lines) - 1 - 60)
    late = got.where("timed_out")
    assert len(want) > 20 and sorted((r.task_number, r.image_number, r.detail) for r in late.collect()) == sorted(want)
    assert late.where("state <> 'error' or seq is not null").isEmpty()


class Kept(dict):
    """State in memory that counts its calls."""

    calls = 0

    def getValue(self, key):
        Kept.calls += 1
        return self.get_(key)

    def updateValue(self, key, value):
        Kept.calls += 1
        self[key] = value

    def removeKey(self, key):
        Kept.calls += 1
        del self[key]

    get_ = dict.get
    iterator = dict.items


class KeptValue(Kept):
    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value

    def clear(self):
        self.pop(())


class KeptHandle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *args):
        return Kept()

    def getValueState(self, *args):
        return KeptValue()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_call_takes_many_tasks_and_has_one_timer():
    tasks, each = 60, 20
    at = pd.to_datetime([1_700_000_000 + i for i in range(tasks * each)], unit="s")
    lines = pd.DataFrame({
        "bucket": 0, "task_number": [i % tasks for i in range(tasks * each)], "seq": range(tasks * each), "time": "10:00:00", "image_number": 1, "detail": "판독 시작",
        "stage": "x", "state": "running", "terminal": False, "source": "zip", "source_label": "ZIP", "event_at": at, "phase": "begin"})
    taken, handle = sp.TaskSource(30), KeptHandle()
    taken.init(handle)
    Kept.calls = 0
    first, late = taken.handleInputRows((0,), iter([lines[:700], lines[700:]]), None)
    assert len(first) == tasks * each and len(late) == tasks * (each - 1)
    assert Kept.calls <= 4 * tasks  # by tasks, not by lines
    began = [1_700_000_000 + tasks * (each - 1) + i for i in range(tasks)]
    assert handle.timers == {(began[0] + 30) * 1000}

    class Now:
        def getCurrentWatermarkInMs(self):
            return (began[9] + 30) * 1000

        getExpiryTimeInMs = lambda self: (began[0] + 30) * 1000

    rows, = taken.handleExpiredTimer((0,), Now(), Now())
    assert sorted(rows["task_number"]) == list(range(9)) and rows["timed_out"].all() and set(rows["source"]) == {"zip"}
    assert handle.timers - {(began[0] + 30) * 1000} == {(began[9] + 30) * 1000} and len(taken.running) == tasks - 9


def test_lines_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    seen = []
    stream_queries._lines(spark, "/root/testdata/sf0.001").writeStream.foreachBatch(lambda df, n: seen.append(df.rdd.getNumPartitions())).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism]


def test_ordered_release_over_batches(spark, tmp_path):
    for n, part in enumerate([[(1, 2), (1, 0), (2, 1)], [(1, 1), (2, 2)], [(2, 0), (3, 5)]]):
        spark.createDataFrame([(a, i, f"{a}/{i}") for a, i in part], "archive bigint, entry_index bigint, name string").coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    stream = spark.readStream.schema("archive bigint, entry_index bigint, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    query = sp.ordered_release_stream(stream).writeStream.foreachBatch(
        lambda df, n: seen.append(sorted((r.archive, r.entry_index) for r in df.collect()))).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(x for batch in seen for x in batch) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_unanswered_requests_come_out_with_nulls(spark, tmp_path):
    def stream(name, rows, schema, column):
        for n, part in enumerate(rows):
            spark.createDataFrame(part, schema).withColumn(column, F.col(column).cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / name / f"p{n}"))
        typed = schema.replace(f"{column} string", f"{column} timestamp")
        return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))

    asked = stream("r", [[(1, "2024-05-01 10:00:00"), (2, "2024-05-01 10:00:00")], [(3, "2024-05-03 10:00:00")], [(4, "2024-05-03 10:00:01")]], "request_id bigint, requested_at string", "requested_at")
    answered = stream("a", [[(1, "2024-05-01 11:00:00", True, "zip", "")], [(9, "2024-05-03 10:00:00", True, "zip", "")], [(9, "2024-05-03 10:00:01", True, "zip", "")]],
                      "request_id bigint, acked_at string, success boolean, element_type string, error string", "acked_at")
    query = sp.acknowledged_stream(asked, answered).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.request_id: r.message for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == "ZIP 이미지 저장 확인 · <zip>" and got[2] is None
