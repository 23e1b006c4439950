"""Time limits of passes: keyed state over several triggers against one plain walk of the log."""

import random

import pytest
from pyspark.sql import functions as F

from panelflow.functions.progress import RULES
from panelflow.plans import catalog, stream_queries
from panelflow.streaming import passes, progress as sp

DAY = 1714521600  # 2024-05-01
LABELS = ["정밀 판독·초벌 번역 1/3", "Codex 이미지 렌더 1회차", "Codex 대사 크롭 2/3", "합성 결과 시각 검수 3/3"]
DELAY = 60


def limit(label):
    return 3600 if label == "요청" else 900 if label.startswith("Codex") else 300


def walk(events):
    """(at, seq, task, image, kind, label, elapsed) -> what ran beyond its limit."""
    running, late = {}, []
    last = max(e[0] for e in events) - DELAY

    def finish(key, at):
        state = running.pop(key, None)
        if state and at > state[1]:
            late.append((*key, state[0], state[1] - state[0], state[2]))
    for at, _, task, image, kind, label, elapsed in sorted(events):
        key = (task, image, label)
        if kind == "close":
            for other in [k for k in running if k[:2] == (task, image)]:
                finish(other, at)
        elif kind == "model" and key in running and at <= running[key][1]:
            running[key] = (running[key][0], running[key][0] + 10800, at)
        elif kind == "alive":
            if key in running and at > running[key][1]:
                finish(key, at)
            if key in running:
                running[key] = (*running[key][:2], at)
            elif elapsed <= limit(label):
                running[key] = (at - elapsed, at - elapsed + limit(label), at)
        elif kind in ("start", "end"):
            finish(key, at)
            if kind == "start":
                running[key] = (at, at + limit(label), at)
    for key, state in list(running.items()):
        if state[1] <= last:
            finish(key, state[1] + 1)
    return sorted(late)


def line(at, task, image, kind, label, elapsed):
    detail = {
        "start": "요청 수신 · 1 KB · <zip> · z" if label == "요청" else f"{label} 시작 · 첨부 자료 5개", "end": f"{label} 완료 · 후보 1개 · 3초",
        "alive": f"{label} 진행 중 · {f'{elapsed // 60}분 ' if elapsed >= 60 else ''}{elapsed % 60}초 경과", "model": "렌더 모드 · Codex 대사 작업 시트 렌더",
        "close": "오류 · timeout"}[kind]
    clock = at - DAY
    return f"[{clock // 3600:02}:{clock // 60 % 60:02}:{clock % 60:02}] [작업 #{task} · 이미지 #{image}] {detail}"


def found(spark, folder, events, parts):
    """All parts of the log, one after the other; the stream stops after every second one."""
    rows = sorted(events)
    size = -(-len(rows) // parts)
    for n in range(parts):
        some = rows[n * size:(n + 1) * size]
        if some:
            random.Random(n).shuffle(some)
            frame = spark.createDataFrame([(seq, at, line(at, *rest)) for at, seq, *rest in some], "seq bigint, at bigint, line string")
            frame.select("seq", F.timestamp_seconds("at").alias("ingested"), "line").write.parquet(f"{folder}/in/p{n:02}")
        if n % 2 == 0 and n != parts - 1:
            continue
        stream = spark.readStream.schema("seq bigint, ingested timestamp, line string").option("maxFilesPerTrigger", 8).parquet(f"{folder}/in/*")
        passes.timed_out_stream(sp.progress_stream(stream, f"{DELAY} seconds")).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(passes.TIMED_OUT).parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("parts", [1, 6])
def test_any_dealing_gives_the_same_rows(spark, tmp_path, parts):
    rng, events = random.Random(3), []
    for seq in range(500):
        task, image, label = rng.randint(1, 3), rng.randint(1, 2), rng.choice(LABELS)
        kind = rng.choices(["start", "end", "alive", "request", "model", "close"], [8, 4, 8, 1, 2, 1])[0]
        if kind in ("request", "model", "close"):
            kind, label = "start" if kind == "request" else kind, "요청"
        events.append((DAY + 150 * seq + rng.randint(0, 60), seq, task, image, kind, label, rng.choice([10, 250, 400, 899, 5000])))
    want = walk(events)
    assert {r[4] for r in want} == {300, 900, 3600, 10800} and len(want) > 40
    assert found(spark, tmp_path, events, parts) == want


def test_overlapping_passes_have_their_own_timers(spark, tmp_path):
    at = DAY + 3600
    events = [
        (at, 0, 1, 1, "start", LABELS[0], 0), (at + 10, 1, 1, 1, "start", LABELS[1], 0), (at + 10, 2, 1, 1, "alive", LABELS[0], 10),
        (at + 250, 3, 1, 1, "end", LABELS[3], 0), (at + 320, 4, 2, 1, "alive", LABELS[0], 290), (at + 905, 5, 1, 1, "end", LABELS[1], 0),
        (at + 5000, 6, 9, 9, "close", "요청", 0), (at + 5100, 7, 9, 9, "close", "요청", 0)]
    assert found(spark, tmp_path, events, 4) == [(1, 1, LABELS[0], at, 300, at + 10), (2, 1, LABELS[0], at + 30, 300, at + 320)]


def test_query_sets_the_state_store_it_needs(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert catalog.queries()["timed_out_passes"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set(name, before)


def test_images_of_one_bucket_share_a_timer(spark, tmp_path):
    at = DAY + 3600
    events = [(at + n, n, n, 1, "start", LABELS[0], 0) for n in range(4)] + [
        (at + 3, 4, 0, 2, "start", LABELS[1], 0), (at + 303 + DELAY, 5, 9, 9, "close", "요청", 0), (at + 903 + DELAY, 6, 9, 9, "close", "요청", 0)]
    told = []
    for n, some in enumerate((events[:5], events[5:6], events[6:])):
        frame = spark.createDataFrame([(seq, at, line(at, *rest)) for at, seq, *rest in some], "seq bigint, at bigint, line string")
        frame.select("seq", F.timestamp_seconds("at").alias("ingested"), "line").write.parquet(f"{tmp_path}/in/p{n}")
        stream = spark.readStream.schema("seq bigint, ingested timestamp, line string").parquet(f"{tmp_path}/in/*")
        passes.timed_out_stream(sp.progress_stream(stream, f"{DELAY} seconds"), buckets=1).writeStream.format("parquet").option(
            "path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        told.append(sorted(tuple(r) for r in spark.read.schema(passes.TIMED_OUT).parquet(f"{tmp_path}/out").collect()))
    first = [(n, 1, LABELS[0], at + n, 300, at + n) for n in range(4)]
    assert told == [[], first, sorted([*first, (0, 2, LABELS[1], at + 3, 900, at + 3)])] and told[-1] == walk(events)


def test_lines_are_taken_apart_once_and_by_all_cores(spark, tmp_path):
    events = [(n, f"2024-01-01 00:{n % 60:02}:00", n % 7, ("signup", "view", "click", "purchase", "error")[n % 5]) for n in range(200)]
    spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string").withColumn(
        "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = stream_queries._pass_lines(spark, str(tmp_path))
    assert lines.count() == 200 and lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    lines.write.parquet(f"{tmp_path}/lines")
    stream = passes.pass_lines(sp.progress_stream(spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/lines")))
    plan = spark._jvm.PythonSQLUtils.explainString(stream._jdf.queryExecution(), "extended").split("== Physical Plan ==")[1]
    assert plan.count("Contains(") == len(RULES)
