"""Run diagnostics on small hand-made runs."""

import json

from panelflow.operators import diagnostics as d
from panelflow.plans import catalog

A, B = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"


def lines(spark, *rows):
    return spark.createDataFrame([(run, stream, i, text) for i, (run, stream, text) in enumerate(rows)], "run_id bigint, stream string, seq bigint, line string")


def runs(spark, *rows):
    defaults = (None, 1, "", False, False, False)
    return spark.createDataFrame([(r[0], *(r[1:] + defaults[len(r) - 1:])) for r in rows],
                                 "run_id bigint, stage string, exit_code int, spawn_error string, cancelled boolean, timed_out boolean, resolved boolean")


def details(frame):
    got = {}
    for r in frame.orderBy("run_id", "position").collect():
        got.setdefault(r.run_id, []).append(r.detail)
    return got


def test_details_in_order_without_repeats(spark):
    data = lines(
        spark, (1, "stdout", json.dumps({"type": "item.completed", "item": {"type": "agent_message", "text": "no\naccess"}})),
        (1, "stdout", json.dumps({"type": "item.completed", "item": {"type": "command_execution", "exit_code": 2, "aggregated_output": "denied"}})),
        (1, "stdout", json.dumps({"type": "item.completed", "item": {"type": "command_execution", "exit_code": 2, "aggregated_output": "denied"}})),
        (1, "stdout", json.dumps({"type": "item.completed", "item": {"type": "command_execution", "exit_code": None}})),
        (1, "stdout", json.dumps({"type": "turn.failed", "error": {"message": "rate limit"}, "message": ""})),
        *[(1, "stderr", f"e{i}") for i in range(8)], (2, "stdout", "a"), (2, "stdout", " "), *[(2, "stdout", f"p {i}") for i in range(5)], (3, "stdout", "{bad"))
    got = details(d.diagnostic_details(data, runs(spark, (1, "render"), (2, ""), (3, "stage"))))
    assert got[1] == ["실패 단계: render", "모델 메시지: no access", "도구 종료 코드: 2", "도구 출력: denied", "Codex 이벤트 오류: rate limit"] + [f"stderr: e{i}" for i in range(2, 8)]
    assert got[2] == ["stdout: p 1", "stdout: p 2", "stdout: p 3", "stdout: p 4"] and got[3] == ["실패 단계: stage", "stdout: {bad"]


def test_at_most_twelve(spark):
    data = lines(spark, *[(1, "stdout", json.dumps({"type": "error", "message": f"m{i}"})) for i in range(20)])
    assert len(details(d.diagnostic_details(data, runs(spark, (1, "s"))))[1]) == 12


def test_failure_classes(spark):
    data = lines(spark, (1, "stderr", "models cache is stale"), (1, "stderr", "rate limit exceeded"), (2, "stderr", "prompt_cache_retention is NOT supported on this model"),
                 (3, "stdout", "the safety filter"), (3, "stdout", "will block it"), (4, "stdout", "x"), (5, "stdout", "x"), (6, "stdout", "x"), (7, "stdout", "x"))
    told = {r.run_id: r for r in d.failure_class(data, runs(
        spark, (1, "s", 7), (2, "s", 1), (3, "s", 0), (4, "s", 0), (5, "s", 0, "", True), (6, "s", None, "gone", False, True), (7, "s", 0, "", False, False, True), (8, None, None, "gone"))).collect()}
    assert told[1].code == "CODEX_EXEC_FAILED" and told[1].headline == "Codex 종료 코드 7 · rate limit exceeded"
    assert told[2].code == "CODEX_MODEL_COMPATIBILITY" and told[2].details[-1].startswith("해결 방법")
    assert told[3].code == "CODEX_IMAGE_SAFETY_BLOCKED" and told[4].code == "CODEX_IMAGE_RESULT_FAILED"
    assert told[5].code == "TRANSLATION_CANCELLED" and told[6].code == "CODEX_TIMEOUT" and told[7].code is None
    assert told[8].headline == "Codex 실행 실패 · gone" and told[8].details == ["프로세스 오류: gone"]


def test_paths_threads_and_results(spark):
    own, other = rf"C:\gen\{A}\a.png", rf"C:\gen\{B}\b.png"
    data = lines(
        spark, (1, "stdout", json.dumps({"type": "x", "thread_id": A})), (1, "stdout", json.dumps({"m": {"text": f"made {own} and C:/else/q.JPEG"}})), (1, "stdout", f"raw {own.upper()}"),
        (2, "stdout", json.dumps([{"deep": {"threadId": A.upper()}}, {"threadId": "../x"}])), (2, "stdout", f'not json "thread_id":"{B}"'),
        (3, "stdout", "D:/no/z.webp"), (4, "stdout", "nothing"), (5, "stdout", json.dumps({"text": json.dumps({"thread_id": B})})))
    paths = {}
    for r in d.generated_paths(data).orderBy("run_id", "source", "seq", "at", "hit").collect():
        paths.setdefault(r.run_id, []).append(r.path)
    # raw text comes first, also of JSON lines, where one doubled backslash is read as one
    assert [x.lower() for x in paths[1]] == [own.lower(), "c:/else/q.jpeg"] and paths[3] == ["D:/no/z.webp"]
    assert {(r.run_id, r.thread_id) for r in d.thread_ids(data).collect()} == {(1, A), (2, A.upper())}
    files = spark.createDataFrame([(own, 5), (rf"C:\gen\{A}\sub\new.webp", 9), (other, 99), (rf"C:\gen\{A}\t.txt", 100)], "path string, modified_at bigint")
    assert {r.thread_key: r.path for r in d.latest_generated_file(files, "C:/gen").collect()} == {A: rf"C:\gen\{A}\sub\new.webp", B: other}
    got = {r.run_id: (r.path, r.problem) for r in d.resolve_results(data, files, runs(spark, *[(i,) for i in range(1, 6)]), "C:/gen").collect()}
    assert got == {1: (own, None), 2: (rf"C:\gen\{A}\sub\new.webp", None), 3: (None, "outside_root"), 4: (None, "no_result"), 5: (None, "no_result")}


def test_plans_hold_no_long_literals(spark):
    queries = catalog.queries()
    for name in ("failure_class", "diagnose_runs", "resolve_results"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 1_000_000, name
