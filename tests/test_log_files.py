"""Byte ranges against whole files, and a stream that stops inside a line against the batch."""

import pytest

from panelflow.sources.log_files import scan_log, stream_log

TEXTS = {
    "a.log": b"first\nsecond \xed\x95\x9c\r\n\n\nlast without end", "b.log": b"", "c.log": b"\n", "d.log": b"one\n",
    "e.log": b"x" * 300_000 + b"\n" + b"bad \xff byte\ny", "_f.log": b"not seen\n", ".g.log": b"not seen\n",
}


def expected(texts, complete=False):
    told = set()
    for name, text in texts.items():
        at = 0
        for line in text.splitlines(keepends=True) if name[0] not in "._" else []:
            if not complete or line.endswith(b"\n"):
                told.add((name, at, line.rstrip(b"\r\n").decode(errors="replace")))
            at += len(line)
    return told


def seen(df):
    got = [(r.path.rsplit("/", 1)[1], r.seq, r.line) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def put(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text)


@pytest.mark.parametrize("step", [1_000, 64 << 20])
def test_ranges(spark, tmp_path, step):
    put(tmp_path, TEXTS)
    assert seen(scan_log(spark, str(tmp_path), step)) == expected(TEXTS)


@pytest.mark.parametrize("step", [1, 2, 7])
def test_small_ranges(spark, tmp_path, step):
    put(tmp_path, {"a.log": TEXTS["a.log"]})
    assert seen(scan_log(spark, f"{tmp_path}/a.log", step)) == expected({"a.log": TEXTS["a.log"]})


def test_nothing_and_no_folder(spark, tmp_path):
    assert scan_log(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        scan_log(spark, f"{tmp_path}/none").collect()


def test_stream_resumes_inside_a_file(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    steps = [
        {"a.log": b"one\ntwo\nthr"}, {"a.log": b"one\ntwo\nthree\nfo", "b.log": b"new\n"}, {"a.log": b"one\ntwo\nthree\nfo"},
        {"a.log": b"one\ntwo\nthree\nfour\n", "b.log": b"new\nmore", "A.log": b"late\n"},
    ]
    texts = {}
    for step in steps:
        texts |= step
        put(logs, step)
        stream_log(spark, str(logs), 5).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert seen(spark.read.schema("path string, seq bigint, line string").parquet(out)) == expected(texts, complete=True)
