"""Zip files in, tables, zip files out."""

import zipfile

import pytest
from pyspark.sql import functions as F

from panelflow.operators import archives as a
from panelflow.operators.metrics import StageMetrics
from panelflow.sources import archives as source


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    with zipfile.ZipFile(path / "one.zip", "w") as z:
        z.comment = b"hello"
        z.writestr("pages/", b"")
        stored = zipfile.ZipInfo("pages/002.PNG", (2020, 2, 3, 4, 5, 6))
        stored.comment, stored.external_attr = b"entry", 0o644 << 16
        z.writestr(stored, b"two")
        z.writestr("notes/readme.txt", "read me", compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("pages/001.jpeg", b"one")
        z.writestr(".png", b"no suffix")
    with zipfile.ZipFile(path / "two.zip", "w") as z:
        z.writestr("a.txt", b"a")
    (path / "bad.zip").write_bytes(b"not a zip")
    return path


def test_scan_numbers_images_in_archive_order(spark, folder):
    listed = source.scan_archives(spark, str(folder))
    images = a.number_images(listed.where("problem is null")).orderBy("image_number").collect()
    assert [(r.name, r.image_number, r.entry_index) for r in images] == [("pages/002.PNG", 1, 1), ("pages/001.jpeg", 2, 3)]
    assert [r.archive.rsplit("/", 1)[1] for r in a.archives_without_images(listed.where("problem is null")).collect()] == ["two.zip"]
    (bad,) = listed.where("problem is not null").collect()
    assert bad.archive.endswith("bad.zip") and bad.entry_index is None


def test_rebuild_keeps_everything_but_the_replaced_entry(spark, folder, tmp_path):
    out = source.make_folder(spark, str(tmp_path / "out"))
    listed = source.scan_archives(spark, str(folder)).where("archive like '%one.zip'")
    whole = listed.join(source.read_entries(listed), ["archive", "entry_index"])
    updates = whole.where("name = 'pages/001.jpeg'").select("archive", "name", F.encode(F.lit("neu"), "UTF-8").alias("data"), F.lit(1).alias("seq"))
    merged, unknown = a.upsert_entries(whole, updates)
    assert unknown.count() == 0
    named = merged.withColumn("archive", F.lit("one_ko.zip"))
    for _ in range(2):  # writing again gives the same file
        assert [tuple(r) for r in source.write_archives(named, out).collect()] == [("one_ko.zip", 5, None)]
    with zipfile.ZipFile(folder / "one.zip") as old, zipfile.ZipFile(tmp_path / "out" / "one_ko.zip") as new:
        assert new.testzip() is None and new.comment == b"hello"
        assert [(i.filename, i.date_time, i.compress_type, i.external_attr, i.comment) for i in new.infolist()] == [
            (i.filename, i.date_time, i.compress_type, i.external_attr, i.comment) for i in old.infolist()]
        assert [new.read(i) for i in new.infolist()] == [b"", b"two", b"read me", b"neu", b"no suffix"]
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".partial")] == []


def test_outcome_precedence(spark):
    rows = [(1, True, True, "e", True), (2, False, True, "e", True), (3, False, False, "e", True), (4, False, False, None, True), (5, False, False, None, False)]
    df = spark.createDataFrame([("z", *r, 2, r[0] == 4, 3) for r in rows],
                               "archive string, image_number int, skip boolean, cancelled boolean, error string, changed boolean, region_count int, review_required boolean, attempts int")
    got = a.outcomes(df)
    assert [r.outcome for r in got.orderBy("image_number").collect()] == ["skipped", "cancelled", "failed", "translated", "unchanged"]
    assert [r.state for r in got.orderBy("image_number").collect()] == ["skipped", None, "error", "review", "skipped"]
    total = a.archive_summary(got).first()
    assert (total.translated, total.failed, total.skipped, total.aborted) == (1, 1, 1, True)
    assert "자동 검수 3회 미통과" in got.where("image_number = 4").first().message


def test_release_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([("z", i, i != 2) for i in range(5)] + [("y", i, True) for i in range(2)], "archive string, entry_index bigint, ready boolean")
    assert sorted((r.archive, r.entry_index) for r in a.ordered_release(df, F.col("ready")).collect()) == [("y", 0), ("y", 1), ("z", 0), ("z", 1)]


def test_unknown_update_is_reported(spark):
    current = spark.createDataFrame([("z", 0, "a", "old")], "archive string, entry_index bigint, name string, data string")
    updates = spark.createDataFrame([("z", "b", "new", 1)], "archive string, name string, data string, seq int")
    merged, unknown = a.upsert_entries(current, updates)
    assert [r.replaced for r in merged.collect()] == [False] and [r.name for r in unknown.collect()] == ["b"]


def test_acknowledgement_wording(spark):
    df = spark.createDataFrame([(1, 1, True, "zip", None), (2, 1, False, "zip", "x" * 600), (3, 1, None, "img", None), (4, 1, False, None, ""), (0, 1, True, "zip", None)],
                               "request_id bigint, seq bigint, success boolean, element_type string, error string")
    got = {r.request_id: r.message for r in a.acknowledgement_lines(df).collect()}
    assert got[1] == "ZIP 이미지 저장 확인 · <zip>" and got[2] == "ZIP 이미지 저장 실패 · " + "x" * 500
    assert got[3] == "페이지 이미지 교체 확인 · <img>" and got[4] == "페이지 이미지 교체 실패 · 원인 미상" and 0 not in got


def test_damaged_entries_and_equal_names_are_problem_rows(spark, tmp_path):
    from panelflow.plans import jobs

    class Keep:
        def translate(self, images):
            return images.select("archive", "entry_index", F.encode(F.lit("neu"), "UTF-8").alias("new_data"), (F.col("name") == "a.png").alias("changed"),
                                 F.lit(1).alias("region_count"), F.lit(False).alias("review_required"), F.lit(1).alias("attempts"),
                                 F.lit(None).cast("string").alias("error"), F.lit(False).alias("cancelled"))

    names = ["in/my vol.zip", "in/x/한국 [1].zip", "in/y/한국 [1].zip", "in/p%41.ZIP", "in/same.zip", "in/same.ZIP", "in/hurt.zip"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.png", f"first of {name}")
            z.writestr("b.png", f"second of {name}")
    hurt = tmp_path / "in/hurt.zip"
    hurt.write_bytes(hurt.read_bytes().replace(b"second", b"damage", 1))
    results, summary, problems = jobs.process_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"), Keep())
    made = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.zip")}
    assert made == {"my vol_ko.zip", "x/한국 [1]_ko.zip", "y/한국 [1]_ko.zip", "p%41_ko.zip", "same_ko.zip"}
    with zipfile.ZipFile(tmp_path / "out/y/한국 [1]_ko.zip") as z:
        assert [z.read(i) for i in z.infolist()] == [b"neu", b"second of in/y/" + "한국 [1].zip".encode()]
    told = sorted((r.archive.rsplit("/", 1)[1], r.problem.split(":")[0]) for r in problems.collect())
    assert told == [("hurt.zip", "b.png"), ("same.zip", "output name taken")]
    failed = [(r.archive.rsplit("/", 1)[1], r.name, r.error) for r in results.where("outcome = 'failed'").collect()]
    assert failed == [("hurt.zip", "b.png", jobs.NO_ANSWER)] and summary.count() == len(names)


def test_changed_manual_reviews_replace_their_entry(spark, folder, tmp_path):
    from panelflow.plans import jobs

    listed = source.scan_archives(spark, str(folder)).where("problem is null").drop("problem")
    whole = listed.join(source.read_entries(listed), ["archive", "entry_index"]).withColumn("archive", F.regexp_extract("archive", "([^/]+)$", 1))
    reviewed = spark.createDataFrame([("one.zip", 1, True, True), ("one.zip", 2, True, False), ("two.zip", 7, True, True)], "archive string, image_number int, reviewed boolean, changed boolean")
    pictures = spark.createDataFrame([("one.zip", 1, bytearray(b"new")), ("one.zip", 2, bytearray(b"no")), ("two.zip", 7, bytearray(b"no"))], "archive string, image_number int, data binary")
    written, unknown = jobs.apply_manual_reviews(whole, reviewed, pictures, str(tmp_path / "out"))
    assert [tuple(r) for r in written.collect()] == [("one.zip", 5, None)]
    assert [tuple(r) for r in unknown.collect()] == [("two.zip", 7)]
    with zipfile.ZipFile(tmp_path / "out" / "one.zip") as z:
        assert [z.read(i) for i in z.infolist()] == [b"", b"new", b"read me", b"one", b"no suffix"]


def test_stage_metrics_count_what_is_written(spark):
    metrics = StageMetrics()
    rows = metrics.written(spark.createDataFrame([(1, "failed"), (2, None), (3, "done")], "id bigint, outcome string"), "first", F.col("outcome") == "failed")
    metrics.written(rows.where("id < 0"), "second", F.lit(True))
    assert rows.count() == 3 and [tuple(r) for r in metrics.table(spark).orderBy("stage").collect()] == [("first", 3, 1), ("second", 0, 0)]
    assert StageMetrics().table(spark).collect() == []


def test_reading_is_dealt_out_however_few_bytes_the_names_have(spark, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    for name in ("a.zip", "b.zip"):
        with zipfile.ZipFile(path / name, "w") as z:
            for i in range(1500):
                z.writestr(f"{i}.png", f"{name} {i}")
    read = source.read_entries(source.scan_archives(spark, str(path))).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.archive[-5:], r.entry_index): r.data for r in read} == {(n, i): f"{n} {i}".encode() for n in ("a.zip", "b.zip") for i in range(1500)}
    assert len(read) == 3000 and len({r.task for r in read}) >= 6
