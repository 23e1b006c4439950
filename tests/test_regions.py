"""Region QA against golden values and a straightforward fold."""

import random
import time

from pyspark.sql import functions as F

from panelflow.operators import regions as r
from panelflow.schemas import REGION_FIELDS
from panelflow.sources.model_json import scan_regions, scan_reviews

SCHEMA = "image_id bigint, ord bigint, left bigint, top bigint, right bigint, bottom bigint, confidence double"


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    s = w * h
    return s / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - s)


def fold(rows):
    kept = []
    for image, ord_, *box, conf in sorted(rows, key=lambda x: x[1]):
        hit = next((s for s in kept if iou(box, s[2]) >= 0.72), None)
        if hit is None:
            kept.append([ord_, ord_, box, conf or 0.0])
        elif (conf or 0.0) > hit[3]:
            hit[1:] = [ord_, box, conf or 0.0]
    return {(s[0], s[1]) for s in kept}


def check(spark, rows):
    got = {}
    for x in r.dedup_regions(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.image_id, set()).add((x.slot_ord, x.ord))
    images = {x[0] for x in rows}
    assert got == {i: fold([x for x in rows if x[0] == i]) for i in images}


def test_more_confident_copy_takes_over(spark):
    check(spark, [(1, 1, 100, 100, 500, 500, 0.6), (1, 2, 105, 105, 495, 495, 0.95)])


def test_random_boxes_match_the_fold(spark):
    rng = random.Random(7)
    rows = []
    for image in range(12):
        for k in range(rng.randint(1, 60)):
            w, h = rng.choice([4, 20, 60, 61, 120, 260]), rng.choice([5, 30, 90, 240])
            x, y = rng.randint(0, 8) * rng.choice([1, 3, 9, 20]), rng.randint(0, 8) * rng.choice([1, 4, 15])
            rows.append((image, k + 1, x, y, x + w, y + h, rng.choice([None, 0.0, 0.2, 0.5, 0.5, 0.9])))
    check(spark, rows)


def test_chains_where_replacement_moves_the_slot(spark):
    rng = random.Random(3)
    rows = [(1, k + 1, 6 * rng.randint(0, 14), 0, 0, 100, rng.random()) for k in range(120)]
    check(spark, [(a, b, x, t, x + 100, bt, c) for a, b, x, t, _, bt, c in rows])


def test_one_hot_image_of_equal_copies_needs_no_fold(spark):
    rows = [(1, k, 10 + k % 2, 10, 90, 90, (k * 37 % 101) / 100) for k in range(5000)] + [(2, 1, 0, 0, 5, 5, None)]
    check(spark, rows)


def test_overlap_report_counts_copies_and_neighbours(spark):
    rows = [(1, 1, 0, 0, 100, 100, 0.1), (1, 2, 0, 0, 100, 100, 0.1), (1, 3, 5, 0, 105, 100, 0.1), (1, 4, 300, 0, 400, 100, 0.1), (2, 1, 0, 0, 100, 100, 0.1)]
    got = {(x.image_id, x.left): (x.n_equal, x.n_near) for x in r.overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0): (2, 1), (1, 5): (1, 2), (1, 300): (1, 0), (2, 0): (1, 0)}


def test_confidence_null_counts_as_zero_and_missing_not_at_all(spark):
    df = spark.createDataFrame([(1, 0.8, True), (1, 0.6, True), (2, None, True), (2, 0.6, True), (3, None, False), (4, 0.91, True), (4, 0.31, True)],
                               "image_id int, confidence double, has_confidence boolean")
    mean = {x.image_id: x.m for x in df.groupBy("image_id").agg(r.average_confidence().alias("m")).collect()}
    assert abs(mean[1] - 0.7) < 1e-12 and mean[2] == 0.3 and mean[3] is None
    accepted, rejected = r.split_reliable(df)
    assert sorted(x.confidence for x in accepted.collect()) == [0.6, 0.6, 0.8, 0.91] and rejected.count() == 3


def _normalized(spark, width, height, **fields):
    defaults = dict(box=None, layout_box=None, translated="t", region_kind=None, font_size=None, text_color=None, background_color=None,
                    stroke_color=None, stroke_width=None, rotation=None, background_complex=None)
    kinds = dict(box="array<double>", layout_box="array<double>", translated="string", region_kind="string", font_size="double", text_color="string",
                 background_color="string", stroke_color="string", stroke_width="double", rotation="double", background_complex="boolean")
    values = {**defaults, **fields}
    df = spark.createDataFrame([tuple(values[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return r.normalize_regions(df, F.lit(width), F.lit(height)).collect()


def test_normalize_region_golden(spark):
    (row,) = _normalized(spark, 1000, 500, box=[200., 100., 800., 500.], translated=" 안녕하세요 ", font_size=80.0, text_color="#112233", stroke_width=2.0, rotation=400.0)
    assert (row.left, row.top, row.right, row.font_px, tuple(row.text_rgb)) == (200, 50, 800, 40.0, (17, 34, 51))
    assert row.translated == "안녕하세요" and row.rotation == 180.0 and row.region_kind == "dialogue" and row.stroke_px == 1.0


def test_layout_box_rules(spark):
    (own,) = _normalized(spark, 1000, 500, box=[300., 200., 500., 400.], layout_box=[200., 100., 700., 600.], font_size=60.0)
    assert (own.layout_left, own.layout_top, own.layout_right - own.layout_left, own.layout_bottom - own.layout_top) == (200, 50, 500, 250)
    (small,) = _normalized(spark, 1000, 1000, box=[300., 200., 700., 800.], layout_box=[320., 500., 500., 750.], region_kind="dialogue", font_size=60.0)
    assert not small.has_layout_box and (small.layout_left, small.layout_top, small.layout_right, small.layout_bottom) == (300, 200, 700, 800)
    assert _normalized(spark, 1000, 1000, box=[0., 0., 100., 100.], translated="  ") == []
    (kind,) = _normalized(spark, 1000, 1000, box=[0., 0., 100., 100.], region_kind="odd", background_complex=True)
    assert kind.region_kind == "label" and abs(kind.font_px - 82.0) < 1e-9


GOOD = ('{"box":[1,2,3,4],"layoutBox":[1,2,3,4.5],"original":"o","translated":"t","confidence":0.5,"regionKind":"sfx","orientation":"vertical","fontSize":3,'
        '"textColor":"a","backgroundColor":"b","bold":true,"fontStyle":"serif","strokeColor":"c","strokeWidth":1,"italic":false,"rotation":0,"align":"left",'
        '"backgroundComplex":false}')


def test_scan_regions_names_every_violation(spark):
    bad = GOOD.replace('"sfx"', '"boom"').replace("0.5", "2").replace("[1,2,3,4]", "[1,2,3]").replace('"bold":true,', "").replace('"left"', "1")[:-1] + ',"x":1}'
    answers = spark.createDataFrame([(1, '{"regions":[' + GOOD + "," + bad + "]}"), (2, "nope"), (3, "{}"), (4, '{"regions":[]}'), (5, None)], "id int, output string")
    good, quarantine = scan_regions(answers)
    (row,) = good.collect()
    assert (row.id, row.ord, row.box, row.confidence, row.bold) == (1, 1, [1.0, 2.0, 3.0, 4.0], 0.5, True)
    told = {(x.id, x.ord): x.violations for x in quarantine.collect()}
    assert told == {(1, 2): ["size:box", "range:confidence", "enum:regionKind", "missing:bold", "type:align", "unexpected:x"],
                    (2, None): ["invalid_json"], (3, None): ["regions_not_an_array"], (5, None): ["invalid_json"]}


def test_scan_reviews(spark):
    answers = spark.createDataFrame([(1, '{"passed":false,"summary":"s","issues":["a"],"regions":[' + GOOD + "]}"), (2, '{"passed":1,"issues":[1],"regions":[]}')], "id int, output string")
    reviews, regions, quarantine = scan_reviews(answers)
    (row,) = reviews.collect()
    assert (row.passed, row.summary, row.issues, row.n_regions) == (False, "s", ["a"], 1) and regions.count() == 1
    assert [x.violations for x in quarantine.collect()] == [["type:passed", "missing:summary", "type:issues"]]


def test_slots_are_found_among_neighbours():
    at = {"left": 0, "top": 1, "right": 2, "bottom": 3, "ord": 4, "__confidence": 5}

    def scan(rows):
        slots = []
        for row in rows:
            for slot in slots:
                x = min(row[2], slot[1][2]) - max(row[0], slot[1][0])
                y = min(row[3], slot[1][3]) - max(row[1], slot[1][1])
                if x > 0 and y > 0:
                    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                    if x * y / (area(row) + area(slot[1]) - x * y) >= 0.72:
                        if row[5] > slot[1][5]:
                            slot[1] = row
                        break
            else:
                slots.append([row[4], row])
        return [(first, row[4]) for first, row in slots]

    rng = random.Random(2)
    for _ in range(60):
        scale, rows = rng.choice([1e-3, 1, 1000, 1e6]), []
        for k in range(120):
            left, top = (rng.uniform(-3, 3) * scale for _ in range(2))
            rows.append((left, top, left + rng.choice([0, -1, 1, 1.1, 1.35, 2, 2.5]) * scale, top + rng.choice([1, 1.2, 1.39, 4]) * scale, k, rng.choice([0.1, 0.5, 0.9])))
        rows.append((float("nan"), 0.0, 1.0, 1.0, 200, 0.5))
        fold = r._KeepFirstCopy(at)
        for row in rows:
            fold.step(row)
        assert list(fold.finish()) == scan(rows)


def test_a_long_chain_takes_time_in_proportion():
    at = {"left": 0, "top": 1, "right": 2, "bottom": 3, "ord": 4, "__confidence": 5}

    def seconds(n):
        fold, begin = r._KeepFirstCopy(at), time.perf_counter()
        for k in range(n):
            fold.step((k * 20.0, 0.0, k * 20.0 + 100, 100.0, k, k % 7 / 7))
        assert n / 2 <= len(fold.slots) <= n
        return time.perf_counter() - begin
    assert seconds(100_000) < 30 * seconds(10_000)


def test_answers_are_parsed_once_for_the_quarantine(spark):
    answers = spark.createDataFrame([(1, '{"regions":[[],{},null,' + GOOD.replace("[1,2,3,4]", "[null,null,null,null]") + "]}"), (2, "null"), (3, '{"regions":null}'), (4, '{"regions":[],"b":1,"a":1}')], "id int, output string")
    good, quarantine = scan_regions(answers)
    assert [(x.id, x.ord, x.box) for x in good.collect()] == [(1, 4, [None] * 4)]
    told = {(x.id, x.ord): x.violations for x in quarantine.collect()}
    missing = [f"missing:{name}" for name, _, _ in REGION_FIELDS]
    assert told == {(1, 1): missing, (1, 2): missing, (1, 3): missing, (2, None): ["not_an_object"], (3, None): ["regions_not_an_array"],
                    (4, None): ["unexpected:a", "unexpected:b"]}
    assert quarantine._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def _random_rows(rng, image, n):
    rows = []
    for k in range(n):
        w, h = rng.choice([20, 60, 61, 120]), rng.choice([30, 90])
        x, y = rng.randint(0, 8) * rng.choice([1, 3, 9, 20]), rng.randint(0, 8) * rng.choice([1, 4, 15])
        rows.append((image, k + 1, x, y, x + w, y + h, rng.choice([None, 0.0, 0.2, 0.5, 0.5, 0.9])))
    return rows


def test_few_regions_are_folded_where_they_are_grouped(spark, monkeypatch):
    labels, write = [], r.materialize
    monkeypatch.setattr(r, "materialize", lambda df, label: labels.append(label) or write(df, label))
    rng = random.Random(11)
    rows = [x for image in range(30) for x in _random_rows(rng, image, rng.randint(1, r.CROWDED))]
    check(spark, rows)
    assert labels == ["crowded"]
    kept = r.dedup_regions(spark.createDataFrame(rows, SCHEMA).repartition("image_id"))
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_arrays_and_components_keep_the_same_rows(spark):
    rng = random.Random(12)
    rows = [x for image, n in enumerate([1, 2, 5, 30, 64, 65, 90, 7, 9]) for x in _random_rows(rng, image, n)]
    rows += [(20, 1, 0, 0, 9, 9, 0.5), (20, 1, 0, 0, 9, 9, 0.5), (20, 2, 0, 0, 9, 8, float("nan")), (None, 1, 0, 0, 9, 9, 0.5)]  # rows that come twice, no image
    rows += [(21, 1, 0, 0, 0, 9, 0.5), (21, 2, 0, 0, 0, 9, 0.6), (21, 3, None, 0, 5, 9, 0.5), (22, None, 0, 0, 9, 9, 0.5), (22, 2, 0, 0, 9, 9, 0.4)]  # no area, no number
    rows += [(23, 1, 0, 0, 9, 9, 0.5), (23, 1, 50, 50, 90, 90, 0.7), (23, 2, 51, 50, 90, 90, 0.8), (24, 1, 0, 0, 2**40, 2**40, 0.5), (24, 2, 0, 0, 2**40 + 1, 2**40, 0.6)]
    regions = spark.createDataFrame(rows, SCHEMA).withColumn("note", F.map_from_arrays(F.array("ord"), F.array("left")).cast("string"))
    told = lambda df: sorted(map(repr, df.collect()))
    want = r._dedup_components(regions, "image_id")
    for crowded in (r.CROWDED, 4, 1000):
        got = r.dedup_regions(regions, crowded=crowded)
        assert got.columns == want.columns and told(got) == told(want)
