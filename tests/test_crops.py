"""Crop and batch planning against plain loops."""

import math
import random
import time

from pyspark.sql import functions as F

from panelflow.operators import captions, crops as c

REGION = "image_id bigint, ord bigint, box array<double>, layout_box array<double>, translated string, font_size double, stroke_width double"


def regions(spark, boxes, image=1):
    return spark.createDataFrame([(image, i + 1, [float(x) for x in b], [float(x) for x in b], f"문구 {i}", 36.0, 2.0) for i, b in enumerate(boxes)], REGION)


def plan(df, w, h, **options):
    return c.plan_crops(df, F.lit(w), F.lit(h), **options).orderBy("image_id", "crop_index").collect()


def loop(boxes, w, h):
    """boxes: padded candidates (ord, l, t, r, b) of one image in order."""
    groups = []
    for o, *box in boxes:
        box, members = tuple(box), [o]
        for i in range(len(groups) - 1, -1, -1):
            other, theirs = groups[i][1:]
            if not (box[0] < other[2] and box[2] > other[0] and box[1] < other[3] and box[3] > other[1]) or len(members) + len(theirs) > 3:
                continue
            u = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
            if u[2] - u[0] > w * 0.48 or u[3] - u[1] > h * 0.38 or (u[2] - u[0]) * (u[3] - u[1]) > w * h * 0.16:
                continue
            box, members = u, theirs + members
            del groups[i]
        groups.append((o, box, members))
    groups.sort(key=lambda g: (g[1][1], g[1][0]))
    return [(i + 1, *g[1], g[2]) for i, g in enumerate(groups)]


def test_near_regions_share_a_crop(spark):
    df = regions(spark, [(100, 100, 180, 240), (190, 110, 270, 250)])
    (crop,) = plan(df, 1000, 1000)
    assert crop.members == [1, 2]
    inside = c.crop_regions(c.plan_crops(df, F.lit(1000), F.lit(1000)), df, F.lit(1000), F.lit(1000)).collect()
    assert all(r.font_size > 36 and all(0 <= x <= 1000 for x in r.box + r.layout_box) for r in inside)


def test_far_regions_stay_apart(spark):
    assert len(plan(regions(spark, [(50, 50, 120, 160), (800, 750, 900, 900)]), 1200, 1800)) == 2


def test_a_chain_does_not_become_one_crop(spark):
    got = plan(regions(spark, [(100 + i * 75, 200, 170 + i * 75, 350) for i in range(8)]), 1000, 1400)
    assert len(got) >= 3 and all(len(x.members) <= 3 and x.right - x.left <= 480 for x in got)


def test_random_pages_match_the_loop(spark):
    rng = random.Random(5)
    rows = []
    for image in range(8):
        for i in range(rng.randint(1, 40)):
            x, y = rng.randint(0, 900), rng.randint(0, 900)
            b = [float(x), float(y), float(x + rng.randint(5, 200)), float(y + rng.randint(5, 150))]
            rows.append((image, i + 1, b, None if i % 3 else b, " " if i % 11 == 5 else "t", 10.0, 1.0))
    df = spark.createDataFrame(rows, REGION)
    boxes = {}
    for x in c.crop_candidates(df, F.lit(2400), F.lit(3000)).collect():
        boxes.setdefault(x.image_id, []).append((x.ord, x.left, x.top, x.right, x.bottom))
    want = {(i, *g[:5], tuple(g[5])) for i, b in boxes.items() for g in loop(sorted(b), 2400, 3000)}
    assert {(x.image_id, x.crop_index, x.left, x.top, x.right, x.bottom, tuple(x.members)) for x in plan(df, 2400, 3000)} == want


def test_the_fold_meets_only_boxes_nearby():
    rng = random.Random(8)
    places = {n: i for i, n in enumerate(("ord", "left", "top", "right", "bottom", "image_width", "image_height"))}

    def seconds(n, side):
        fold, began = c._MergeNearby(places), time.perf_counter()
        for i in range(n):
            x, y = rng.randrange(side), rng.randrange(side)
            list(fold.step((i, x, y, x + 60, y + 60, side, side)))
        return time.perf_counter() - began

    seconds(1_000, 2_000)
    assert seconds(40_000, 20_000) < 40 * max(seconds(4_000, 6_300), 0.02)  # as many boxes to the area


def pack_loop(sizes, limit=4):
    batches, current = [], []
    for i, s in enumerate(sizes):
        now = current + [i]
        cols, rows = (1, 1) if len(now) == 1 else (2, math.ceil(len(now) / 2))
        w, h = max(sizes[k][0] for k in now), max(sizes[k][1] for k in now)
        shrinks = w * cols + 32 * (cols + 1) > 4096 or h * rows + 32 * (rows + 1) > 4096
        if current and (len(now) > limit or shrinks):
            batches.append(current)
            current = [i]
        else:
            current = now
    return batches + ([current] if current else [])


def test_batches_match_the_loop_across_chunks(spark):
    rng = random.Random(11)
    pages = {p: [(rng.choice([300, 900, 2100, 5000]), rng.choice([200, 1500, 2100, 4200])) for _ in range(n)] for p, n in enumerate([1, 2, 5, 37, 90])}
    df = spark.createDataFrame([(p, i + 1, 0, 0, w, h) for p, s in pages.items() for i, (w, h) in enumerate(s)],
                               "image_id bigint, crop_index bigint, left bigint, top bigint, right bigint, bottom bigint")
    for limit, chunk in ((4, 4096), (4, 5), (3, 8), (1, 4)):
        got = {p: {} for p in pages}
        for x in c.pack_batches(df, maximum_tiles=limit, chunk=chunk).collect():
            got[x.image_id].setdefault(x.batch, []).append((x.position, x.crop_index - 1))
        for p, sizes in pages.items():
            assert [[i for _, i in sorted(got[p][b])] for b in sorted(got[p])] == pack_loop(sizes, limit)


def test_four_tall_crops_make_two_sheets_at_full_size(spark):
    df = spark.createDataFrame([(1, i + 1, 0, 0, 800, 2100) for i in range(4)], "image_id bigint, crop_index bigint, left bigint, top bigint, right bigint, bottom bigint")
    tiles = c.layout_batches(c.pack_batches(df)).orderBy("crop_index").collect()
    assert [t.batch for t in tiles] == [1, 1, 2, 2] and all(t.scale == 1.0 for t in tiles)
    assert [(t.tile_left, t.tile_top) for t in tiles[:2]] == [(32, 32), (864, 32)]


def test_crop_overlaps_is_strict(spark):
    df = spark.createDataFrame([(1, 0, 0, 300, 300), (1, 300, 0, 500, 300), (1, 299, 299, 600, 600), (1, 0, 0, 300, 300)], "image_id bigint, left bigint, top bigint, right bigint, bottom bigint")
    got = {(x.left, x.top): (x.n_equal, x.n_overlapping) for x in c.crop_overlaps(df).collect()}
    assert got == {(0, 0): (2, 2), (300, 0): (1, 1), (299, 299): (1, 3)}


def test_crowded_pages_count_overlaps_without_pairs(spark):
    rng = random.Random(11)
    boxes = [(7, 0, 0, 900, 900), (7, 5, 5, 5, 40), (7, None, 1, 2, 3)]
    for page, n, side in ((1, 150, 400), (2, 90, 12), (3, 3, 50), (4, 1, 9)):
        for _ in range(n):
            x, y = rng.randrange(-side // 2, side), rng.randrange(side)
            boxes.append((page, x, y, x + rng.randrange(1, side // 3 + 2), y + rng.randrange(1, side // 3 + 2)))
    df = spark.createDataFrame(boxes * 2, "image_id bigint, left bigint, top bigint, right bigint, bottom bigint")
    want = {}
    whole = [b for b in boxes if None not in b and b[3] > b[1]] * 2
    for p, l, t, r, b in set(whole):
        met = sum(q[0] == p and l < q[3] and r > q[1] and t < q[4] and b > q[2] for q in whole)
        want[p, l, t, r, b] = (whole.count((p, l, t, r, b)), met - 1)
    for few in (0, 64, 1000):
        got = {tuple(x[:5]): tuple(x[5:]) for x in c.crop_overlaps(df, few=few).collect()}
        assert got == want


def test_a_crowded_page_costs_no_pairs(spark):
    n = 60_000
    df = spark.range(n).select(
        F.lit(1).alias("image_id"), (F.col("id") % 300).alias("left"), F.floor(F.col("id") / 300).alias("top"),
        (F.col("id") % 300 + 400).alias("right"), (F.floor(F.col("id") / 300) + 400).alias("bottom"))
    begin = time.time()
    assert c.crop_overlaps(df).agg(F.min("n_overlapping"), F.max("n_overlapping"), F.count("*")).first()[:] == (n - 1, n - 1, n)
    assert time.time() - begin < 60  # 3.6 billion pairs overlap


def test_captions_overflow(spark):
    df = spark.createDataFrame([("가" * 400, "horizontal", "dialogue", 60.0, 60.0, 20.0), ("가", "vertical", "dialogue", 300.0, 300.0, 20.0)],
                               "translated string, orientation string, region_kind string, layout_width double, layout_height double, font_px double")
    rows = captions.fit_captions(df).collect()
    assert [(x.render, x.size, x.overflow) for x in rows] == [("horizontal", 7.0, True), ("horizontal", 18.0, False)]
    rate = captions.overflow_rates(captions.fit_captions(df)).first()
    assert (rate.n_captions, rate.n_overflow, rate.overflow_rate) == (2, 1, 0.5)


def _counted(spark, df):
    """``df`` and how many of its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(pass_on, df.schema), seen


def test_regions_are_read_once_to_plan_crops(spark):
    rows = [(1, i, [10. + i, 100. * i, 60. + i, 100. * i + 150], None, "t") for i in range(6)]
    df = spark.createDataFrame(rows, "image_id int, ord int, box array<double>, layout_box array<double>, translated string")
    told, seen = _counted(spark, df)
    assert c.plan_crops(told, F.lit(1000), F.lit(1000)).collect() and seen.value == 6


def test_crops_are_read_twice_at_most_to_pack_them(spark):
    df = spark.range(1, 41).selectExpr("1 image_id", "id crop_index", "0L left", "0L top", "100 + id left_over", "300L bottom").withColumnRenamed("left_over", "right")
    told, seen = _counted(spark, df)
    assert c.pack_batches(told, chunk=8).count() == 40 and seen.value <= 80
