"""Pixel screening on small made pictures."""

import random

from pyspark.sql import functions as F

from panelflow.functions import geometry as g
from panelflow.functions.color import rgb
from panelflow.operators import raster as r


def picture(spark, width, height, value, image=1):
    df = spark.range(width * height).select(F.lit(image).cast("bigint").alias("image_id"), F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return df.withColumn("v", value(F.col("x"), F.col("y")).cast("int")).withColumn("r", F.col("v")).withColumn("g", F.col("v")).withColumn("b", F.col("v"))


def size(spark, width, height):
    return spark.createDataFrame([(1, width, height)], "image_id bigint, width bigint, height bigint")


def test_dark_lower_panel_with_white_strokes_is_found(spark):
    def value(x, y):
        return F.when(y < 300, 255).when((x.between(40, 60) | x.between(90, 110)) & y.between(340, 420), 250).otherwise(10)

    tiles = r.score_tiles(r.tile_stats(picture(spark, 300, 450, value), size(spark, 300, 450))).collect()
    assert tiles and all(t.top > 200 for t in tiles) and tiles[0].left == 0
    assert r.score_tiles(r.tile_stats(picture(spark, 200, 300, lambda x, y: F.lit(255)), size(spark, 200, 300))).count() == 0


def test_tile_stats_match_counting(spark):
    rng = random.Random(4)
    w, h = 31, 23
    grid = [[rng.choice([0, 100, 255]) for _ in range(w)] for _ in range(h)]
    df = spark.createDataFrame([(1, y, x, grid[y][x]) for y in range(h) for x in range(w)], "image_id bigint, y bigint, x bigint, v int")
    carried = df.withColumn("width", F.lit(w)).withColumn("height", F.lit(h))
    stats = r.tile_stats(df, size(spark, w, h)).collect()
    assert sorted(stats) == sorted(r.tile_stats(carried).collect()) and len(stats) == 9
    for t in stats:
        cells = [(y, x) for y in range(t.top, t.bottom) for x in range(t.left, t.right)]
        steps = [(grid[y][x] > 205) != (grid[y][x - 1] > 205) for y, x in cells if x > t.left] + [(grid[y][x] > 205) != (grid[y - 1][x] > 205) for y, x in cells if y > t.top]
        assert abs(t.dark_ratio - sum(grid[y][x] < 50 for y, x in cells) / len(cells)) < 1e-12
        assert abs(t.bright_ratio - sum(grid[y][x] > 205 for y, x in cells) / len(cells)) < 1e-12
        assert abs(t.transition_ratio - sum(steps) / len(steps)) < 1e-12


def windows(spark, kind="dialogue", font=20.0, box=(10, 10, 90, 90), complex_=False):
    row = spark.range(1).select(
        F.lit(1).cast("bigint").alias("image_id"), F.lit(1).cast("bigint").alias("ord"), F.lit(kind).alias("region_kind"), F.lit(font).alias("font_px"), F.lit(0.0).alias("stroke_px"),
        *[F.lit(v).alias(e) for e, v in zip(g.EDGES, box)], *[F.lit(v).alias(f"layout_{e}") for e, v in zip(g.EDGES, box)], F.lit(complex_).alias("background_complex"),
        F.lit("vertical").alias("orientation"), rgb(17, 17, 17).alias("text_rgb"), rgb(255, 255, 255).alias("stroke_rgb"), rgb(255, 255, 255).alias("background_rgb"),
        F.lit(100).alias("image_width"), F.lit(100).alias("image_height"))
    return r.region_windows(row)


def screened(spark, value, **options):
    win = windows(spark, **options)
    marked = r.ink_pixels(win, picture(spark, 100, 100, value))
    lines = r.long_runs(marked.where("candidate"), win)
    ink = marked.where("ink").join(lines, ["image_id", "ord", "y", "x"], "left_anti")
    return lines, r.glyph_components(ink, win), win


def test_a_long_line_is_protected_and_strokes_are_kept(spark):
    def value(x, y):
        return F.when((y == 20) | (x.between(40, 44) & y.between(40, 54)) | (x.between(45, 52) & y.between(46, 48)), 0).otherwise(255)

    lines, components, win = screened(spark, value)
    assert {row.y for row in lines.collect()} == {20}
    (glyph,) = components.collect()
    assert glyph.is_glyph and (glyph.min_x, glyph.min_y, glyph.right, glyph.bottom, glyph.area) == (40, 40, 53, 55, 75 + 24)
    summary = r.ink_summary(components, win).first()
    assert summary.safe and summary.n_pixels == 99 and tuple(summary.bounds) == (38, 38, 55, 57)


def test_components_match_flood_fill(spark):
    rng = random.Random(9)
    win = windows(spark, font=6.0, complex_=True)
    cells = {(y, x) for y in range(10, 90) for x in range(10, 90) if rng.random() < 0.3}
    df = spark.createDataFrame([(1, 1, y, x) for y, x in cells], "image_id bigint, ord bigint, y bigint, x bigint")
    want, left = set(), set(cells)
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for n in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in left:
                    left.discard(n)
                    part.add(n)
                    todo.append(n)
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        want.add((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
    got = sorted((c.min_x, c.min_y, c.right, c.bottom, c.area) for c in r.glyph_components(df, win).collect())
    assert set(got) == want and len(got) >= len(want)


def test_effects_keep_what_touches_the_window(spark):
    def value(x, y):
        return F.when(x.between(45, 55) & (y > 2), 0).otherwise(255)

    _, balloon, _ = screened(spark, value, font=30.0)
    _, effect, _ = screened(spark, value, font=30.0, kind="sfx")
    assert [c.is_glyph for c in balloon.collect()] in ([], [False])
    assert all(c.is_glyph is not None for c in effect.collect())


def test_text_presence(spark):
    clean = picture(spark, 100, 80, lambda x, y: F.lit(255))
    region = spark.createDataFrame([(1, 1, [350., 250., 650., 750.], None, "한", 36.0, "#111111", None, 0.0)],
                                   "image_id bigint, ord bigint, box array<double>, layout_box array<double>, translated string, font_size double, text_color string, stroke_color string, stroke_width double")
    targets = r.text_targets(region, F.lit(100), F.lit(80))
    shown = picture(spark, 100, 80, lambda x, y: F.when(x.between(43, 56) & y.between(28, 51), 17).otherwise(170))
    got = r.text_presence_gate(clean, shown, targets).first()
    assert got.present and got.minimum == 12 and got.selected == 14 * 24
    assert not r.text_presence_gate(clean, clean, targets).first().present
