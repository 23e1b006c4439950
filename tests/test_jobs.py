"""Whole jobs on small inputs."""

from pyspark.sql import functions as F
from test_raster import picture, size
from test_regions import GOOD

from panelflow.functions.color import rgb
from panelflow.plans import jobs


def test_clean_regions(spark):
    near = GOOD.replace("[1,2,3,4]", "[100,100,500,500]")
    texts = [near, near.replace("0.5", "0.9").replace("500,500", "501,500"), near.replace("0.5", "0.2"), near.replace('"sfx"', "1"), near.replace('"translated":"t"', '"translated":" "')]
    answers = spark.createDataFrame([(1, '{"regions":[' + ",".join(texts) + "]}"), (2, "x")], "image_id bigint, output string")
    regions, quarantine = jobs.clean_regions(answers, F.lit(1000), F.lit(1000))
    assert [(r.image_id, r.slot_ord, r.ord, r.right) for r in regions.collect()] == [(1, 1, 2, 501)]
    assert {(r.image_id, r.ord): r.violations for r in quarantine.collect()} == {(1, 3): ["unreliable"], (1, 4): ["type:regionKind"], (2, None): ["invalid_json"]}


def test_status_and_harvest(spark):
    lines = spark.createDataFrame([(1, "[10:00:00] [작업 #1 · 이미지 #2] ZIP 이미지 저장 확인 · <zip>")], "seq bigint, line string")
    assert [(r.row_key, r.state) for r in jobs.status(lines).collect()] == [("zip:2", "done")]
    pages = spark.createDataFrame([(1, "http://h/a/", '<img src="x.png" width="10" height="10"><img src="y.png" width="500" height="500"><img src="z.png" style="display:none">')], "page_id bigint, url string, html string")
    seen = spark.createDataFrame([(1, "http://h/a/q.png")], "page_id bigint, source_url string")
    none = F.lit(None).cast("double")
    assert [(r.source_url, r.small) for r in jobs.harvest(pages, seen, none, none).orderBy("position").collect()] == [("http://h/a/x.png", True), ("http://h/a/y.png", False)]


def test_screen_pages(spark):
    def value(x, y):
        return F.when(x.between(40, 44) & y.between(40, 54), 0).otherwise(255)

    pixels = picture(spark, 100, 100, value)
    regions = spark.range(1).select(
        F.lit(1).cast("bigint").alias("image_id"), F.lit(1).cast("bigint").alias("ord"), F.lit("dialogue").alias("region_kind"), F.lit(20.0).alias("font_px"), F.lit(0.0).alias("stroke_px"),
        *[F.lit(v).alias(n) for n, v in zip(("left", "top", "right", "bottom", "layout_left", "layout_top", "layout_right", "layout_bottom"), (10, 10, 90, 90) * 2)],
        F.lit(False).alias("background_complex"), F.lit("vertical").alias("orientation"), rgb(17, 17, 17).alias("text_rgb"), rgb(255, 255, 255).alias("stroke_rgb"),
        rgb(255, 255, 255).alias("background_rgb"), F.lit(100).alias("image_width"), F.lit(100).alias("image_height"))
    tiles, components, summary = jobs.screen_pages(pixels, size(spark, 100, 100), regions)
    assert tiles.count() == 0 and [c.area for c in components.collect()] == [75]
    assert summary.first().safe
