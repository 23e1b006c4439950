"""Page harvest corner cases."""

from pyspark.sql import functions as F

from panelflow.operators import pages as p

BASE = "https://h.example/a/b?x=1"


def harvest(spark, html):
    rows = p.harvest_images(spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")).orderBy("position").collect()
    return [(r.element, r.source_url) for r in rows]


def test_elements_in_document_order(spark):
    html = """<html style="background:url(no.png)"><body style='background:url(no.png)'><p title="<img src='no.png'>">x</p><IMG alt="a > b" data-src=lazy.png
      src=''><div style="color:red;background-image:url(&quot;q.png&quot;)"></div><canvas></canvas><!-- <img src=c.png> --><style>a{background:url(s.png)}</style>
      <img srcset=" s1.png 2x, s2.png"><svg/><img></body></html>"""
    assert harvest(spark, html) == [
        ("img", "https://h.example/a/lazy.png"), ("div", "https://h.example/a/q.png"), ("canvas", "canvas:"), ("img", "https://h.example/a/s1.png"),
        ("svg", "inline-svg:"), ("img", "screen-capture:")]


def test_size_and_visibility(spark):
    none = F.lit(None).cast("double")
    df = spark.createDataFrame([(120, 80), (119, 80), (60, 40), (None, 90)], "w bigint, h bigint")

    def kept(w, h, force=None):
        return [r.w for r in df.where(p.big_enough(F.col("w"), F.col("h"), w, h, force)).collect()]

    assert kept(none, none) == [120] and kept(F.lit(10.0), F.lit(10.0)) == [120, 119, 60] and kept(none, none, F.lit(True)) == [120, 119, 60, None]
    seen = spark.sql("select 'visible' v, 'inline' d, 0.05D o union all select 'hidden','inline',1D union all select 'visible','none',1D union all select 'visible','block',0.06D")
    assert [r.d for r in seen.where(p.visible(F.col("v"), F.col("d"), F.col("o"), F.lit(None).cast("boolean"))).collect()] == ["block"]


def test_rounds_and_summary(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 2), (3, "z", 5)], "page_id bigint, source_url string, appears int")
    calls = []

    def process(shown):
        calls.append(shown.count())
        return shown.select("page_id", "source_url", F.lit(False).alias("skipped_small"), F.when(F.col("page_id") == 2, "Failed to fetch").alias("error"), F.lit(2).alias("regions"))

    got = {r.page_id: r for r in p.page_summary(p.rescan_rounds(rows, process)).collect()}
    assert calls == [2, 1, 0] and set(got) == {1, 2}
    assert (got[1].processed, got[1].translated, got[1].phrases, got[1].run_failed) == (2, 2, 4, False)
    assert (got[2].processed, got[2].failed, got[2].run_failed) == (1, 1, True)


def test_candidates_are_found_once_for_all_rounds(spark):
    found = spark.sparkContext.accumulator(0)

    def find(batches):
        for batch in batches:
            found.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 2)], "page_id bigint, source_url string, appears int")
    done = p.rescan_rounds(rows.mapInPandas(find, rows.schema), lambda shown: shown.select("page_id", "source_url", F.lit(None).cast("string").alias("error")))
    assert done.count() == 3 and found.value == 3
