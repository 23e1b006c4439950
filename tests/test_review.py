"""The review loop with rule-based and function-based models."""

import pandas as pd
from pyspark.sql import functions as F

from panelflow.operators import review as r
from panelflow.plans.review_queries import DigestRenderer, _regions


def work(spark, *rows):
    df = spark.createDataFrame(rows, "work_id bigint, confidences array<double>, mode string, max_attempts int")
    base = df.withColumn("regions", _regions(F.lit(1), F.lit(2)))
    regions = F.transform("confidences", lambda c, i: F.get("regions", F.lit(0)).withField("confidence", c).withField("original", F.concat(F.lit("o"), i.cast("string"))))
    return base.select("work_id", F.md5(F.col("work_id").cast("string")).alias("content_hash"), regions.alias("regions"), "mode", "max_attempts")


def by_id(frame):
    return {x.work_id: x for x in frame.collect()}


def test_outcomes(spark):
    got = by_id(r.review_loop(work(
        spark, (1, [0.9], "automatic", 3), (2, [0.5, 0.3], "automatic", 3), (3, [0.45], "manual", 1), (4, [0.9], "skipped", 0), (5, [0.1], "automatic", 3)), r.RuleReviewer(0.6, 0.08), DigestRenderer()))
    one, two, manual, skipped, empty = (got[i] for i in range(1, 6))
    assert (one.passed, one.attempts, one.final, one.requires_user_review) == (True, 1, "reuse", False)
    assert (two.passed, two.attempts, len(two.regions), two.n_rendered) == (True, 3, 1, 3)
    assert (manual.passed, manual.attempts, manual.requires_user_review, manual.final) == (False, 1, True, "render")
    assert (skipped.passed, skipped.skipped, skipped.attempts, skipped.requires_user_review, skipped.final) == (None, True, 0, False, "render")
    assert (empty.attempts, empty.final, empty.average_confidence) == (0, "none", None)


def test_a_failed_call_keeps_regions_and_bypasses_the_cache(spark):
    got = by_id(r.review_loop(work(spark, (1, [0.9], "automatic", 2), (2, [0.9], "automatic", 1)), r.RuleReviewer(fails=F.col("attempt") == 1), DigestRenderer()))
    assert (got[1].passed, got[1].attempts, got[1].n_rendered, got[1].n_cached) == (True, 2, 2, 0)
    assert (got[2].passed, got[2].summary, got[2].final, got[2].final_bypass) == (False, r.CALL_FAILED, "render", True)


def test_known_renderings_come_from_the_cache(spark):
    items = work(spark, (1, [0.9], "automatic", 3), (2, [0.8], "automatic", 3))
    key = r.cache_key(F.col("content_hash"), r.region_signature(F.col("regions")))
    cache = items.where("work_id = 1").select(key.alias("cache_key"), F.encode(F.lit("old"), "UTF-8").alias("rendered"))
    got = by_id(r.review_loop(items, r.RuleReviewer(), DigestRenderer(), cache))
    assert (got[1].n_cached, got[1].n_rendered, got[2].n_cached, got[2].n_rendered) == (1, 0, 0, 1)


def test_signature_follows_content_and_order(spark):
    items = work(spark, (1, [0.9, 0.8], "a", 1), (2, [0.9, 0.8], "a", 1), (3, [0.8, 0.9], "a", 1))
    sig = {x.work_id: x.s for x in items.select("work_id", r.region_signature(F.col("regions")).alias("s")).collect()}
    assert sig[1] == sig[2] != sig[3]


def test_function_models(spark):
    def review(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["work_id"] == 2).any():
            raise RuntimeError("model down")
        return pd.DataFrame({"work_id": batch["work_id"], "passed": [True] * len(batch), "summary": "fine", "issues": [[]] * len(batch), "regions": batch["regions"]})

    items = work(spark, (1, [0.9], "automatic", 3)).repartition(1)
    got = by_id(r.review_loop(items, r.FunctionReviewer(review), r.FunctionRenderer(lambda b: b["cache_key"].map(str.encode))))
    assert got[1].passed and got[1].summary == "fine"
    failed = by_id(r.review_loop(work(spark, (2, [0.9], "automatic", 1)), r.FunctionReviewer(review), DigestRenderer()))
    assert failed[2].passed is False and failed[2].issues == [r.CALL_FAILED_ISSUE]

    texts = spark.createDataFrame([(1, "b a"), (2, "")], "id bigint, original string")
    upper = r.FunctionTranslator(lambda b: b.assign(translated=b["original"].str.upper())).translate(texts)
    assert {x.id: x.translated for x in upper.collect()} == {1: "B A", 2: ""}
    lexicon = spark.createDataFrame([("a", "가"), ("a", "나")], "token string, target string")
    assert {x.id: x.translated for x in r.LexiconTranslator(lexicon).translate(texts).collect()} == {1: "b 가", 2: ""}


def test_cancelled_items_take_no_part(spark):
    items = work(spark, (1, [0.9], "automatic", 3), (2, [0.9], "automatic", 3)).withColumn("cancelled", F.col("work_id") == 2)
    assert set(by_id(r.review_loop(items, r.RuleReviewer(), DigestRenderer()))) == {1}


def test_every_item_comes_out_once(spark):
    items = work(spark, *[(i, [0.5], "automatic", n) for i, n in enumerate((0, None, 1, 5, 6, 9))])
    never = r.RuleReviewer(0.99, 0.0)
    key = r.cache_key(F.col("content_hash"), r.region_signature(F.col("regions")))
    cache = items.where("work_id = 4").select(key.alias("cache_key"), F.encode(F.lit("old"), "UTF-8").alias("rendered"))
    got = r.review_loop(items, never, DigestRenderer(), cache.unionByName(cache)).collect()
    assert sorted((x.work_id, x.attempts) for x in got) == [(0, 0), (1, r.DEFAULT_ATTEMPTS), (2, 1), (3, 5), (4, 6), (5, 9)]
    assert {x.n_cached for x in got if x.work_id == 4} == {1}


def test_a_missing_or_failing_rendering_is_a_failed_call(spark):
    def render(batch):
        if (batch["content_hash"].str.len() > 0).any():
            raise RuntimeError("no picture")

    items = work(spark, (1, [0.9], "automatic", 2), (2, [0.9], "automatic", 1))
    for renderer in (r.FunctionRenderer(render), DigestRenderer(F.lit(True))):
        got = by_id(r.review_loop(items, r.RuleReviewer(), renderer))
        assert [(got[i].passed, got[i].attempts, got[i].summary, got[i].final, got[i].n_rendered) for i in (1, 2)] == [
            (False, 2, r.CALL_FAILED, "render", 0), (False, 1, r.CALL_FAILED, "render", 0)]


def test_no_number_is_not_reliable(spark):
    got = by_id(r.review_loop(work(spark, (1, [float("nan"), 0.9], "automatic", 1)), r.RuleReviewer(), DigestRenderer()))
    assert len(got[1].regions) == 1 and got[1].average_confidence == 0.9


def test_equal_and_null_keys_keep_their_translation(spark):
    texts = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "c")], "id bigint, original string")
    lexicon = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "token string, target string")
    got = sorted((x.id or 0, x.original, x.translated) for x in r.LexiconTranslator(lexicon).translate(texts).collect())
    assert got == [(0, "a", "A"), (0, "b", "B"), (1, "a", "A"), (1, "c", "C")]


def test_a_bad_row_fails_alone(spark):
    def translate(batch):
        if (batch["original"] == "bad").any():
            raise ValueError("no such word")
        return batch.assign(translated=batch["original"].str.upper())

    texts = spark.createDataFrame([(k, "bad" if k in (7, 31) else f"t{k}") for k in range(50)], "id int, original string").coalesce(1)
    got = {t.id: (t.translated, t.error) for t in r.FunctionTranslator(translate).translate(texts).collect()}
    assert got == {k: (None, "ValueError: no such word") if k in (7, 31) else (f"T{k}", None) for k in range(50)}

    def review(batch):
        if (batch["work_id"] == 3).any():
            raise RuntimeError("down")
        return pd.DataFrame({"work_id": batch["work_id"], "passed": True, "summary": "", "issues": [[]] * len(batch), "regions": batch["regions"]})

    pending = spark.range(20).selectExpr("id work_id", f"cast(array() as {r.REGIONS_TYPE}) regions").coalesce(1)
    assert sorted((a.work_id, a.error) for a in r.FunctionReviewer(review).review(pending).collect()) == [(k, "RuntimeError: down" if k == 3 else None) for k in range(20)]


def test_words_are_not_shuffled_beside_a_small_lexicon(spark):
    texts = spark.createDataFrame([(1, "b a"), (2, "")], "id bigint, original string")
    lexicon = spark.range(1).selectExpr("'a' token", "'A' target")
    plan = r.LexiconTranslator(lexicon).translate(texts)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(__row" in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)
