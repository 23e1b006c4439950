from llm.cases import awkward, empty, quality, rows

from panelflow.llm.quality import clean_lines, drop_low_quality, quality_report

NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
GOOD = " ".join(f"Sentence{i} has its own{i} words{i} here." for i in range(20))
EXTRA = [
    (20, GOOD, "q"), (21, GOOD + "\nHome\nNews\nAbout us", "q"), (22, "\n".join(f"Menu{i} | item{i} | more{i} | last{i}" for i in range(30)), "q"),
    (23, "\n".join(f"SALE{i}!! NOW{i}!! BUY{i}!! THIS{i}!! HERE{i}!!" for i in range(30)), "q"), (24, GOOD + "\n" + GOOD, "q"),
    (25, "\n".join(f"Copyright {i} of firm{i} in city{i}, all rights reserved by them{i} for good{i}." for i in range(9)), "q"),
    (26, "a b c a b c " + GOOD + " # $ % <b>", "q"), (27, "\r\n".join([GOOD, "", GOOD, "\x0b"]), "q"),
]


def test_against_plain_version(spark):
    df = awkward(spark, EXTRA)
    want = [(i, *quality(t)) for i, t in rows(df, "doc_id", "text")]
    assert sorted(rows(quality_report(df), *NAMES), key=str) == sorted(want, key=str)


def test_line_rules_decide(spark):
    kept = {i for i, k in rows(quality_report(awkward(spark, EXTRA)), "doc_id", "kept") if k}
    assert {20, 21} <= kept and not kept & {22, 23, 24, 25}


def test_drop_and_clean(spark):
    df = awkward(spark, EXTRA)
    left = drop_low_quality(df, clean=True)
    assert left.columns == df.columns
    texts = dict(rows(left, "doc_id", "text"))
    assert texts[21] == GOOD and texts[20] == GOOD
    assert rows(spark.createDataFrame([("Home\n\nA whole line that ends as it should.",)], "t string").select(clean_lines("t").alias("t"))) == [
        ("\nA whole line that ends as it should.",)]


def test_empty(spark):
    assert quality_report(empty(spark)).collect() == [] and drop_low_quality(empty(spark)).collect() == []


def test_plan_is_native(spark):
    plan = quality_report(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
