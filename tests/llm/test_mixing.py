from collections import Counter, defaultdict

import pytest
from llm.cases import WORD, awkward, empty, rows

from panelflow.llm.mixing import mix, mixed_documents, targets


def shares(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Clamp, share the excess again by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    told, free = {}, set(names)
    while True:
        left = budget * sum(sizes.values()) - sum(told.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if now[s] > most * sizes[s]}
        if not above:
            return told | now
        told |= {s: most * sizes[s] for s in above}
        free -= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, "c": 7, None: 90}, {"a": 0, "b": 5}, {"x": 9}, {f"s{i}": i * i for i in range(40)}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want = shares(sizes)
    for s, _, target in rows(targets(df)):
        assert target == pytest.approx(want[s])


def test_budget_beyond_all_caps(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4)], "source string, source_size bigint")
    assert sorted(rows(targets(df, budget=5.0), "source", "target")) == [("a", 6.0), ("b", 8.0)]


def mixture(spark):
    extra = [(100 + i, " ".join(f"w{j}" for j in range(1 + i * 7 % 60)), f"s{i % 4 if i % 3 else 0}") for i in range(900)]
    return awkward(spark, extra)


def test_takes_what_it_should(spark):
    df = mixture(spark)
    sizes = defaultdict(int)
    for source, text in rows(df, "source", "text"):
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = shares(sizes), defaultdict(int)
    source_of = {i: s for i, s in rows(df, "doc_id", "source") if i is not None and i > 4}
    got = rows(mix(df))
    assert len(got) == df.count()
    for i, size, source_size, target, words in got:
        assert 0 <= words <= 2 * size
        if i in source_of:
            assert source_size == sizes[source_of[i]] and target == pytest.approx(want[source_of[i]])
            taken[source_of[i]] += words
    for source in ("s0", "s1", "s2", "s3", "long", "ü"):
        assert taken[source] == round(want[source])
    assert sorted(got, key=str) == sorted(rows(mix(df.repartition(11))), key=str)  # whatever the order of the rows


def test_rows_of_the_mix(spark):
    df = mixture(spark)
    words = defaultdict(int)
    for i, size, _, _, taken in rows(mix(df)):
        words[i] += taken
    mixed = mixed_documents(df, length="n_chars")
    assert mixed.columns == df.columns and mixed.dtypes == df.dtypes
    found = defaultdict(int)
    for i, text in rows(mixed, "doc_id", "text"):
        found[i] += len(WORD.findall(text or ""))
    assert {i: n for i, n in found.items() if n} == {i: n for i, n in words.items() if n}


def test_rows_without_words_keep_the_cap(spark):
    texts = [(i, None if i % 2 else "", "small") for i in range(40)] + [(50, "a b c", "small")] + [(100 + i, "w " * 40, "large") for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    times = Counter(i for (i,) in rows(mixed_documents(df), "doc_id"))
    assert max(times.values()) <= 2 and times[50] == 2


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr("panelflow.session.ROWS_PER_FILE", 9)  # many blocks
    sizes = {f"s{i:03}": 7 * i * i % 101 + i % 3 for i in range(200)} | {None: 12}
    want = shares(sizes)
    got = rows(targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")), "source", "target")
    assert len(got) == len(sizes) and all(t == pytest.approx(want[s]) for s, t in got)


def test_empty(spark):
    assert mix(empty(spark)).collect() == [] and mixed_documents(empty(spark)).collect() == []
