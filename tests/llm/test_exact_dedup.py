import hashlib
from collections import defaultdict

import pytest
from llm.cases import awkward, empty, lowered, rows

from panelflow.llm.exact_dedup import _digest, drop_exact_duplicates, exact_dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in, parts", [(2, 7), (16, 3)])
def test_against_grouping(spark, keep, fan_in, parts):
    df = awkward(spark)
    groups = defaultdict(list)
    for i, text in rows(df, "doc_id", "text"):
        groups[lowered(text)].append(i)
    got = rows(exact_dedup(df.repartition(parts), keep=keep, fan_in=fan_in))
    assert len(got) == df.count()
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r[4] == sha]
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        assert sorted((r[0] is None, r[0]) for r in own) == sorted((i is None, i) for i in ids)
        assert {(r[1], r[2]) for r in own} == {(best, len(ids))}
        assert [r[0] for r in own if r[3]] == [best]  # one row, also of repeated ones


def test_drop_keeps_columns_and_one_row(spark):
    df = awkward(spark)
    left = drop_exact_duplicates(df.repartition(4))
    assert left.columns == df.columns
    assert sorted(lowered(t) for (t,) in rows(left, "text")) == sorted({lowered(t) for (t,) in rows(df, "text")})


def test_empty(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert drop_exact_duplicates(empty(spark)).collect() == []


def test_many_copies_over_many_runs(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text").repartition(40)
    got = exact_dedup(df, fan_in=4)
    assert got.filter("kept").count() == 20_000 - 6_667 + 1
    assert rows(got.filter("group_size > 1"), "keep_id", "group_size")[0] == (0, 6_667)


def test_entries_of_one_digest_differ_by_check():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"uid": [1, 2], "body": pa.array([b"AB", b"ab"], pa.binary())})
    (told,) = _digest([batch])
    assert told.column("sha")[0] == told.column("sha")[1] and told.column("check")[0] == told.column("check")[1]
