import hashlib
import random
from collections import Counter
from contextlib import contextmanager

import pytest
from llm.cases import WORD, awkward, empty, rows

import panelflow.llm.substring_dedup as module
from panelflow.llm.substring_dedup import repeated_suffixes, substring_dedup


def plain(texts, window):
    texts = [(i, WORD.findall(t or "")) for i, t in texts]
    seen = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    told = Counter()
    for i, words in texts:
        gone = {k + j for k in range(len(words) - window + 1) if seen[tuple(words[k:k + window])] > 1 for j in range(window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        told[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return told


@contextmanager
def watched(label):
    """The written tables of this label."""
    found, plain_write = [], module.materialize
    def write(df, name):
        table = plain_write(df, name)
        if name == label:
            found.append(table)
        return table
    module.materialize = write
    try:
        yield found
    finally:
        module.materialize = plain_write


@pytest.mark.parametrize("limit", [20, 65_536])
def test_awkward_rows(spark, limit):
    passage = " ".join(f"shared{i}" for i in range(50))
    df = awkward(spark, [(40 + k, f"own{k} start{k} {passage} end{k} of{k}", "p") for k in range(8)])
    got = Counter(rows(substring_dedup(df, outputs=("kept_sha256",), group_limit=limit)))
    assert got == plain(rows(df, "doc_id", "text"), 35)


@pytest.mark.parametrize("window, gram, limit, letters", [(7, 3, 65_536, "ab"), (7, 3, 9, "ab"), (5, 5, 65_536, "abcd"), (6, 1, 2, "abc"), (9, 4, 5, "a")])
def test_random_texts(spark, window, gram, limit, letters):
    rng = random.Random(window * 100 + limit)
    texts = [(rng.choice([None, 1, k]), None if k % 9 == 0 else " ".join(rng.choices(letters, k=rng.randint(0, 45)))) for k in range(50)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = Counter(rows(substring_dedup(df, window=window, gram=gram, outputs=("kept_sha256",), group_limit=limit)))
    assert got == plain(texts, window)


def test_work_grows_with_equal_rows(spark):
    """Each of the rows that repeat identifier and text fetches its own suffixes, not those of all of them."""
    text = " ".join(f"w{k % 97}x{k % 13}" for k in range(400))
    runs = []
    for copies in (10, 40):
        df = spark.createDataFrame([(None, text)] * copies, "doc_id bigint, text string")
        with watched("runs") as written:
            assert rows(substring_dedup(df, outputs=()), "n_words", "n_removed") == [(400, 400)] * copies
        runs.append(written[0].count())
    assert runs[1] == 4 * runs[0]


def test_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "x a b c y"), (2, "a b c z")], "doc_id bigint, text string")
    got = rows(substring_dedup(df, window=3, gram=2))
    assert sorted((i, n, gone, kept, [tuple(s) for s in spans]) for i, n, gone, kept, spans in got) == [(1, 5, 3, "x y", [(1, 4)]), (2, 4, 3, "z", [(0, 3)])]


def test_tree_of_one_group():
    found = repeated_suffixes([b"a b c d", b"b c d e", b"a b c x"], 3)
    assert [f.tolist() for f in found] == [[True, True], [True, False], [True, False]]


def test_empty(spark):
    assert substring_dedup(empty(spark)).collect() == []
