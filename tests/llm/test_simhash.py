import random

import pytest
from llm.cases import awkward, components, empty, rows, simhash

from panelflow.llm.simhash import drop_near_duplicates, fingerprint_links, simhash_dedup, word_fingerprint


@pytest.mark.parametrize("limit", [2, 32_768])
def test_against_all_pairs(spark, limit):
    base = [f"term{i}" for i in range(200)]
    rng = random.Random(5)
    extra = [(100 + k, " ".join(w if rng.random() > 0.01 else "changed" for w in base), "n") for k in range(25)]
    df = awkward(spark, extra)
    texts = rows(df, "doc_id", "text")
    marks = [simhash(t, 4) for _, t in texts]
    want = []
    for (i, _), mark, reach in zip(texts, marks, components(marks)):
        ids = [texts[j][0] for j in reach if texts[j][0] is not None]
        want.append((i, f"{mark:016x}", min(ids) if ids else None))
    key = lambda r: (r[1], r[0] is None, r[0])
    assert sorted(rows(simhash_dedup(df, width=4, limit=limit)), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("limit", [3, 60, 32_768])
def test_dense_and_sparse_fingerprints(spark, limit):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    marks = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(250)}
    marks |= {rng.getrandbits(64) for _ in range(200)} | {0, 15, (1 << 64) - 1}
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    links = rows(fingerprint_links(spark.createDataFrame([(m,) for m in signed], "mark bigint"), limit), "u", "v")
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in links)
    parent = {m: m for m in signed}

    def top(m):
        while parent[m] != m:
            m = parent[m]
        return m
    for u, v in links:
        parent[top(u)] = top(v)
    for i, reach in enumerate(components(marks)):
        assert {signed[j] for j in reach} == {m for m in signed if top(m) == top(signed[i])}


@pytest.mark.parametrize("limit", [3, 32_768])
def test_drop_leaves_one_of_each(spark, limit):
    rng = random.Random(3)
    bases = [[f"doc{b}word{i}" for i in range(300)] for b in range(6)]
    extra = [(100 + 50 * b + k, " ".join(w if rng.random() > 0.015 else f"edit{rng.random()}" for w in base), "n") for b, base in enumerate(bases) for k in range(20)]
    df = awkward(spark, extra)
    left = drop_near_duplicates(df, limit=limit)
    texts = rows(df, "doc_id", "text")
    marks = [like_marks(t) for _, t in texts]
    parts = {tuple(reach) for reach in components(marks, linked=alike)}
    assert left.columns == df.columns and left.count() == len(parts)
    ids = [i for (i,) in rows(left, "doc_id") if i is not None and i >= 100]
    assert sorted(i // 50 for i in ids) == list(range(2, 8)) and {i % 50 for i in ids} == {0}  # the smallest of each


def alike(a, b):
    """Within 14 of 128 bits: eight segments with one bit wiped out find every such pair."""
    return (a ^ b).bit_count() <= 14


def like_marks(text):
    raw = (text or "").encode()
    return word_fingerprint(raw) | word_fingerprint(raw, 43) << 64


def test_empty(spark):
    assert simhash_dedup(empty(spark)).collect() == []
    assert drop_near_duplicates(empty(spark)).collect() == []
