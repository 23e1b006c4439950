import random

import corpus_pipeline
import numpy as np
import pytest
from llm.cases import WORD, awkward, components, lowered, rows

from panelflow.llm.simhash import _reached, drop_near_copies, fingerprint_links


def shingles(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_only_shared_shingles_count(spark, block):
    rng = random.Random(7)
    base = [f"term{i}" for i in range(300)]
    shuffled = rng.sample(base, len(base))  # the same words, so the same fingerprint, but other shingles
    found = [base, shuffled, base[:-1], shuffled[1:]]
    for k in range(12):  # few and many changed words, from alike to apart
        found.append([w if rng.random() > 0.004 * k else f"edit{k}" for w in base])
    df = awkward(spark, [(100 + k, " ".join(w), "n") for k, w in enumerate(found)])
    texts = rows(df, "doc_id", "text")
    parts = {tuple(p) for p in components([shingles(t) for _, t in texts], linked=near)}
    want = sorted(min(texts[i][0] for i in p if texts[i][0] is not None) for p in parts)
    left = drop_near_copies(df, block=block)
    assert left.columns == df.columns and sorted(i for (i,) in rows(left, "doc_id")) == want
    assert {100, 101} <= set(want) and not {102, 103} & set(want)


def test_chains_are_followed():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randint(0, 40) for _ in range(rng.choice([0, 20, 60, 90]))], np.uint64)) for _ in range(80)]
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in _reached(sets):
        assert near(set(sets[i].tolist()), set(sets[j].tolist()))
        parent[top(i)] = top(j)
    full = [k for k in range(len(sets)) if len(sets[k])]
    for place, part in zip(full, components([set(sets[k].tolist()) for k in full], linked=near)):
        assert {full[k] for k in part} == {k for k in full if top(k) == top(place)}


@pytest.mark.parametrize("limit", [5, 32_768])
def test_every_pair_within_reach_meets(spark, limit):
    rng = random.Random(4)
    pairs = [(m, m ^ sum(1 << b for b in rng.sample(range(128), 14))) for m in (rng.getrandbits(128) for _ in range(60))]
    centre = rng.getrandbits(128)
    crowd = sorted({centre ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 12))) for _ in range(60)})
    marks = crowd + [m for p in pairs for m in p]
    signed = [tuple(w - (1 << 64) if w >> 63 else w for w in (m & (1 << 64) - 1, m >> 64)) for m in marks]
    links = rows(fingerprint_links(spark.createDataFrame(signed, "mark bigint, more bigint"), limit, 14), "u", "u_more", "v", "v_more")
    whole = lambda a, b: a & (1 << 64) - 1 | (b & (1 << 64) - 1) << 64
    joined = {(whole(a, b), whole(c, d)) for a, b, c, d in links}
    assert all((u ^ v).bit_count() <= 14 for u, v in joined)
    assert all((u, v) in joined or (v, u) in joined for u, v in pairs)
    place = {m: k for k, m in enumerate(marks)}
    linked = {frozenset((place[u], place[v])) for u, v in joined}
    by_links = components(list(range(len(marks))), linked=lambda i, j: frozenset((i, j)) in linked)
    assert {tuple(p) for p in by_links} == {tuple(p) for p in components(marks, distance=14)}


def test_stage_by_shingles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = corpus_pipeline.exact(spark, corpus_pipeline.quality(spark, docs, ""), "")
    order = sorted(rows(before, "doc_id", "text"))
    want = {order[min(p)][0] for p in components([shingles(t) for _, t in order], linked=near)}
    assert {i for (i,) in rows(corpus_pipeline.near(spark, before, ""), "doc_id")} == want and len(want) < len(order)
