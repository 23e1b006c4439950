import random

import numpy as np
import pytest
from llm.cases import WORD, awkward, components, empty, lowered, rows

from panelflow.llm.shingle_join import _Words, linked, shingle_join, shingle_sets, taken


def shingles(text, width):
    words = WORD.findall(lowered(text))
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(table, width, percent):
    sets = [shingles(t, width) for _, t in table]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    found = []
    for (i, _), own, reach in zip(table, sets, components(sets, linked=near)):
        ids = [table[j][0] for j in reach if table[j][0] is not None]
        found.append((i, len(own), min(ids) if ids and own else i))
    return sorted(found, key=str)


def family(seed, n, length, edits, line=()):
    """Copies of one text with a few words changed, each with a line that many share."""
    rng = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(length)]
    made = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"edit{rng.random()}"
        made.append(" ".join([*words, *line]))
    return made


@pytest.mark.parametrize("width, percent, block", [(3, 90, 1 << 20), (3, 90, 500), (5, 80, 1 << 20), (1, 50, 1 << 20), (2, 100, 1 << 20)])
def test_against_all_pairs(spark, width, percent, block):
    line = [f"common{k}" for k in range(12)]
    texts = family(1, 40, 150, 6, line) + family(2, 10, 60, 3, line) + family(3, 12, 400, 15) + family(4, 8, 12, 1) + family(5, 6, 30, 2, line * 3)
    texts += [" ".join(f"own{j}-{k}" for k in range(80)) + " " + " ".join(line) for j in range(15)]
    rng = random.Random(8)
    for size in (9, 10, 11, 19, 20, 21):  # at the very threshold, from both sides
        base = [f"t{size}-{k}" for k in range(size + width - 1)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join([*base, "more", "again"]), " ".join(base[1:])]
    ids = rng.sample(range(100, 100 + len(texts)), len(texts))
    df = awkward(spark, [(i, t, "n") for i, t in zip(ids, texts)])
    found = shingle_join(df, width=width, percent=percent, block=block)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(rows(found), key=str) == plain(rows(df, "doc_id", "text"), width, percent)


def test_empty(spark):
    assert shingle_join(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, None)], "doc_id int, text string")
    assert sorted(rows(shingle_join(blank)), key=str) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)]


def test_words_and_repeats():
    texts = ["A b a B  a\tb c", "a b A b a b c", "É x y z", "É X\x0bY z", "é x y z", "one two", None, "", " \n", "x"]
    sets = shingle_sets([t and t.encode() for t in texts], 3, _Words())
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all()
    assert len(np.intersect1d(sets[2], sets[4])) == 1 and shingle_sets([], 3, _Words()) == []


@pytest.mark.parametrize("percent", [50, 80, 90, 95, 100])
def test_linked_sets_share_what_an_order_takes(percent):
    rng = random.Random(percent)
    for _ in range(3000):
        common = rng.sample(range(10_000), rng.randint(1, 60))
        sets = [set(common) | set(rng.sample(range(10_000 * k, 10_000 * (k + 1)), rng.randint(0, 8))) for k in (1, 2)]
        if 100 * len(sets[0] & sets[1]) < percent * len(sets[0] | sets[1]):
            continue
        heads = [set(sorted(s, key=lambda x: hash((x, 5)))[:taken(len(s), percent)[0]]) for s in sets]
        assert all(len(heads[0] & heads[1]) >= taken(len(s), percent)[1] >= 1 for s in sets)


def test_only_candidates_are_verified():
    same = [np.arange(20), np.arange(20), np.arange(1, 21)]
    every = [np.array([1]), np.array([1]), np.array([1])]
    assert sorted(linked(same, [every, every], 90)) == [(0, 1), (0, 2)]
    apart = [np.array([1]), np.array([2]), np.array([1])]
    assert sorted(linked(same, [every, apart], 90)) == [(0, 2)]
