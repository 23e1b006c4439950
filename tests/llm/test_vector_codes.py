import hashlib
import math
import random

import duckdb
import pytest
from llm.cases import rows

from panelflow.llm.vector_codes import part_bounds, vector_codes, vector_codes_sql

SCHEMA = "vec_id bigint, embedding array<float>, label string, error string, code int, labels int, vec int, of int, n string"


def plain(table, parts=8, entries=16, rounds=6):
    """Every step on Python's integers."""
    finite = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in table if finite(v)]
    sizes = {}
    for _, v, _ in kept:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    width = max(sizes, key=lambda s: (sizes[s], s))
    kept = sorted((r for r in kept if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bounds = part_bounds(width, parts)
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in bounds]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))

    def assign():
        return [[min((square(v[a:b], c), e) for e, c in enumerate(book)) for (a, b), book in zip(bounds, books)] for _, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for k, (a, b) in enumerate(bounds):
            for e in range(len(books[k])):
                own = [v[a:b] for (_, v, _), f in zip(kept, found) if f[k][1] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = assign()
    errors, total = [sum(d for d, _ in f) for f in found], {}
    for (_, _, label), error in zip(kept, errors):
        total[label] = total.get(label, 0) + error
    return [(i, "".join(f"{e:02x}" for _, e in f), error, total[label], digest) for (i, _, label), f, error in zip(kept, found, errors)]


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r))


def table(seed, n, width=24):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(width)] for _ in range(5)]
    made = [(k, [round(c + rng.gauss(0, 0.1), 3) for c in rng.choice(centres)], rng.choice(["a", "b", None])) for k in range(n)]
    made += [made[3], made[3], (None, made[5][1], "b"), (7, made[8][1], None)]  # repeated rows, ties, a null identifier
    bad = [None, [], [None] * width, [float("nan")] + [0.0] * (width - 1), [float("-inf")] * width, [0.5] * (width + 1), [0.25] * 3]
    return made + [(900 + k, v, "bad") for k, v in enumerate(bad)]


def frame(spark, given):
    import numpy as np
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in given]
    return single, spark.createDataFrame([(*r, *[None] * 6) for r in single], SCHEMA)


@pytest.mark.parametrize("n, parts, entries, rounds", [(150, 8, 16, 6), (150, 5, 4, 2), (9, 8, 16, 6), (40, 30, 3, 0)])
def test_against_plain_integers(spark, n, parts, entries, rounds):
    given, df = frame(spark, table(n, n))
    found = vector_codes(df, parts=parts, entries=entries, rounds=rounds)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(rows(found)) == order(plain(given, parts, entries, rounds))


def test_blocks_do_not_matter(spark, monkeypatch):
    given, df = frame(spark, table(4, 300))
    assert order(rows(vector_codes(df.repartition(7)))) == order(rows(vector_codes(df.coalesce(1)))) == order(plain(given))


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], "a"), (2, [-1e30, 0.0], "a"), (3, [1e30, 1.0], "a")], "vec_id bigint, embedding array<double>, label string")
    found = {r[0]: r[1:4] for r in rows(vector_codes(df, parts=1, entries=2, rounds=0))}
    assert found[1] == ("00", 0, 4096**2) and found[3] == ("00", 4096**2, 4096**2) and found[2] == ("01", 0, 4096**2)


def test_nothing_usable(spark):
    _, df = frame(spark, [])
    assert vector_codes(df).collect() == []
    _, df = frame(spark, [(1, None, "a"), (2, [], "b")])
    assert vector_codes(df).collect() == []


def test_sql_twin(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert sorted(rows(vector_codes(spark.read.parquet(path)))) == sorted(con.execute(vector_codes_sql()).fetchall())
