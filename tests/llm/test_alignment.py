import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from llm.cases import awkward, empty, rows
from tokenizers import Tokenizer

from panelflow.llm import alignment
from panelflow.llm.alignment import align, pair_bound
from panelflow.llm.bpe import byte_symbols

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "plain <|endoftext|> text <s> and </s> <unk>", "tabs\tand\nlines\r\n  two blanks ", " leading", "▁ lower block", "日本語 と emoji 👩‍👩‍👧 é é",
    "\x00\x01 control", "a", " ", "   ", "ﬁ ① Å", "don't we'll I'm", "x" * 300, "1234567890 12.5e-3", "Ünï sep  nbsp",
]


def plain(table):
    """Token by token with the two libraries."""
    a_model = Tokenizer.from_file(FIRST)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    counts, docs = Counter(), []
    for i, text in table:
        a, b, ends = [], [], [[], []]
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            parts = [[bytes(byte_of[c] for c in a_model.id_to_token(t)) for t in a],
                     [bytes([int(b_model.id_to_piece(t)[3:5], 16)]) if b_model.is_byte(t) else b_model.id_to_piece(t).replace("▁", " ").encode() for t in b]]
            if any(b"".join(p) != (" " + text).encode() for p in parts):
                a, b = [], []
            else:
                ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] if len(p) < 500 else cumulative(p) for p in parts]
        links, groups, at = [], [], [0, 0]
        both = set(ends[0]) & set(ends[1])
        for end in sorted(both):
            stop = [ends[0].index(end, at[0]) + 1, ends[1].index(end, at[1]) + 1]
            groups.append(",".join(map(str, a[at[0]:stop[0]])) + "|" + ",".join(map(str, b[at[1]:stop[1]])))
            links.append((a[stop[0] - 1], b[stop[1] - 1]))
            at = stop
        counts.update(links)
        docs.append((i, a, b, links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, len(a), len(b), len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(text.encode()).hexdigest() if a else "", text) for i, a, b, links, text in docs]


def cumulative(parts):
    found, end = [], 0
    for p in parts:
        end += len(p)
        found.append(end)
    return found


def test_against_the_libraries(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    df = awkward(spark, [(100 + k, t, "n") for k, t in enumerate(ODD)])
    found = align(df, FIRST, SECOND, groups=True)
    assert found.columns == [*NAMES[:-1], "groups", "groups_sha256"]
    want = [(*r[:7], r[8], r[7]) for r in plain(rows(df, "doc_id", "text"))]
    assert Counter(rows(found)) == Counter(want)
    assert any(r[1] == 0 for r in want if r[0] and r[0] >= 100) and sum(r[5] < r[4] for r in want)


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (Counter(rows(align(d, FIRST, SECOND))) for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many and list(align(docs, FIRST, SECOND).columns) == NAMES
    assert one == Counter(r[:8] for r in plain(rows(docs, "doc_id", "text")))


def test_linked_pairs_are_bounded_by_the_vocabularies(spark):
    assert 0 < pair_bound(FIRST, SECOND) < 400_000
    sides = alignment._sides(FIRST, SECOND)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id int, text string")
    aligned = docs.selectExpr("doc_id", "text body").mapInArrow(
        alignment._aligner(FIRST, SECOND, False), "doc_id int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, "
        "pairs array<int>, counts array<bigint>")
    for pair, n, _ in rows(alignment.pair_counts(aligned)):
        a, b = (side.raw[i] for side, i in zip(sides, divmod(pair, 1 << 15)))
        assert n > 0 and (a.endswith(b) or b.endswith(a))


def test_empty(spark):
    assert align(empty(spark), FIRST, SECOND).collect() == []
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id int, text string")
    assert sorted(rows(align(blank, FIRST, SECOND)), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)
