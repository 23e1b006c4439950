import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import awkward, empty, rows
from tokenizers import Tokenizer

from panelflow.llm.bpe import WordBpe, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), WordBpe(PATH)


def ids_of(text):
    words = OWN.pieces(text)
    OWN.learn([words])
    return [i for w in words for i in OWN.known[w]]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'sS tredlmΣİıéàÀßfí̧ẞ12٣①!?…‍👍🏽한국日本 \t\n\x1c\x85͸") | st.characters(exclude_categories=["Cs"])) | st.lists(
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "'LL", "word", " "])).map("".join))
def test_like_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_and_repeating_words():
    for text in ("a" * 5_000, "ab" * 3_000, "aaaab" * 700, "é" * 999):
        assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    df = awkward(spark)
    got = encode(df, PATH, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    want = []
    for i, text in rows(df, "doc_id", "text"):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        told = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), told, hashlib.sha256(told.encode()).hexdigest()))
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    again = decode(got.select("doc_id", "ids"), PATH)
    assert sorted(rows(again, "doc_id", "decoded"), key=str) == sorted(((w[0], w[4]) for w in want), key=str)


def test_empty(spark):
    assert encode(empty(spark), PATH).collect() == []
