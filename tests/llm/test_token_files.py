import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import awkward, empty, rows
from tokenizers import Tokenizer

from panelflow.llm.elias_fano import EliasFano
from panelflow.llm.token_files import LibraryEncoder, TokenFile, read_token_files, token_file_report, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), LibraryEncoder(PATH)


@given(st.lists(st.integers(-(1 << 40), 1 << 40), max_size=700), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, data):
    values = np.sort(np.array(values, np.int64))
    code, end = EliasFano.from_bytes(b"--" + EliasFano.of(values).to_bytes(), 2)
    assert end == len(EliasFano.of(values).to_bytes()) + 2
    assert (code.slice(0, len(values)) == values).all()
    if len(values):
        i = data.draw(st.integers(0, len(values) - 1))
        assert code.select(i) == values[i] and (code.slice(i, i + 300) == values[i:i + 300]).all()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2_000, 50_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 / 50_000 < 2.6 + np.log2(ends[-1] / 50_000)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sS tredlmΣé12٣①!?…👍🏽한日 \t\n\x1c\x85\xa0͸") | st.characters(exclude_categories=["Cs"])) | st.lists(
    st.sampled_from(["<|endoftext|>", "  ", "'ll", "word", " x"])).map("".join))
def test_like_the_library(text):
    assert np.frombuffer(OWN.encode([text])[0], "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def wanted(df):
    told = sorted(rows(df, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in told]


def test_files_and_what_they_hold(spark, tmp_path):
    df = awkward(spark)
    files = write_token_files(df.repartition(5), PATH, str(tmp_path / "ids"), 2, shards=4)
    got = sorted(rows(read_token_files(files)), key=lambda r: r[1])
    want = wanted(df)
    assert [r[0] for r in got] == [i for i, _ in want]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert sorted(map(str, ((r[0], r[3]) for r in got))) == sorted(map(str, want))
    first = files.orderBy("shard").first()
    file = TokenFile(first.path)
    assert [file.document(k).tolist() for k in range(file.n_docs)] == [r[3] for r in got[:file.n_docs]]
    assert not [p for p in (tmp_path / "ids").iterdir() if p.suffix == ".ids"]


def test_files_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    files = write_token_files(docs, PATH, str(tmp_path / "ids"), 2, shards=8)
    found = read_token_files(files).withColumn("task", F.spark_partition_id())
    assert files.count() == 8 and found.select("task").distinct().count() == 8 and found.count() == 400


def test_report(spark):
    df = awkward(spark)
    got = rows(token_file_report(df, PATH, 2))
    want = wanted(df)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert max(r[1] + r[2] for r in got) == sum(len(x) for _, x in want)


def test_empty(spark):
    assert token_file_report(empty(spark), PATH, 2).collect() == []
