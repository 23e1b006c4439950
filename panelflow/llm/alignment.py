"""Alignment of two tokenizers over the same bytes, as Arrow tables.

A slice of documents becomes two token tables, one for each tokenizer: ids come as flattened lists with the index of
their parent document, and byte ends as cumulative sums of token lengths that start anew at each document. An Acero
hash join on the key (document, end) gives the links, and the table's ``group_by`` counts them by pair of ids; Spark
merges these partial counts. A second pass looks the merged counts up for every link, which the first pass has stored as pairs.

Two linked tokens end at the same byte, so the bytes of the shorter end those of the longer. That bounds the table of counts by
the vocabularies, whatever the corpus: see :func:`pair_bound`. Only because of this bound it is sent to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.bpe import byte_symbols
from panelflow.llm.token_files import LibraryEncoder
from panelflow.session import materialize, spread

SLICE_BYTES, SLICE_DOCS = 1 << 20, 512  # text in one pair of token tables
_SIDE = 1 << 15  # ids of the second tokenizer are below this: a pair is first * _SIDE + second, below 2**31
_DOC = 40  # bits of a key that hold the byte end


class _ByteBpe:
    """The first tokenizer: byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.coder = LibraryEncoder(path)
        self.coder.library.encode_special_tokens = True
        vocab = self.coder.library.get_vocab()
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t.content for t in self.coder.library.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.coder.encode(texts)
        kind = f"<u{self.coder.width}"
        return np.frombuffer(b"".join(coded), kind).astype(np.int64), np.array([len(c) // self.coder.width for c in coded], np.int64)


class _Pieces:
    """The second tokenizer: sentence pieces, which put a blank in front of a text by themselves."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        if size > _SIDE:
            raise ValueError(f"at most {_SIDE} pieces")
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array(self.model.encode([t[1:] for t in texts], num_threads=1), pa.list_(pa.int64()))
        return pc.list_flatten(coded).to_numpy(zero_copy_only=False), pc.list_value_length(coded).to_numpy(zero_copy_only=False).astype(np.int64)


class _Side:
    """A tokenizer with the lengths and bytes of its tokens, and its ids written out with what may follow them."""

    def __init__(self, coder: _ByteBpe | _Pieces, follow: tuple[str, ...]):
        self.encode = coder.encode
        self.lengths = np.array([len(b) for b in coder.bytes], np.int64)
        self.bytes = pa.array(coder.bytes, pa.binary())
        self.size, self.raw = len(coder.bytes), coder.bytes
        self.written = pa.array([f"{i}{mark}" for mark in follow for i in range(self.size)], pa.string())

    def table(self, texts: list[str]) -> pa.Table:
        """(id, doc, end) of every token, in order."""
        ids, counts = self.encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids))
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(self.lengths[ids])
        before = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]  # where each document's first token begins
        return pa.table({"id": pc.list_flatten(lists), "doc": pa.array(doc), "end": pa.array(ends - before[doc])})

    def joined(self, table: pa.Table, n: int) -> list[bytes]:
        """The bytes of each document's tokens."""
        words = pc.take(self.bytes, table["id"].combine_chunks())
        stops = np.searchsorted(table["doc"].to_numpy(), np.arange(n + 1))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), words), b"").to_pylist()


@lru_cache(maxsize=2)
def _sides(first: str, second: str) -> tuple[_Side, _Side]:
    return _Side(_ByteBpe(first), (",", "|")), _Side(_Pieces(second), (",", ";", ""))


def pair_bound(first: str, second: str) -> int:
    """How many pairs of ids can ever be linked: those where one token's bytes end with the other's."""
    left, right = ({}, {})
    for side, found in zip(_sides(first, second), (left, right)):
        for token in side.raw:
            found[token] = found.get(token, 0) + 1
    longer = sum(n * right.get(t[k:], 0) for t, n in left.items() for k in range(len(t)))
    return longer + sum(n * left.get(t[k:], 0) for t, n in right.items() for k in range(1, len(t)))


def _keys(table: pa.Table) -> np.ndarray:
    return (table["doc"].to_numpy() << _DOC) + table["end"].to_numpy()


def _links(left: pa.Table, right: pa.Table) -> pa.Table:
    """(key, a, b) in order of documents and ends."""
    sides = [pa.table({"key": pa.array(_keys(t)), name: t["id"]}) for t, name in ((left, "a"), (right, "b"))]
    links = sides[0].join(sides[1], keys="key", join_type="inner", use_threads=False)
    return links.take(pc.sort_indices(links, sort_keys=[("key", "ascending")]))


def _groups(sides: tuple[_Side, _Side], left: pa.Table, right: pa.Table, cuts: np.ndarray, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document: both sides' ids, cut where both have an end."""
    keys = [_keys(t) for t in (left, right)]
    group = [np.searchsorted(cuts, k) for k in keys]  # the first cut at or behind a token's end closes its group
    closes = [np.r_[g[1:] != g[:-1], True] for g in group]
    doc = [t["doc"].to_numpy() for t in (left, right)]
    final = np.r_[doc[1][1:] != doc[1][:-1], True]
    before = np.searchsorted(group[1], group[0])  # tokens of the other side in earlier groups
    behind = np.searchsorted(group[0], group[1], side="right")
    place = np.empty(len(keys[0]) + len(keys[1]), np.int64)
    place[np.arange(len(keys[0])) + before] = np.arange(len(keys[0]))
    place[np.arange(len(keys[1])) + behind] = len(keys[0]) + np.arange(len(keys[1]))
    names = [pc.take(side.written, pa.array(t["id"].to_numpy() + side.size * kind))
             for side, t, kind in zip(sides, (left, right), (closes[0].astype(np.int64), closes[1] * (1 + final)))]
    words = pc.take(pa.concat_arrays(names), pa.array(place))
    stops = sum(np.searchsorted(d, np.arange(n + 1)) for d in doc)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), words), "").to_pylist()


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of documents with a bounded amount of text, of one document at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and (size + len(text) > SLICE_BYTES or k - begin >= SLICE_DOCS):
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _aligner(first: str, second: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, partial = _sides(first, second), []
        for batch in batches:
            texts = [t and f" {t}" for t in batch.column("body").to_pylist()]
            for begin, stop in _slices([t or "" for t in texts]):
                own = [t or "" for t in texts[begin:stop]]
                tables = [side.table(own) for side in sides]
                raw = [t.encode() for t in own]
                same = np.array([bool(r) and r == a == b for r, a, b in zip(raw, *(s.joined(t, len(own)) for s, t in zip(sides, tables)))], bool)
                tables = [t.filter(pa.array(same[t["doc"].to_numpy()])) for t in tables]
                links = _links(*tables)
                at, code = links["key"].to_numpy() >> _DOC, links["a"].to_numpy() * _SIDE + links["b"].to_numpy()
                stops = np.searchsorted(at, np.arange(len(own) + 1))
                cuts = np.unique(links["key"].to_numpy())
                told = {"doc_id": batch.column("doc_id").slice(begin, stop - begin)}
                for name, table in zip(("n_a", "n_b"), tables):
                    told[name] = pa.array(np.bincount(table["doc"].to_numpy(), minlength=len(own)), pa.int64())
                told["n_groups"] = pa.array(np.bincount(cuts >> _DOC, minlength=len(own)), pa.int64())
                told["n_links"] = pa.array(np.diff(stops), pa.int64())
                written = _groups(sides, *tables, cuts, len(own))
                told["groups"] = pa.array(written, pa.string()) if groups else pa.nulls(len(own), pa.string())
                told["groups_sha256"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if s else "" for g, s in zip(written, same.tolist())], pa.string())
                told["pairs"] = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(code, pa.int32()))
                told["counts"] = pa.nulls(len(own), pa.list_(pa.int64()))
                partial.append(_summed([pa.table({"pair": pa.array(code), "n": pa.array(np.ones(len(code), np.int64))})]))
                if sum(map(len, partial)) > 1 << 20:
                    partial = [_summed(partial)]
                yield pa.RecordBatch.from_pydict(told)
        if partial:
            found = _summed(partial)
            nothing = {n: pa.nulls(1, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")} | {n: pa.nulls(1, pa.string()) for n in ("groups", "groups_sha256")}
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, batch.schema.field("doc_id").type)} | nothing | {
                "pairs": pa.array([found["pair"].to_pylist()], pa.list_(pa.int32())), "counts": pa.array([found["n"].to_pylist()], pa.list_(pa.int64()))})
    return run


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Counts (pair, n) of several tables as one."""
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])


def _ranked(counts):
    """Rows with their pairs -> n_best and count_sum instead. ``counts``: sorted pairs, their counts, whether they are their piece's best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = counts.value
        for batch in batches:
            lists = batch.column("pairs")
            stops = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            at = np.searchsorted(pair, pc.list_flatten(lists).to_numpy(zero_copy_only=False))
            told = {name: batch.column(name) for name in batch.schema.names if name != "pairs"}
            for name, values in (("n_best", best), ("count_sum", n)):
                told[name] = pa.array(np.diff(np.r_[0, np.cumsum(values[at])][stops]), pa.int64())
            yield pa.RecordBatch.from_pydict(told)
    return run


def align(docs: DataFrame, first: str, second: str, text: str = "text", doc_id: str = "doc_id", groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``groups`` the groups themselves.

    ``first`` is a byte-level BPE file, given the text with a blank in front, ``second`` a sentence-piece model, which puts
    one there itself. Byte offsets at which tokens of both end cut them into groups; every two tokens that end together
    are a link. A pair of ids counts as often as it is linked in the whole table. ``n_best`` counts links whose pair has
    its second id's highest count, ties included; ``count_sum`` adds the counts of all links.

    Null and empty texts, and those which either tokenizer does not give back byte by byte, have no tokens: all zeros,
    groups and their digest ''. Strings of special tokens in a text are plain text. Repeated rows are all returned and
    all counted, null identifiers included. An empty table gives no rows; other columns are not looked at.
    """
    kind = dict(docs.dtypes)[doc_id]
    fields = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    aligned = materialize(
        spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))).mapInArrow(
            _aligner(first, second, groups),
            f"doc_id {kind}, {fields}, groups string, groups_sha256 string, pairs array<int>, counts array<bigint>"), "aligned")
    found = pair_counts(aligned).toArrow().sort_by("pair")  # no more than pair_bound, whatever the corpus
    sent = docs.sparkSession.sparkContext.broadcast(
        tuple(found[name].to_numpy() if found.num_rows else np.zeros(0, np.int64) for name in ("pair", "n", "best")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if groups else []), "groups_sha256"]
    more = "groups string, " if groups else ""
    told = aligned.filter("counts is null").select(*names, "pairs").mapInArrow(
        _ranked(sent), f"doc_id {kind}, {fields}, {more}groups_sha256 string, n_best bigint, count_sum bigint")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *names[5:])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """The tasks' partial counts merged: pair, n, best (1 if no pair with the same second id has more)."""
    partial = aligned.filter("counts is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    # a second id has at most as many partners as the first vocabulary has tokens
    top = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(_SIDE))))
    return counts.select(F.col("pair").cast("bigint").alias("pair"), "n", (F.col("n") == top).cast("bigint").alias("best"))
