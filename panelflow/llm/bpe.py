"""Byte-pair encoding and decoding in batched numpy rounds.

The words of many documents that are not known yet lie in one flat array of symbols. A round looks every
neighbouring pair up by binary search among the sorted pair keys, takes the lowest rank of each word, and merges all
its occurrences from the left; words without a pair left drop out. A later merge never forms a pair of lower rank
than the merges that made its parts, so merging all occurrences in one round gives what merging one by one does.

Characters that are not assigned in every Unicode version at hand are split by the tokenizer file's own library.

Read from a tokenizer file with Unicode normalisation and lower-casing, a splitting pattern, byte symbols and an
end-of-word mark. Tokens of the file's special strings are found first and stand alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CACHE_WORDS = 400_000
BEYOND_LATIN = re.compile("[^\x00-\u036f]")
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode data has no name for."""
    codes = np.array([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"])
    firsts, lasts = codes[np.r_[True, np.diff(codes) > 1]], codes[np.r_[np.diff(codes) > 1, True]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist())) + "]")


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.lower = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if not all(s.startswith("<|") for s in self.special):
            raise ValueError("special strings must begin with <|")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + mark] for s in symbols], np.int64)
        self.base = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.order = np.argsort(keys, kind="stable")  # place in the sorted keys -> rank
        self.keys, self.made = keys[self.order], made
        self.known: dict[str, tuple[int, ...]] = {}
        self.unassigned = unassigned()
        self.library = Tokenizer.from_file(path)
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if self.lower else text  # letter by letter: no final sigma

    def split(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text) and self.unassigned.search(text):
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in cut]
        return self.pattern.findall(self.normal(text))

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special strings as they are."""
        if "<|" not in text:
            return self.split(text)
        found, at = [], 0
        for match in self.specials.finditer(text):
            found += [*self.split(text[at:match.start()]), match.group()]
            at = match.end()
        return found + self.split(text[at:])

    def merge(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """The identifiers of each word."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = symbol[:-1] * self.base + symbol[1:]
            place = np.searchsorted(self.keys, pair)
            place[place == len(self.keys)] = 0
            joined = (self.keys[place] == pair) & (owner[:-1] == owner[1:])
            rank = np.full(len(symbol), _NONE, np.int64)
            rank[:-1][joined] = self.order[place[joined]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            spread = np.repeat(lowest, lengths)
            idle = spread == _NONE
            if idle.any():
                done.append((owner[idle], symbol[idle]))
                symbol, owner, rank, spread = symbol[~idle], owner[~idle], rank[~idle], spread[~idle]
            at = np.flatnonzero(rank == spread) if len(symbol) else np.zeros(0, np.int64)
            if not len(at):
                continue
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # of overlapping pairs every other one, from the left
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        if not done:
            return []
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        symbol, stops = symbol[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(raw))).tolist()
        return [tuple(symbol[a:b]) for a, b in zip([0, *stops], stops)]

    def learn(self, texts: Sequence[list[str]]) -> None:
        """Encode the words of a batch that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = list({w for words in texts for w in words if w not in known and w not in self.special})
        known.update((s, (i,)) for s, i in self.special.items())
        for begin in range(0, len(new), 65_536):
            some = new[begin:begin + 65_536]
            known.update(zip(some, self.merge(some)))

    def decode(self, ids: Sequence[int]) -> str:
        """Without a decoder the file's tokens are joined by blanks."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=4)
def _bpe(path: str) -> WordBpe:
    return WordBpe(path)


_KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_GROUP = 256  # documents whose words are merged together


def _coded(path: str, outputs: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, _GROUP):
                part = batch.slice(begin, _GROUP)
                words = [bpe.pieces(t or "") for t in part.column("body").to_pylist()]
                bpe.learn(words)
                made = {name: [] for name in outputs}
                for text in words:
                    ids = [i for w in map(bpe.known.__getitem__, text) for i in w]
                    told = {"n_tokens": len(ids), "ids": ids}
                    if "ids_sha256" in made:
                        told["ids_sha256"] = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                    if "decoded" in made or "decoded_sha256" in made:
                        told["decoded"] = bpe.decode(ids)
                        told["decoded_sha256"] = hashlib.sha256(told["decoded"].encode()).hexdigest()
                    for name in outputs:
                        made[name].append(told[name])
                yield pa.RecordBatch.from_pydict({
                    **{n: part.column(n) for n in part.schema.names if n != "body"},
                    **{n: pa.array(made[n], _KINDS[n]) for n in outputs}})
    return run


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", outputs: Sequence[str] = ("ids", "n_tokens")) -> DataFrame:
    """doc_id and the wanted ``outputs`` for every row: ids, n_tokens, decoded, ids_sha256, decoded_sha256.

    ``path`` is the tokenizer file, the same on every executor. Null and empty texts have no tokens and decode to
    the empty text; rows with null or repeated identifiers are encoded like any other. Other columns are not
    looked at. Digests are those of the decimal ids, and of the decoded text, in UTF-8.
    """
    unknown = set(outputs) - set(_KINDS)
    if unknown:
        raise ValueError(f"no such outputs: {sorted(unknown)}")
    schema = ", ".join([f"doc_id {dict(docs.dtypes)[doc_id]}", *[f"{n} {_SQL[n]}" for n in outputs]])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).mapInArrow(_coded(path, tuple(outputs)), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids, null where they are null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = [None if row is None else bpe.decode(row) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
    return encoded.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in encoded.dtypes)}, decoded string")
