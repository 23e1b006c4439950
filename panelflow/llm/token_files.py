"""Token identifiers as binary files: one array of ids a file, document boundaries and identifiers as Elias-Fano.

File: head, ids (2 or 4 bytes, little-endian), then the Elias-Fano codes of the documents' ends (as counts of ids)
and of their identifiers. Files follow each other in ascending order of identifiers. A writer streams the ids of its
range of documents and keeps only the boundaries; a reader takes a document's ids by two selects.

Files are written under names of their own attempt, and the written list of files names those of successful
attempts only, so a task may fail, be repeated or run twice.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelflow.llm.bpe import BEYOND_LATIN, byte_symbols, unassigned
from panelflow.llm.elias_fano import EliasFano
from panelflow.session import files_for, materialize, qualified, scratch_path
from panelflow.sources.files import file_system

MAGIC = b"PFTOKEN1"
_HEAD = struct.Struct("<8sQQQB7x")  # magic, documents, of them without identifier, ids, bytes an id
CORE_WORDS, CACHE_WORDS = 100_000, 250_000  # words met first, most of them common, are kept for good
READ_DOCS = 4_096
FILE_BYTES = 16 << 20  # text in a file, on average
#: The library's byte-level splitting pattern (fixed value), with places for letters, numbers and blanks.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def _latin_pattern() -> re.Pattern:
    """:data:`PATTERN` for texts below U+0370, with the classes spelled out for the faster engine."""
    below = [chr(code) for code in range(0x370)]
    kinds = {kind: [c for c in below if unicodedata.category(c)[0] == kind] for kind in "LN"} | {"S": [*"\t\n\x0b\x0c\r \x85\xa0"]}
    return re.compile(PATTERN.format(**{k: "".join(map(re.escape, v)) for k, v in kinds.items()}))


def _head(n_docs: int, missing: int, n_tokens: int, width: int) -> bytes:
    return _HEAD.pack(MAGIC, n_docs, missing, n_tokens, width)


class _Words(dict):
    """Word -> the bytes of its ids; a word not met before is encoded by the library's model."""

    def __init__(self, model, width: int):
        self.code, self.kind = model.tokenize, "H" if width == 2 else "I"
        self.symbols, self.core = dict(enumerate(byte_symbols())), {}

    def __missing__(self, word: str) -> bytes:
        ids = array(self.kind, [t.id for t in self.code(word.encode().decode("latin-1").translate(self.symbols))])
        if sys.byteorder == "big":
            ids.byteswap()
        found = self[word] = ids.tobytes()
        return found

    def trim(self) -> None:
        if not self.core and len(self) > CORE_WORDS:
            self.core = dict(self)
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.core)


class LibraryEncoder:
    """Texts to the bytes of their ids, by the tokenizers library; a word met before is not encoded again."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        step = json.loads(self.library.to_str())["pre_tokenizer"]
        if step.get("type") != "ByteLevel" or step.get("add_prefix_space"):
            raise ValueError("the tokenizer must split by byte level, without a blank in front")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.pattern = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=r"\s"))
        self.latin = _latin_pattern()
        self.unassigned = unassigned()
        self.known = _Words(self.library.model, self.width)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _words(self, text: str) -> list[str] | None:
        """The words of a text; none if only the library can tell: special strings, characters new to Unicode."""
        if "<|" in text:
            return None
        if not BEYOND_LATIN.search(text):
            return self.latin.findall(text)
        return None if self.unassigned.search(text) else self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        known.trim()
        words = map(self._words, texts)
        return [self._bytes(self.library.encode(t, add_special_tokens=False).ids) if w is None else b"".join(map(known.__getitem__, w))
                for t, w in zip(texts, words)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _writer(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        store, place = file_system(folder)
        store.create_dir(place, recursive=True)
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
        mark = np.array([end_id], f"<u{encoder.width}").tobytes()
        ends, keys, missing, count = [], [], 0, 0
        body = store.open_output_stream(f"{place}/{name}.ids")
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                coded = encoder.encode([t or "" for t in part.column("body").to_pylist()])
                sizes = np.array([len(c) // encoder.width + 1 for c in coded], np.int64)
                ends.append(count + np.cumsum(sizes))
                count = int(ends[-1][-1])
                ids = part.column("doc_id")
                missing += ids.null_count
                keys.append(ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                body.write(mark.join([*coded, b""]))
        n = sum(map(len, ends))
        if not n:
            body.close()
            return
        for values in (ends, keys):
            body.write(EliasFano.of(np.concatenate(values)).to_bytes())
        body.write(_head(n, missing, count, encoder.width))
        body.close()
        store.move(f"{place}/{name}.ids", f"{place}/{name}")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{name}"],
            "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([count], pa.int64())})
    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
                      shards: int | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (a URI all executors can write to); one row per file: shard, path, n_docs, n_tokens, base.

    Each text is encoded with the tokenizers library and closed by ``end_id``; null counts as empty. Documents come
    in ascending order of their integer identifiers, rows without one first, equal ones in the order of their texts'
    hashes. Without ``shards``, files hold :data:`FILE_BYTES` of text each. ``base`` is the number of ids in all earlier files. An empty table gives no files.
    """
    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("body"))
    count = shards or max(1, -(-(docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0) // FILE_BYTES))
    ordered = rows.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "body")
    files = materialize(
        ordered.select("doc_id", "body").mapInArrow(_writer(tokenizer, folder, end_id), "shard bigint, path string, n_docs bigint, n_tokens bigint")
        .repartition(files_for(count)), "files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """A written file: the ids of any of its documents."""

    def __init__(self, path: str):
        store, place = file_system(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        magic, self.n_docs, self.missing, self.n_tokens, self.width = _HEAD.unpack(self._read(size - _HEAD.size, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        codes = self._read(self.n_tokens * self.width, size - _HEAD.size - self.n_tokens * self.width)
        self.ends, at = EliasFano.from_bytes(codes)
        self.keys, _ = EliasFano.from_bytes(codes, at)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, begin: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._read(begin * self.width, (stop - begin) * self.width), f"<u{self.width}")

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``, its end mark included."""
        return self.ids(self.ends.select(place - 1) if place else 0, self.ends.select(place))


def _reader(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                file, first = TokenFile(path), 0
                for begin in range(0, file.n_docs, READ_DOCS):
                    ends = file.ends.slice(begin, begin + READ_DOCS)
                    starts = np.r_[first, ends[:-1]]
                    block = file.ids(first, int(ends[-1])).astype("<u4")
                    found = [block[a:b] for a, b in zip((starts - first).tolist(), (ends - first).tolist())]
                    bare = min(max(file.missing - begin, 0), len(ends))
                    keys = file.keys.slice(begin + bare - file.missing, begin + len(ends) - file.missing)
                    told = {
                        "doc_id": pa.concat_arrays([pa.nulls(bare, pa.int64()), pa.array(keys, pa.int64())]),
                        "start": pa.array(starts + base), "n_tokens": pa.array(ends - starts)}
                    if digest:
                        told["ids_crc32"] = pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64())
                    else:
                        told["ids"] = pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(told)
                    first = int(ends[-1])
                file.file.close()
    return run


def read_token_files(files: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of the files listed by :func:`write_token_files`.

    ``digest`` gives ids_crc32 in place of ids: the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"
    # a number, since a list of files is small and would else be read by a single task
    return files.select("path", "base").repartition(max(1, files.count())).mapInArrow(_reader(digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What the files of ``docs``, written to the shared folder, hold when read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, tokenizer, scratch_path(docs.sparkSession, "tokens"), end_id, text, doc_id), digest=True)
