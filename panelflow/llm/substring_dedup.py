"""Removal of passages that occur more than once, by prefix-partitioned suffix trees.

Only suffixes that can begin a repeated passage are indexed. Of every window of ``window`` words the ``gram``-word
group with the smallest hash is its anchor: windows with the same words have their anchors at the same place, so a
window can repeat only if its anchor's group occurs again. Groups that occur once, nearly all, are dropped on counts
of their hashes.

The suffixes of the other windows are dealt out by that group of words; all suffixes that share a long prefix come
together. Neighbouring windows with the same group are one run of suffixes, however often it occurs in them. Each group's suffix tree is built in memory as sorted suffixes and the depths at which neighbours part:
the leaves below its nodes of ``window`` or more words are the repeats. A group of more than ``group_limit`` suffixes
is not gathered but cut by the longest prefix that matters, all ``window`` words: each such subtree is one
node, and counting its leaves is enough. That is done on distinct runs of suffixes, with counts, so copies of one
text stay cheap however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import discard, materialize

WINDOW, GRAM, GROUP_LIMIT = 35, 8, 65_536
CACHE_WORDS = 300_000
_TREE_WORDS = 120_000  # words gathered before a set of groups is sorted
_FLAT_WORDS, _RUN_BYTES = 60_000, 4_000_000  # words looked at, and bytes given out, at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the smallest of the next ``span`` values is, the leftmost of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < span:  # stretches twice as long each time, the last one overlapping
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        width += step
    return at


def anchors(texts: list[list[bytes]], hashes: _Hashes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The suffix runs of some texts: number of the text, first window, last window, hash of their anchors' group of
    words, and whether that stands at more than one place, so that the run may repeat itself."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    h = np.fromiter((x for t in texts for x in map(hashes.__getitem__, t)), np.uint64, int(sizes.sum()))
    if not counts.any():
        return (np.zeros(0, np.int64),) * 5
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        g = (g ^ h[j:j + len(g)]) * _ODD
        g ^= g >> np.uint64(29)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    best = _least(g, window - gram + 1)[begins[owner] + local]
    group = g[best]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(owner)] - 1
    return owner[first], local[first], local[last], group[first].view(np.int64), best[first] != best[last]


def _spots(window: int, gram: int):
    """Rows (k1, k2, body) -> a suffix run each: group, k1, k2, first, more, tied."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()

        def told(batch: pa.RecordBatch, rows: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
            owner, first, last, group, tied = anchors(texts, hashes, window, gram)
            some = batch.select(["k1", "k2"]).take(pa.array(np.array(rows, np.int64)[owner]))
            return pa.RecordBatch.from_arrays(
                [pa.array(group), *some.columns, pa.array(first), pa.array(last - first), pa.array(tied)],
                names=["group", "k1", "k2", "first", "more", "tied"])

        for batch in batches:
            rows, texts, size, bodies = [], [], 0, batch.column("body")
            for row in range(batch.num_rows):
                words = (bodies[row].as_py() or b"").split()  # bytes: ASCII blanks
                if len(words) < window:
                    continue
                rows.append(row)
                texts.append(words)
                size += len(words)
                if size > _FLAT_WORDS:
                    yield told(batch, rows, texts)
                    rows, texts, size = [], [], 0
            if rows:
                yield told(batch, rows, texts)
    return run


def _runs(window: int):
    """Rows (body, k1, k2, spots) -> the suffix runs of each spot: group, n, k1, k2, first, words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lists = batch.column("body"), batch.column("spots")
            stops = lists.offsets.to_numpy()
            spots = lists.values
            group, n, first, more = (spots.field(name).to_numpy(zero_copy_only=False) for name in ("group", "n", "first", "more"))
            rows, places, words, size = [], [], [], 0

            def told() -> pa.RecordBatch:
                at = np.array(places, np.int64)
                some = batch.select(["k1", "k2"]).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [pa.array(group[at]), pa.array(n[at]), *some.columns, pa.array(first[at]), pa.array(words, pa.binary())],
                    names=["group", "n", "k1", "k2", "first", "words"])

            for row in range(batch.num_rows):
                text = (bodies[row].as_py() or b"").split()
                for place in range(stops[row], stops[row + 1]):
                    begin = int(first[place])
                    rows.append(row)
                    places.append(place)
                    words.append(b" ".join(text[begin:begin + int(more[place]) + window]))
                    size += len(words[-1])
                if size > _RUN_BYTES:
                    yield told()
                    rows, places, words, size = [], [], [], 0
            if rows:
                yield told()
    return run


def repeated_suffixes(runs: list[bytes], window: int) -> list[np.ndarray]:
    """For each run of words, whether the suffix at each of its first places shares ``window`` words with another.

    The suffixes, cut at ``window`` words, are sorted; a node of the tree that deep is a stretch of neighbours that
    do not part before it.
    """
    numbers: dict[bytes, int] = {}
    texts = [r.split(b" ") for r in runs]
    flat = np.array([numbers.setdefault(w, len(numbers)) for text in texts for w in text], ">u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = sizes - window + 1
    begins = np.cumsum(sizes) - sizes
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    suffixes = np.lib.stride_tricks.sliding_window_view(flat, window)[starts]
    keys = np.ascontiguousarray(suffixes).view(f"S{4 * window}").ravel()  # big-endian: in the order of the word numbers
    order = np.argsort(keys, kind="stable")
    depth = np.cumprod(suffixes[order[1:]] == suffixes[order[:-1]], axis=1).sum(axis=1)  # words shared by neighbours
    deep = depth >= window
    leaf = np.zeros(len(order), bool)
    leaf[order] = np.r_[deep, False] | np.r_[False, deep]
    return np.split(leaf, np.cumsum(counts)[:-1])


def _tree(window: int):
    """Suffix runs sorted by group -> removed stretches: k1, k2, begin, stop."""
    def told(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, first, words = zip(*rows)
        at, begins, stops = [], [], []
        for row, leaf in enumerate(repeated_suffixes(list(words), window)):
            edges = np.flatnonzero(np.diff(np.r_[0, leaf.astype(np.int8), 0]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                at.append(row)
                begins.append(first[row] + a)
                stops.append(first[row] + b - 1 + window)
        return pa.RecordBatch.from_pydict({
            "k1": pa.array([k1[i] for i in at], pa.int64()), "k2": pa.array([k2[i] for i in at], pa.int64()),
            "begin": pa.array(begins, pa.int64()), "stop": pa.array(stops, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            group, words = batch.column("group").to_numpy(zero_copy_only=False).tolist(), batch.column("words")
            for place, row in enumerate(zip(*(batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in ("k1", "k2", "first")))):
                if group[place] != last and size > _TREE_WORDS:
                    yield told(rows)
                    rows, size = [], 0
                last = group[place]
                rows.append((*row, words[place].as_py()))
                size += len(rows[-1][3]) // 6
        if rows:
            yield told(rows)
    return run


def _windows(window: int):
    """Distinct runs (r1, r2, words, m) -> their suffixes: w1, w2 (hash of the window), r1, r2, off, m."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            texts = batch.column("words")
            for place, (r1, r2, m) in enumerate(zip(*(batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in ("r1", "r2", "m")))):
                if len(made) > 20_000:
                    yield _suffix_rows(made)
                    made = []
                text = texts[place].as_py().split(b" ")
                for off in range(len(text) - window + 1):
                    mark = hashlib.blake2b(b" ".join(text[off:off + window]), digest_size=16).digest()
                    made.append((int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True), r1, r2, off, m))
            if made:
                yield _suffix_rows(made)
    return run


def _suffix_rows(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("w1", "w2", "r1", "r2", "off", "m"), zip(*made))})


def _counted(runs: DataFrame, window: int) -> DataFrame:
    """Removed stretches of the groups that are too large to be gathered."""
    marked = runs.select("k1", "k2", "first", "words", F.xxhash64("words").alias("r1"), F.xxhash64(F.lit(1), F.col("words")).alias("r2"))
    distinct = marked.groupBy("r1", "r2").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("m"))
    suffixes = materialize(distinct.mapInArrow(_windows(window), "w1 bigint, w2 bigint, r1 bigint, r2 bigint, off bigint, m bigint"), "suffixes")
    again = materialize(suffixes.groupBy("w1", "w2").agg(F.sum("m").alias("m")).filter("m > 1").select("w1", "w2"), "again")
    told = suffixes.join(again, ["w1", "w2"], "left_semi").select("r1", "r2", "off")
    offs = told.groupBy("r1", "r2").agg(F.array_sort(F.collect_list("off")).alias("offs"))  # places of one run
    begins = F.filter("offs", lambda x, i: (i == 0) | (F.get("offs", i - 1) != x - 1))
    ends = F.filter("offs", lambda x, i: (i == F.size("offs") - 1) | (F.get("offs", i + 1) != x + 1))
    cuts = offs.select("r1", "r2", F.arrays_zip(begins.alias("a"), ends.alias("b")).alias("cuts"))
    # the places of a run, as one list for each part of the table they are read from
    places = marked.groupBy("r1", "r2", F.spark_partition_id().alias("part")).agg(F.collect_set(F.struct("k1", "k2", "first")).alias("places"))
    found = places.join(cuts, ["r1", "r2"]).select(F.explode("places").alias("at"), "cuts").select("at.*", F.explode("cuts").alias("cut"))
    return found.select("k1", "k2", (F.col("first") + F.col("cut.a")).alias("begin"), (F.col("first") + F.col("cut.b") + window).alias("stop"))


def _kept(outputs: tuple[str, ...]):
    """Rows (doc_id, body, cuts) -> doc_id, n_words, n_removed and the wanted outputs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lists = batch.column("body"), batch.column("cuts")
            stops, cuts = lists.offsets.to_numpy(), lists.values
            begin_at, stop_at = (cuts.field(n).to_numpy(zero_copy_only=False) for n in ("begin", "stop"))
            made = {n: [] for n in ("n_words", "n_removed", *outputs)}
            for row in range(batch.num_rows):
                words, spans = (bodies[row].as_py() or b"").split(), []
                own = slice(stops[row], stops[row + 1])
                for begin, stop in sorted(zip(begin_at[own].tolist(), stop_at[own].tolist())):
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([begin, stop])
                places = [0, *(x for s in spans for x in s), len(words)]
                kept = [w for a, b in zip(places[::2], places[1::2]) for w in words[a:b]]
                made["n_words"].append(len(words))
                made["n_removed"].append(len(words) - len(kept))
                text = b" ".join(kept)
                for name in outputs:
                    made[name].append(hashlib.sha256(text).hexdigest() if name == "kept_sha256" else text.decode() if name == "kept" else
                                      [{"begin": a, "stop": b} for a, b in spans])
            kinds = {"kept": pa.string(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), **{n: pa.array(made[n], kinds.get(n, pa.int64())) for n in made}})
    return run


def removed_stretches(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(k1, k2, body) -> (k1, k2, begin, stop): words of the row that a repeated window covers."""
    spots = materialize(rows.mapInArrow(_spots(window, gram), "group bigint, k1 bigint, k2 bigint, first bigint, more bigint, tied boolean"), "spots")
    repeated = materialize(
        spots.groupBy("group").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("more") + 1).alias("n"), F.bool_or("tied").alias("tied"))
        .filter("runs > 1 or tied").select("group", "n"), "repeated")
    # equal rows share a key and their spots: as a set, so that each of them fetches its own runs only
    by_row = spots.join(repeated, "group").groupBy("k1", "k2").agg(F.collect_set(F.struct("group", "first", "more", "n")).alias("spots"))
    runs = materialize(
        by_row.join(rows, ["k1", "k2"]).select("body", "k1", "k2", "spots")
        .mapInArrow(_runs(window), "group bigint, n bigint, k1 bigint, k2 bigint, first bigint, words binary"), "runs")
    discard(spots)
    cold = runs.filter(F.col("n") <= group_limit).select("group", "k1", "k2", "first", "words")
    found = cold.repartition("group").sortWithinPartitions("group").mapInArrow(_tree(window), "k1 bigint, k2 bigint, begin bigint, stop bigint")
    if repeated.filter(F.col("n") > group_limit).isEmpty():
        return found
    return found.unionByName(_counted(runs.filter(F.col("n") > group_limit), window))


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM,
                    group_limit: int = GROUP_LIMIT, outputs: tuple[str, ...] = ("kept", "spans")) -> DataFrame:
    """Every row without its repeated passages: doc_id, n_words, n_removed and the wanted outputs.

    A word goes if a window of ``window`` consecutive words of its row covers it whose words also begin anywhere
    else, in the same row or another; windows are judged on the input. ``outputs`` may be kept (the kept words,
    joined by one space), kept_sha256, and spans (removed stretches by word, begin inclusive, stop exclusive). Null
    texts have no words. Repeated rows are repeats of each other, also where their identifiers are equal or null.
    An empty table gives no rows; other columns are not looked at.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram is from 1 to window")
    rows = docs.select(
        F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("k2"),
        F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    cuts = removed_stretches(rows.select("k1", "k2", "body"), window, gram, group_limit)
    by_row = cuts.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "stop")).alias("cuts"))
    kinds = {"kept": "string", "kept_sha256": "string", "spans": "array<struct<begin:bigint,stop:bigint>>"}
    schema = [f"doc_id {dict(docs.dtypes)[doc_id]}", "n_words bigint", "n_removed bigint", *[f"{n} {kinds[n]}" for n in outputs]]
    return rows.join(by_row, ["k1", "k2"], "left").select("doc_id", "body", "cuts").mapInArrow(_kept(tuple(outputs)), ", ".join(schema))
