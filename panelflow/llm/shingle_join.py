"""Jaccard join of word-shingle sets by prefix filters under several global orders of tokens.

Two sets with nine tenths of their union in common share tokens among the first of each, in whatever order all tokens are
ranked. An order here is a seeded hash; of each set the first tokens in it are taken, twice as many as a filter
needs, so that two sets that link share at least half of these. That decides about sets first: one whose taken
tokens are not shared with other sets often enough links with nothing and is dropped, which ends most of them. The taken
tokens that are left are ranked again, rare ones first (they were counted on the way), and only the first of these are the set's
prefix, so what a common line or passage brings never makes candidates.

Candidates under one order are sets with a prefix token in common, directly or by a chain. The next order is
applied inside the groups so found, with its own counts, and cuts them further: what is left has passed all orders.
Inside a group two sets are candidates only if they share prefix tokens under every order, and only candidates are
verified, on whole sets. A set that is linked is not compared again with those it is linked with already.

A token is a 64-bit hash of its words; equal sets have equal 128-bit digests and sizes and are one node. A set is built
again, from a text of the same 128-bit hash, only where it is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.components import connected_components
from panelflow.session import discard, files_for, materialize

WIDTH, PERCENT = 5, 80
SEEDS = (0, 0x9E3779B97F4A7C15)  # one for each order
BLOCK = 1 << 20  # tokens of sets in a block that is compared
_CACHE = 500_000
_KEY = ["s1", "s2", "n"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total = _mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + len(total)])
    return total + np.uint64(width)


def shingle_sets(texts: list[bytes | None], width: int, words: _Words) -> list[np.ndarray]:
    """The distinct hashed ``width``-word shingles of each UTF-8 text, ascending; fewer words are one shingle."""
    found = [(t or b"").lower().split() for t in texts]  # bytes: A-Z only, and the blanks are exactly those of the words' definition
    stops = list(accumulate(map(len, found)))
    hashes = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.uint64, stops[-1] if stops else 0)
    rolled, sets = _rolled(hashes, width), []
    for own, stop in zip(found, stops):
        begin = stop - len(own)
        whole = rolled[begin:stop - width + 1] if len(own) >= width else _rolled(hashes[begin:stop], len(own)) if own else hashes[:0]
        sets.append(np.unique(whole))
    return sets


def _least_overlap(n: int, percent: int) -> int:
    """Common tokens that any set linked with one of ``n`` has at least; also the size of the smallest such set."""
    return -(-percent * n // 100)


def taken(n: int, percent: int) -> tuple[int, int]:
    """(tokens of a set of ``n`` that an order takes, how many of them a linked set takes too at least)"""
    def both(n: int) -> tuple[int, int]:
        prefix = n - _least_overlap(n, percent) + 1
        size = min(2 * prefix, n)
        return size, size - prefix + 1
    return both(n)[0], both(_least_overlap(n, percent))[1]


def _first(tokens: np.ndarray, seed: int, count: int) -> np.ndarray:
    """The ``count`` first of ``tokens`` (ascending) in the order of a seed."""
    if not seed:
        return tokens[:count]
    ranks = _mix(tokens ^ np.uint64(seed))
    return tokens[np.argpartition(ranks, count - 1)[:count]] if 0 < count < len(tokens) else tokens[:count]


def _heads(sets: list[np.ndarray], seed: int, percent: int) -> dict[str, pa.Array]:
    """What an order takes of each set, and how much of it a linked set must share."""
    told = [taken(len(s), percent) for s in sets]
    return {
        "head": pa.array([_first(s, seed, size).view(np.int64) for s, (size, _) in zip(sets, told)], pa.list_(pa.int64())),
        "shared": pa.array([shared for _, shared in told], pa.int64())}


def _digests(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """Size and 128-bit digest of each set."""
    return {"n": pa.array([len(s) for s in sets], pa.int64())} | {
        name: pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64))
        for name, seed in (("s1", 1), ("s2", 2))}


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words = _Words()
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            yield part, shingle_sets(part.column("body").to_pylist(), width, words)


def _shapes(width: int, percent: int):
    """(..., body) -> (..., n, s1, s2, head, shared) under the first order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, width):
            told = {n: part.column(n) for n in part.schema.names if n != "body"}
            yield pa.RecordBatch.from_pydict(told | _digests(sets) | _heads(sets, SEEDS[0], percent))
    return run


def _sets(width: int, percent: int):
    """(g, node, body) -> (g, node, tokens, head, shared) under the second order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, width):
            yield pa.RecordBatch.from_pydict({
                "g": part.column("g"), "node": part.column("node"),
                "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))} | _heads(sets, SEEDS[1], percent))
    return run


def prefixes(heads: DataFrame) -> DataFrame:
    """(g, node, head, shared) -> (g, node, prefix) of the sets that may link under this order, inside their group ``g``.

    A token of many sets is counted task by task first, and the join that brings the counts back is one that Spark splits at
    a common token.
    """
    pieces = heads.select("g", "node", F.size("head").alias("size"), "shared", F.explode("head").alias("token"))
    several = pieces.groupBy("g", "token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    found = pieces.join(several, ["g", "token"]).groupBy("g", "node", "size", "shared").agg(
        F.array_sort(F.collect_list(F.struct("often", F.xxhash64("token").alias("tie"), "token"))).alias("ranked"))
    # tokens in no other set are the rarest of all: they would come first, and link with nothing
    alone = F.col("size") - F.size("ranked")
    length = (F.col("size") - F.col("shared") + 1 - alone).cast("int")
    return found.filter(F.size("ranked") >= F.col("shared")).select(
        "g", "node", F.slice(F.transform("ranked", lambda r: r["token"]), F.lit(1), length).alias("prefix"))


def candidate_groups(prefix: DataFrame) -> DataFrame:
    """(g, node, prefix) -> (node, group): sets of one ``g`` that prefix tokens connect; sets with none are left out."""
    pieces = materialize(prefix.select("g", "node", F.explode("prefix").alias("token")), "prefixes")
    least = pieces.groupBy("g", "token").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last").select("g", "token", "v")
    found = connected_components(pieces.join(least, ["g", "token"]).select("g", F.col("node").alias("u"), "v"))
    discard(pieces)
    return found.select("node", F.col("component").alias("group"))


class _Ragged:
    """Lists of numbers as one array, and of which list each is."""

    def __init__(self, lists: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.sizes)
        self.stops = np.cumsum(self.sizes)

    def common(self, i: int, there: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """How many entries list ``i`` has in common with each of ``there``; ``mark`` is all false and comes back so."""
        own = self.flat[self.stops[i] - self.sizes[i]:self.stops[i]]
        mark[own] = True
        spans = self.sizes[there]
        at = np.repeat(self.stops[there] - np.cumsum(spans), spans) + np.arange(spans.sum())
        hits = np.bincount(np.repeat(np.arange(len(there)), spans)[mark[self.flat[at]]], minlength=len(there))
        mark[own] = False
        return hits


def _numbered(lists: list[np.ndarray]) -> tuple[_Ragged, int]:
    """The lists over dense numbers, and how many there are."""
    sizes = [len(x) for x in lists]
    names, numbers = np.unique(np.concatenate(lists), return_inverse=True)
    return _Ragged(np.split(numbers.ravel(), np.cumsum(sizes)[:-1])), len(names)


def linked(sets: list[np.ndarray], orders: list[list[np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) that connect all sets which candidate pairs with ``percent`` of their union in common connect."""
    whole, n = _numbered(sets)
    filters = [_numbered(prefix) for prefix in orders]
    mark = np.zeros(max([n, *(m for _, m in filters)]) + 1, bool)
    left = np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            size = whole.sizes[i]
            near = left[(100 * whole.sizes[left] >= percent * size) & (100 * size >= percent * whole.sizes[left])]
            for prefix, _ in filters:
                near = near[prefix.common(i, near, mark) > 0]
            common = whole.common(i, near, mark)
            near = near[100 * common >= percent * (size + whole.sizes[near] - common)]
            if len(near):
                yield from ((i, j) for j in near.tolist())
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)


def _verified(orders: int, percent: int):
    """Rows (g, part, node, tokens, prefix0, ...), each part's next to each other -> links (u, v)."""
    def told(held: list[tuple]) -> pa.RecordBatch:
        nodes = np.array([h[0] for h in held], np.int64)
        found = np.array(list(linked([h[1] for h in held], [[h[2][k] for h in held] for k in range(orders)], percent)) if len(held) > 1 else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"u": pa.array(nodes[found[:, 0]]), "v": pa.array(nodes[found[:, 1]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("g", "part", "node")))
            lists = [batch.column(n) for n in ("tokens", *(f"prefix{k}" for k in range(orders)))]
            for row, (g, part, node) in enumerate(keys):
                if (g, part) != here:
                    if here is not None:
                        yield told(held)
                    here, held = (g, part), []
                own = [c[row].values.to_numpy() for c in lists]
                held.append((node, own[0], own[1:]))
        if here is not None:
            yield told(held)
    return run


def set_links(groups: DataFrame, orders: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(g, node, tokens, prefix0, ...) -> links (u, v). A group of more than ``block`` tokens is dealt into blocks and every two are compared."""
    sizes = groups.groupBy("g").agg(F.ceil(F.sum(F.size("tokens")) / block).cast("bigint").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = groups.join(sizes, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return dealt.select("g", part.alias("part"), "node", "tokens", *(f"prefix{k}" for k in range(orders))).repartition("g", "part").sortWithinPartitions(
        "g", "part").mapInArrow(_verified(orders, percent), "u bigint, v bigint")


def shingle_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A row's set holds its distinct ``width``-word shingles, words being what stands between ASCII blanks, A-Z lower-cased; a text
    with fewer words is one shingle. Two rows link when ``percent`` of their union is common to both. Rows without
    words, null texts included, have an empty set and link with nothing, not with each other either.
    ``component_id`` is the smallest identifier that links reach, the row's own included; a null identifier only where there is no
    other. Repeated rows are all returned. An empty table gives no rows; other columns are not looked at.
    """
    if not (width >= 1 and 1 <= percent <= 100):
        raise ValueError("width is at least 1, percent from 1 to 100")
    kind = dict(docs.dtypes)[doc_id]
    body = F.col(text).cast("binary")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("body"))
    rows = materialize(given.mapInArrow(
        _shapes(width, percent), f"doc_id {kind}, k1 bigint, k2 bigint, n bigint, s1 bigint, s2 bigint, head array<bigint>, shared bigint"), "shapes")
    by_set = rows.filter("n > 0").groupBy(*_KEY).agg(
        F.min("doc_id").alias("least"), F.first("head").alias("head"), F.first("shared").alias("shared"), F.min(F.struct("k1", "k2")).alias("of"))
    files = files_for(rows.count())
    nodes = materialize(by_set.coalesce(files).select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    # a smaller set than these has no partner but an equal one
    first = materialize(prefixes(
        nodes.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).select(F.lit(0).cast("bigint").alias("g"), "node", "head", "shared")), "order")
    chosen = materialize(candidate_groups(first).join(nodes.select("node", "of.*"), "node").coalesce(files), "candidates")
    # the candidates grow with the input: the texts meet them by a shuffle at any size, and need no sorting
    again = given.select("k1", "k2", "body").join(chosen.hint("shuffle_hash"), ["k1", "k2"])
    sets = materialize(
        again.groupBy("node", F.col("group").alias("g")).agg(F.first("body").alias("body")).select("g", "node", "body")
        .mapInArrow(_sets(width, percent), "g bigint, node bigint, tokens array<bigint>, head array<bigint>, shared bigint"), "sets")
    second = materialize(prefixes(sets.select("g", "node", "head", "shared")), "order")
    grouped = (
        candidate_groups(second).withColumnRenamed("group", "g").join(sets.select("node", "tokens"), "node")
        .join(first.select("node", F.col("prefix").alias("prefix0")), "node").join(second.select("node", F.col("prefix").alias("prefix1")), "node"))
    links = set_links(materialize(grouped, "groups"), len(SEEDS), percent, block)
    parts = connected_components(links.select(F.lit(0).alias("g"), "u", "v"))
    labelled = nodes.select("node", *_KEY, "least").join(parts.select("node", "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(names, "component").select(*_KEY, "component_id").coalesce(files), "components")
    return rows.select("doc_id", *_KEY).join(named, _KEY, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
