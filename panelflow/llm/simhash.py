"""Near-duplicate detection by SimHash: deletion-variant signatures, equality join, verification.

Two fingerprints that differ in at most four bits, cut into three segments, differ by at most one bit in one of
them. So each fingerprint is indexed under every segment with one bit wiped out (64 keys for 64 bits); fingerprints
that share a key are compared. Only fingerprints that differ from each other take part, whatever number of documents
has them.

Within a key, fingerprints come sorted and are compared in blocks; of a large key only links between parts not yet
joined are kept, so a dense group gives fewer links than members, and no link that matters is lost. A key with more
than ``limit`` fingerprints is not compared but indexed again: the bits not used so far must hold the difference,
so they are cut into three segments and wiped in the same way, until keys are small or no bits are left.

Two relations are offered. By ``distance``, fingerprints of word shingles link at four or fewer bits. By likeness
(:func:`drop_near_duplicates`), 128 bits over a text's different words are indexed by eight segments with one bit
wiped out, which all pairs up to fifteen bits apart share; fourteen stand for texts that share about nine tenths of
their words. A key with more than ``limit`` of these is compared block against block. Copies with
four fifths of their five-word shingles in common are ten bits apart by shingles, too far for any index of segments,
but three or four by words. :func:`drop_near_copies` takes that only to find groups, and inside each compares the
sets of hashed shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.components import connected_components
from panelflow.session import files_for, materialize

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 5, 42
LIKE = 14  # bits of 128
LIMIT = 32_768
BLOCK = 1 << 20  # hashed shingles in a block of verified sets
_SMALL = 48  # groups up to this size are compared by shifting the sorted batch
_BLOCK = 512
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK = 65_536


def word_fingerprint(text: bytes | None, seed: int = SEED) -> int:
    """The 64-bit SimHash of the different words of a UTF-8 text."""
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(w, seed) for w in set((text or b"").lower().split())], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), _CHUNK):
        some = hashes[part:part + _CHUNK]
        votes += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A hash of each ``width``-word shingle of a UTF-8 text, repeats included; a shorter text is one shingle."""
    words = _WORD.findall((text or b"").lower())  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[min(width, len(words)) - 1:] - 1).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text over its ``width``-word shingles, repeats included."""
    hashes = shingle_hashes(text, width, seed)
    return _majority(hashes) if len(hashes) else 0


def _fingerprints(width: int, seed: int, alike: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            columns = {n: batch.column(n) for n in batch.schema.names if n != "body"}
            made = [word_fingerprint(t, seed) for t in texts] if alike else [fingerprint(t, width, seed) for t in texts]
            columns["mark"] = pa.array(np.array(made, np.uint64).view(np.int64))
            more = [word_fingerprint(t, seed + 1) for t in texts] if alike else [0] * len(texts)
            columns["more"] = pa.array(np.array(more, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def _segments(used: int, parts: int) -> list[list[int]]:
    """The bits not in ``used``, cut into ``parts`` near-equal runs."""
    free = [b for b in range(BITS) if not used >> b & 1]
    return [s.tolist() for s in np.array_split(free, parts) if len(s)]


def _like_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, more) -> (key, mark, more), one row for each bit wiped out of its segment of the 128 bits."""
    parts = LIKE // 2 + 1
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            words = [batch.column(n).slice(begin, 4096).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("mark", "more")]
            for segment in np.array_split(np.arange(2 * BITS), parts):
                whole = [sum(1 << int(b) % BITS for b in segment if b // BITS == w) for w in (0, 1)]
                for b in segment.tolist():
                    kept = [whole[w] & ~(1 << b % BITS) if b // BITS == w else whole[w] for w in (0, 1)]
                    key = np.full(len(words[0]), np.uint64(b + 1))
                    for word, mask in zip(words, kept):
                        key = _mix(key) ^ (word & np.uint64(mask))
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(_mix(key).view(np.int64)), "mark": pa.array(words[0].view(np.int64)), "more": pa.array(words[1].view(np.int64))})


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, used, mark) -> one row for each segment and bit wiped out of it."""
    parts = DISTANCE // 2 + 1
    for batch in batches:
        key, used, mark = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "used", "mark"))
        for mask in np.unique(used):
            inside = used == mask
            for begin in range(0, int(inside.sum()), 4096):
                old = key[inside][begin:begin + 4096].view(np.uint64)
                bits = mark[inside][begin:begin + 4096].view(np.uint64)
                for segment in _segments(int(mask) & (1 << BITS) - 1, parts):
                    whole = sum(1 << b for b in segment)
                    keys = [_mix(_mix(old + np.uint64(b + 1)) ^ (bits & np.uint64(whole & ~(1 << b)))) for b in segment]
                    taken = (int(mask) | whole) & (1 << BITS) - 1
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(np.concatenate(keys).view(np.int64)),
                        "used": pa.array(np.full(len(keys) * len(bits), np.uint64(taken)).view(np.int64)),
                        "mark": pa.array(np.tile(bits, len(keys)).view(np.int64))})


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; the last axis holds their 64-bit words."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int16)


def _forest(marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every part of ``marks`` that is connected at the distance; never more than len(marks) - 1."""
    label, left, right = np.arange(len(marks)), [], []
    for begin in range(0, len(marks), _BLOCK):
        rows = marks[begin:begin + _BLOCK]
        for low in range(0, begin + len(rows), 4 * _BLOCK):
            columns = marks[low:min(low + 4 * _BLOCK, begin + len(rows))]
            i, j = np.nonzero(_apart(rows[:, None], columns[None, :]) <= distance)
            i, j = i + begin, j + low
            while True:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                # one link for each part on the left: merging parts pairwise at least halves what is apart
                _, first = np.unique(label[i], return_index=True)
                for a, b in zip(i[first].tolist(), j[first].tolist()):
                    if label[a] != label[b]:
                        left.append(a)
                        right.append(b)
                        label[label == label[a]] = label[b]
    return marks[np.array(left, np.int64)], marks[np.array(right, np.int64)]


def _shifted(keys: np.ndarray, marks: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside groups of up to ``_SMALL`` equal keys, of a sorted batch."""
    for step in range(1, _SMALL):
        if step >= len(keys):
            return
        same = keys[step:] == keys[:-step]
        if not same.any():
            return
        at = np.flatnonzero(same)
        at = at[_apart(marks[at], marks[at + step]) <= distance]
        yield marks[at], marks[at + step]


def _link(limit: int | None, distance: int, alike: bool):
    def told(n: int, used, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        u, v = u.view(np.int64), v.view(np.int64)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_pydict({
            "used": used, "u": pa.array(u[:, 0]), "u_more": pa.array(u[:, 1]) if u.shape[1] > 1 else none,
            "v": pa.array(v[:, 0]), "v_more": pa.array(v[:, 1]) if v.shape[1] > 1 else none})

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return told(len(a), pa.nulls(len(a), pa.int64()), a, b)

    def again(key: int, used: int, marks: np.ndarray) -> pa.RecordBatch:
        n = len(marks)
        return told(n, pa.array(np.full(n, used, np.int64)), np.full((n, 1), key, np.int64), marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (key, used, mark) -> links (null, u, v); fingerprints of too large keys as (used, key, mark)."""
        open_key, open_used, held, size, flooded = None, 0, [], 0, False

        def close():
            if held and not flooded:
                marks = np.concatenate(held)
                if len(marks) > 1:
                    if len(marks) <= _SMALL:
                        for a, b in _shifted(np.zeros(len(marks), np.int64), marks, distance):
                            if len(a):
                                yield edges(a, b)
                    else:
                        a, b = _forest(marks, distance)
                        if len(a):
                            yield edges(a, b)

        for batch in batches:
            key, used, mark = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "used", "mark"))
            mark = mark.reshape(-1, 1)
            if alike:
                mark = np.column_stack([mark, batch.column("more").to_numpy(zero_copy_only=False)])
            mark = np.ascontiguousarray(mark).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            stops = np.r_[starts[1:], len(key)]
            # whole small groups, neither first nor last of the batch, at once
            inner = slice(starts[1], starts[-1]) if len(starts) > 2 else slice(0, 0)
            if inner.stop > inner.start:
                many = np.repeat(stops - starts, stops - starts)[inner] <= _SMALL
                for a, b in _shifted(key[inner][many], mark[inner][many], distance):
                    if len(a):
                        yield edges(a, b)
            for g, (begin, stop) in enumerate(zip(starts.tolist(), stops.tolist())) if len(starts) < 3 else [
                    (g, (int(starts[g]), int(stops[g]))) for g in np.flatnonzero((stops - starts > _SMALL) | (np.arange(len(starts)) % (len(starts) - 1) == 0))]:
                if key[begin] != open_key:
                    yield from close()
                    open_key, open_used, held, size, flooded = key[begin], int(used[begin]), [], 0, False
                held.append(mark[begin:stop])
                size += stop - begin
                if limit is not None and size > limit and open_used != -1:
                    yield again(int(open_key), open_used, np.concatenate(held))
                    held, flooded = [], True
        yield from close()
    return run


def _told(keyed: DataFrame, limit: int | None, distance: int, alike: bool) -> DataFrame:
    """The links of every key, and the fingerprints of keys that are too large."""
    return keyed.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(
        _link(limit, distance, alike), "used bigint, u bigint, u_more bigint, v bigint, v_more bigint")


def fingerprint_links(marks: DataFrame, limit: int = LIMIT, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (mark, perhaps more) -> links (u, v, u_more, v_more) that join all within the distance,
    directly or by a chain. With ``more``, the distance is ``LIKE`` at most."""
    if "more" in marks.columns:
        return _like_links(marks, limit, distance)
    level = marks.select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("used"), "mark")
    found = None
    while True:
        told = materialize(_told(level.mapInArrow(_variants, "key bigint, used bigint, mark bigint"), limit, distance, False), "links")
        links = told.filter("used is null").select("u", "v", "u_more", "v_more")
        found = links if found is None else found.unionByName(links)
        level = told.filter("used is not null").select(F.col("u").alias("key"), "used", F.col("v").alias("mark"))
        if level.isEmpty():
            return found.distinct()


def _like_links(marks: DataFrame, limit: int, distance: int) -> DataFrame:
    """Fingerprints of 128 bits: of a key with more than ``limit`` of them, blocks are compared two by two."""
    if distance > LIKE:
        raise ValueError(f"the index holds up to {LIKE} bits")
    keyed = marks.mapInArrow(_like_variants, "key bigint, mark bigint, more bigint").withColumn("used", F.lit(0).cast("bigint"))
    told = materialize(_told(keyed, limit, distance, True), "links")
    found = told.filter("used is null").select("u", "v", "u_more", "v_more")
    flooded = told.filter("used is not null").select(F.col("u").alias("key"), F.lit(0).cast("bigint").alias("used"), F.col("v").alias("mark"), F.col("v_more").alias("more"))
    if not flooded.isEmpty():
        counts = flooded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / limit).alias("blocks"))
        own, other = F.pmod(F.xxhash64("mark", "more"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        dealt = flooded.join(counts, "key").withColumn("own", own).withColumn("other", other)
        block = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        pairs = dealt.select(F.xxhash64("key", block).alias("key"), "used", "mark", "more")
        found = found.unionByName(materialize(_told(pairs, None, distance, True), "links").select("u", "v", "u_more", "v_more"))
    return found.distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, seed: int = SEED,
                limit: int = LIMIT, number: str | None = None, alike: bool = False) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, mark (fingerprint as a signed long), component (least mark), component_id.

    Fingerprints link at four or fewer differing bits; ``component_id`` is the smallest identifier that can be
    reached over links, the row's own included. Null and wordless texts have fingerprint zero, which is linked like
    any other; a null identifier is never a component's name unless it has no other. Repeated rows are all returned.
    An empty table gives no rows; other columns are not looked at. ``alike`` links by likeness instead: see the module.
    """
    uid = F.col(number) if number else F.monotonically_increasing_id()
    kind = dict(docs.dtypes)[doc_id]
    rows = materialize(
        docs.select(uid.alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
        .mapInArrow(_fingerprints(width, seed, alike), f"uid bigint, doc_id {kind}, mark bigint, more bigint")
        .withColumn("node", F.xxhash64("mark", "more") if alike else F.col("mark")), "marks")
    nodes = materialize(rows.groupBy("node", "mark", "more").agg(F.min("doc_id").alias("least")).coalesce(files_for(rows.count())), "nodes")
    if alike:
        links = fingerprint_links(nodes.select("mark", "more"), limit, LIKE).select(
            F.lit(0).alias("g"), F.xxhash64("u", "u_more").alias("u"), F.xxhash64("v", "v_more").alias("v"))
    else:
        links = fingerprint_links(nodes.select("mark"), limit).select(F.lit(0).alias("g"), "u", "v")
    parts = connected_components(links)
    labelled = nodes.join(parts.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(names, "component").select("node", "component", "component_id").coalesce(files_for(nodes.count())), "components")
    return rows.join(named, "node").select("uid", "doc_id", "mark", "component", "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, seed: int = SEED,
                  limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row. See :func:`near_groups`."""
    return near_groups(docs, text, doc_id, width, seed, limit).select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one row of each group of alike texts, the one with the smallest identifier (of repeated ones the
    first read), columns unchanged. Null and wordless texts are alike."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row")), "rows")
    narrow = rows.select("at", F.col("row")[text].alias("text"), F.col("row")[doc_id].alias("doc_id"))
    groups = near_groups(narrow, "text", "doc_id", seed=seed, limit=limit, number="at", alike=True)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("uid").alias("at"))
    return rows.join(kept.select("at"), "at", "left_semi").select("row.*")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., body) -> (..., shape, sorted hashes of the different shingles); ``shape`` is the same for equal sets."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(t)) for t in batch.column("body").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "body"}
        columns["shape"] = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
        columns["shingles"] = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(columns)


def _reached(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (i, j) between sets that share four fifths, which join all that chains of such links can reach.

    Every set is held once against those not reached yet, so a dense group costs little more than its size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    every = np.split(names, np.cumsum(sizes)[:-1])
    left = np.flatnonzero(sizes > 0)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        flat, owner = (np.concatenate([every[k] for k in left]), np.repeat(np.arange(len(left)), sizes[left])) if len(left) else (names[:0], names[:0])
        mark, there = np.zeros(len(names) + 1, bool), np.ones(len(left), bool)
        while queue and there.any():
            i = queue.pop()
            mark[every[i]] = True
            common = np.bincount(owner[mark[flat]], minlength=len(left))
            mark[every[i]] = False
            # c / (a + b - c) >= 4 / 5
            found = there & (9 * common >= 4 * (sizes[i] + sizes[left]))
            there &= ~found
            yield from ((i, int(j)) for j in left[found])
            queue += left[found].tolist()
            if 2 * there.sum() < len(left):
                keep = there[owner]
                flat, owner = flat[keep], (np.cumsum(there) - 1)[owner[keep]]
                left, there = left[there], np.ones(int(there.sum()), bool)
        left = left[there]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, part, shape, shingles), each part's next to each other -> links (g, u, v) of shapes."""
    here, shapes, sets = None, [], []

    def close():
        found = np.array(list(_reached(sets)), np.int64).reshape(-1, 2) if len(sets) > 1 else np.zeros((0, 2), np.int64)
        names = np.array(shapes, np.int64)
        return pa.RecordBatch.from_pydict({
            "g": pa.array(np.full(len(found), here[0] if here else 0, np.int64)), "u": pa.array(names[found[:, 0]]), "v": pa.array(names[found[:, 1]])})

    for batch in batches:
        group, part, shape = (batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in ("g", "part", "shape"))
        for k, at in enumerate(zip(group, part)):
            if at != here:
                yield close()
                here, shapes, sets = at, [], []
            shapes.append(shape[k])
            sets.append(batch.column("shingles")[k].values.to_numpy(zero_copy_only=False))
    yield close()


def shingle_links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Different (g, shape, shingles) -> links (g, u, v): within a group, all shapes that chains of pairs with four fifths
    of their shingles in common connect are connected by links. A group of more than ``block`` shingles is dealt into
    blocks, and every two of them are compared, so no task holds more than two."""
    weights = sets.groupBy("g").agg(F.ceil(F.sum(F.size("shingles") + 1) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("shape"), F.col("blocks").cast("bigint")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.join(weights, "g").withColumn("own", own).withColumn("other", other)
    part = F.least("own", "other").cast("bigint") * F.col("blocks") + F.greatest("own", "other")
    return dealt.select("g", part.alias("part"), "shape", "shingles").repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(
        _verify, "g bigint, u bigint, v bigint")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, limit: int = LIMIT,
                     block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest identifier (of repeated ones the
    first read), columns unchanged. Texts are near duplicates if they share four fifths of their different five-word
    shingles (a shorter text is one shingle), or by a chain of such texts; fingerprints only say which groups to look
    into. Null and wordless texts are alike."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row")), "rows")
    narrow = rows.select("at", F.col("row")[text].alias("text"), F.col("row")[doc_id].alias("doc_id"))
    groups = materialize(near_groups(narrow, "text", "doc_id", seed=seed, limit=limit, number="at", alike=True).select(
        F.col("uid").alias("at"), "doc_id", F.col("component").alias("g")), "groups")
    several = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    kind = dict(groups.dtypes)["doc_id"]
    shaped = materialize(
        groups.join(several, "g", "left_semi").join(narrow.select("at", F.col("text").cast("binary").alias("body")), "at").select("at", "doc_id", "g", "body")
        .mapInArrow(_shingle_sets, f"at bigint, doc_id {kind}, g bigint, shape bigint, shingles array<bigint>"), "shingles")
    parts = connected_components(shingle_links(shaped.groupBy("g", "shape").agg(F.any_value("shingles").alias("shingles")), block))
    verified = shaped.select("at", "doc_id", "g", "shape").join(parts.withColumnRenamed("node", "shape"), ["g", "shape"], "left").select(
        "at", "doc_id", "g", F.coalesce("component", "shape").alias("part"))
    alone = groups.join(several, "g", "left_anti").select("at", "doc_id", "g", F.lit(0).cast("bigint").alias("part"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at"))
    kept = verified.unionByName(alone).groupBy("g", "part").agg(first.alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("row.*")
