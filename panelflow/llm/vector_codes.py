"""Product-quantised vector codes, learned and assigned over dictionaries of integer values.

Vectors become integers and are stored in blocks: of each dimension a dictionary of the distinct integers in the block,
and for each vector its places in the dictionaries. A pass tabulates, dimension by dimension, the squared difference
of every dictionary value to all entries of the codebook; the distance of a part is then a gather and add of table rows, with no
arithmetic on the vectors themselves.

A round brings sums and counts by part, entry and place to Spark's aggregation; what reaches the driver is the
codebook alone, whose size does not depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import materialize, spread

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 8192  # vectors in a block
#: Integers are held within this bound, so that the squared distance of two vectors of 64 dimensions fits into a long.
BOUND = 1 << 27


def _integers(width: int, scale: int):
    """(vec_id, label, vec) -> blocks: count, values and sizes of the dictionaries, places of every vector by dimension."""
    def block(ids: pa.Array, labels: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        whole = np.clip(np.floor(flat.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64).reshape(-1, width)
        values, places = zip(*(np.unique(whole[:, d], return_inverse=True) for d in range(width)))
        return pa.RecordBatch.from_pydict({
            "ids": pa.ListArray.from_arrays([0, len(ids)], ids), "labels": pa.ListArray.from_arrays([0, len(ids)], labels),
            "sizes": pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
            "values": pa.array([np.concatenate(values)], pa.list_(pa.int64())),
            "places": pa.array([b"".join(p.astype("<u2").tobytes() for p in places)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                vectors = part.column("vec")
                yield block(part.column("vec_id"), part.column("label"), vectors.flatten().to_numpy(zero_copy_only=False))
    return run


def part_bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Consecutive parts, equal where ``parts`` divides the width, else the first ones longer by one."""
    cuts = np.cumsum([0, *(width // parts + (k < width % parts) for k in range(parts))]).tolist()
    return list(zip(cuts, cuts[1:]))


class _Block:
    """One stored block: distances and sums by gathers over its dictionaries."""

    def __init__(self, batch: pa.RecordBatch, row: int, width: int):
        self.ids, self.labels = batch.column("ids")[row].values, batch.column("labels")[row].values
        sizes = batch.column("sizes")[row].values.to_numpy()
        values = batch.column("values")[row].values.to_numpy()
        self.values = np.split(values, np.cumsum(sizes)[:-1])
        self.places = np.frombuffer(batch.column("places")[row].as_py(), "<u2").reshape(width, -1)

    def nearest(self, codebook: np.ndarray, bounds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The entry of a part's codebook (entries, width of the part) for each vector, and its squared distance."""
        distance = np.zeros((self.places.shape[1], len(codebook)), np.int64)
        for d in range(*bounds):
            table = (self.values[d][:, None] - codebook[None, :, d - bounds[0]]) ** 2
            distance += table[self.places[d]]
        best = distance.argmin(axis=1)  # the first of equal ones
        return best, distance[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, entries: int, bounds: tuple[int, int]) -> np.ndarray:
        """Sums by entry and place: members of each entry are counted by dictionary value, then weighed."""
        found = []
        for d in range(*bounds):
            size = len(self.values[d])
            counts = np.bincount(best * size + self.places[d], minlength=entries * size).reshape(entries, size)
            found.append(counts @ self.values[d])
        return np.array(found, np.int64).reshape(bounds[1] - bounds[0], entries).T


def _round(codebooks: list[np.ndarray], bounds: list[tuple[int, int]]):
    width = bounds[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), b - a), np.int64) for c, (a, b) in zip(codebooks, bounds)]
        members = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row, width)
                for k, (codebook, own) in enumerate(zip(codebooks, bounds)):
                    best, _ = block.nearest(codebook, own)
                    total[k] += block.sums(best, len(codebook), own)
                    members[k] += np.bincount(best, minlength=len(codebook))
        made = [(k, e, int(members[k][e]), total[k][e].tolist()) for k in range(len(bounds)) for e in np.flatnonzero(members[k]).tolist()]
        yield pa.RecordBatch.from_pydict({
            n: pa.array([m[i] for m in made], t) for i, (n, t) in enumerate(
                [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])})
    return run


def _assigned(codebooks: list[np.ndarray], bounds: list[tuple[int, int]]):
    width, digits = bounds[-1][1], 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row, width)
                found = [block.nearest(codebook, own) for codebook, own in zip(codebooks, bounds)]
                codes = np.stack([best for best, _ in found], axis=1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": block.ids, "label": block.labels,
                    "code": pa.array(["".join(f"{c:0{digits}x}" for c in line) for line in codes.tolist()], pa.string()),
                    "error": pa.array(sum(distance for _, distance in found), pa.int64())})
    return run


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    A component x is the integer floor(scale * x). A vector is cut into ``parts`` consecutive parts, each with a codebook
    that starts as that part of the vectors with the ``entries`` (256 at most) smallest identifiers and is moved ``rounds`` times to the
    floored means of the nearest parts; ties go to the lower entry, entries without parts stay. ``code`` holds two hex
    digits a part, ``error`` the squared distances summed over parts, ``label_error`` the errors of all rows with an
    equal label (null if beyond a long), ``codebooks_sha256`` the digest of the entries' integers.

    Vectors that are null, empty, or hold a null, NaN or infinite component are left out, as are those of another than
    the most frequent length (the larger of equally frequent ones); integers are held within 2**27. Null identifiers come last;
    of rows with equal ones those with smaller vectors come first. Repeated rows are all returned. An empty table gives
    no rows; other columns are not looked at. Fewer vectors than ``entries`` give shorter codebooks.
    """
    if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
        raise ValueError("entries is from 1 to 256, parts at least 1")
    kinds = dict(vectors.dtypes)
    limit = F.lit(float("inf"))
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    usable = given.filter(  # a null comparison counts as false: null components are not finite
        (F.size("vec") > 0) & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < limit), F.lit(False))))
    told = usable.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    names = f"vec_id {kinds[vec_id]}, label {kinds[label]}"
    if told is None:
        return vectors.sparkSession.createDataFrame([], f"{names}, code string, error bigint, label_error bigint, codebooks_sha256 string").drop("label")
    bounds = part_bounds(told.width, parts)
    kept = usable.filter(F.size("vec") == told.width)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    start = np.clip(np.floor(np.array([r.vec for r in first]) * scale), -BOUND, BOUND).astype(np.int64)
    codebooks = [start[:, a:b] for a, b in bounds]
    blocks = materialize(spread(kept).mapInArrow(
        _integers(told.width, scale),
        f"ids array<{kinds[vec_id]}>, labels array<{kinds[label]}>, sizes array<int>, values array<bigint>, places binary"), "blocks")
    for _ in range(rounds):
        moved = blocks.mapInArrow(_round(codebooks, bounds), "part int, entry int, n bigint, sums array<bigint>").select(
            "part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        means = moved.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
        codebooks = [c.copy() for c in codebooks]
        for m in means:
            codebooks[m.part][m.entry, m.place] = int(m.total) // m.n
    told = materialize(blocks.mapInArrow(_assigned(codebooks, bounds), f"{names}, code string, error bigint"), "codes")
    by_label = told.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()
    return told.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def vector_codes_sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL for vectors of ``width`` components, one pair of statements a round."""
    step = width // parts
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, k, w[k * {step} + 1 : (k + 1) * {step}] AS s
  FROM (SELECT vec_id, label, w, unnest(range({parts})) AS k FROM v) q),
c0 AS MATERIALIZED (SELECT e, k, w[k * {step} + 1 : (k + 1) * {step}] AS c
  FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, w FROM v ORDER BY vec_id LIMIT {entries}) q, range({parts}) t(k))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, min(d * {entries} + e) AS best
  FROM (SELECT r, e, list_sum(list_transform(list_zip(s, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM p JOIN c{n} USING (k)) q GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
m{n} AS MATERIALIZED (SELECT k, e, list(x ORDER BY i) AS c FROM (
  SELECT k, best % {entries} AS e, i, floor_div(sum(s[i])::BIGINT, count(*)) AS x
  FROM p JOIN a{n} USING (r), range(1, {step + 1}) t(i) GROUP BY ALL) q GROUP BY k, e),
c{n + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k, e))""")
    last = f"""
f AS (SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY k) AS code, sum(best // {entries})::BIGINT AS error
  FROM (SELECT dense_rank() OVER (ORDER BY (r - 1) // {parts}) AS g, * FROM p JOIN a{rounds} USING (r)) q GROUP BY g, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""
    text = ",".join(steps) + "," + last
    return "WITH" + text.replace("floor_div(sum(s[i])::BIGINT, count(*))", "((sum(s[i])::BIGINT - (sum(s[i])::BIGINT % count(*) + count(*)) % count(*)) // count(*))")
