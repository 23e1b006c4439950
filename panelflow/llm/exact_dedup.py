"""Exact deduplication: sorted digest runs merged in binomial rounds.

Every input partition is a run of digests. In round ``r`` the ``fan_in`` runs of one family exchange entries: the
entry goes to the member of the family that its digest's next digit names, where the runs are merged and equal
digests collapse to the best identifier so far and a count. After ``log(runs) / log(fan_in)`` rounds each digest has
met all its copies, and the answers go back down the same tree. A level never sees more than ``fan_in`` entries of
one digest, so a group that holds a third of all rows is as cheap as any other.

Entries merge only when the SHA-256, an independent 64-bit hash and the byte length all agree, at every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.session import files_for, materialize

FAN_IN = 16
KEY = ["sha", "check", "n_bytes"]
_RUN_BITS = 33  # monotonically_increasing_id holds the partition above these bits


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(value or b"").lower() for value in batch.column("body").to_pylist()]  # bytes: A-Z only
        rest = batch.select([n for n in batch.schema.names if n != "body"])
        columns = {name: rest.column(name) for name in rest.schema.names}
        columns["sha"] = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        columns["check"] = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
        columns["n_bytes"] = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def _node(level: int, fan_in: int) -> Column:
    """Where an entry is merged in round ``level``: the family of its run, and the member its digest names."""
    width = F.lit(fan_in**level)
    family = F.floor(F.col("run") / width).cast("bigint")
    return family * width + F.pmod(F.xxhash64("sha"), width)


def digest_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", fan_in: int = FAN_IN,
                  number: str | None = None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, sha, keep_uid, keep_id, group_size.

    Texts are equal when they are the same bytes after lower-casing A-Z; null counts as empty. ``keep`` names the
    identifier that stays, 'smallest' or 'largest'; a null identifier stays only if its group has no other, and of
    repeated rows with the same identifier the first read stays. ``uid`` tells repeated rows apart. An empty table
    gives no rows; columns other than the two named are not looked at, whatever their names. ``number`` may name a
    stored ``monotonically_increasing_id`` to be used as ``uid``.
    """
    if keep not in ("smallest", "largest") or fan_in < 2:
        raise ValueError("keep is 'smallest' or 'largest', fan_in at least 2")
    uid = F.col(number) if number else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = dict(docs.dtypes)[doc_id]
    leaves = materialize(
        rows.mapInArrow(_digest, f"uid bigint, doc_id {kind}, sha binary, check bigint, n_bytes bigint")
        .withColumn("run", F.shiftright("uid", _RUN_BITS)), "digests")
    sign, best = (F.lit(-1), F.max) if keep == "largest" else (F.lit(1), F.min)
    rank = F.struct(  # non-null identifiers first, then the identifier, then the row read first
        (F.col("doc_id").isNull().cast("int") * sign).alias("no_id"), F.col("doc_id"), (F.col("uid") * sign).alias("row"))
    told = leaves.agg(F.max("run").alias("r"), F.count(F.lit(1)).alias("n")).first()
    last, files = told.r or 0, files_for(told.n)
    entries, level, levels = leaves.select("run", *KEY, rank.alias("best"), F.lit(1).cast("bigint").alias("n")), 0, []
    while level == 0 or fan_in**level <= last:
        level += 1
        merged = (
            entries.withColumn("node", _node(level, fan_in)).groupBy("node", *KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"), F.min("run").alias("run"))
            .coalesce(files).sortWithinPartitions("node", *KEY)
        )
        entries = materialize(merged, f"run{level}")
        levels.append(entries)
    answer = entries.filter("n > 1").select("node", *KEY, F.col("best").alias("top"), F.col("n").alias("total"))
    for level in range(len(levels) - 1, 0, -1):  # back down: the same families, at most fan_in entries each
        below = levels[level - 1].select(F.col("node").alias("below"), *KEY, _node(level + 1, fan_in).alias("node"))
        answer = materialize(below.join(answer, ["node", *KEY]).select(F.col("below").alias("node"), *KEY, "top", "total").coalesce(files), f"answer{level}")
    told = leaves.withColumn("node", _node(1, fan_in)).join(answer, ["node", *KEY], "left")
    alone = F.col("total").isNull()
    return told.select(
        "uid", "doc_id", "sha",
        F.when(alone, F.col("uid")).otherwise(F.col("top.row") * sign).alias("keep_uid"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("total", F.lit(1)).cast("bigint").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """The verdict on every row: doc_id, keep_id, group_size, kept, text_sha256. See :func:`digest_groups`."""
    return digest_groups(docs, text, doc_id, keep, fan_in).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    The rows are written once with their number, so that the verdict meets the very row it was made for.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row")), "rows")
    narrow = rows.select("at", F.col("row")[text].alias("text"), F.col("row")[doc_id].alias("doc_id"))
    kept = digest_groups(narrow, "text", "doc_id", keep, fan_in, number="at").filter("uid = keep_uid")
    return rows.join(kept.select(F.col("uid").alias("at")), "at", "left_semi").select("row.*")
