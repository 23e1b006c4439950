"""Mixing sources to target weights: capped water-filling, whole and fractional repetitions.

Targets: every source gets its share of the budget by weight; one that would be repeated more than ``max_epochs``
times is clamped there and its excess goes to the others by weight, until none is above. In order of cap over
weight the clamped sources come first, so the water level after clamping the first k of them is one running sum,
and the level that holds is the largest of these.

Repetitions: a source is taken ``whole`` times; the rest of its target is a random part of it, taken in the order
of a seeded hash until the target is full. Where that order is cut is found on sums of hash ranges, then inside one
range; the document at the cut is taken in part. The outcome is one small rule for each source, so texts are never
shuffled and a source may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.ordered import numbered, running_sum
from panelflow.session import files_for, materialize

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20_240_501
RANGE_ROWS = 8_192  # rows of the largest source that one hash range holds on average
_WORD = r"[^\x20\x09-\x0D]+"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len((t or b"").split()) for t in batch.column("body").to_pylist()], pa.int64())  # bytes: ASCII blanks
        names = [n for n in batch.schema.names if n != "body"]
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in names}, "size": sizes})


def _score(text: str, doc_id: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def _measured(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    kinds = dict(docs.dtypes)
    return materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _score(text, doc_id, seed).alias("score"),
                    F.col(text).cast("binary").alias("body"))
        .mapInArrow(_sizes, f"doc_id {kinds[doc_id]}, source {kinds[source]}, score bigint, size bigint"), "sizes")


def _in_blocks(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` in a written table with ``block``, which rises with ``order``: no task holds all sources."""
    return materialize(rows.repartitionByRange(files_for(rows.count()), order).withColumn("block", F.spark_partition_id()), "blocks")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``: words the source should give.

    Weights repeat over the sources in the order of their names by code point, null last; the budget is a share of
    all words. A budget beyond all caps takes every source up to its cap.
    """
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    named = F.col("source").asc_nulls_last()
    placed = numbered(_in_blocks(sizes, named), [], [named], "place", F.col("block"))
    ranked = materialize(placed.select(
        "source", "source_size", "place", F.get(ladder, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "ranked")
    words, caps, weight = ranked.agg(F.sum("source_size"), F.sum("cap"), F.sum("weight")).first()
    if words is None or words * float(budget) >= caps:
        return ranked.select("source", "source_size", F.col("cap").alias("target"))
    need = F.struct(F.col("cap") / F.col("weight"), "place")
    ladder_up = _in_blocks(ranked.withColumn("need", need), F.col("need"))
    summed = running_sum(running_sum(ladder_up, [], "need", F.col("cap"), "caps", F.col("block")), [], "need", F.col("weight"), "below", F.col("block"))
    # the level once all sources of lesser need are clamped
    level = (F.lit(words * float(budget)) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - (F.col("below") - F.col("weight")))
    water = summed.agg(F.max(level)).first()[0]
    return ranked.select("source", "source_size", F.least("cap", F.lit(water) * F.col("weight")).alias("target"))


def _rules(measured: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """source -> source_size, target, whole, cut (hash where the fractional repetition ends), part and tied.

    A source whose target is whole repetitions only has no cut. Documents below ``cut`` are taken once more; those at it, ``tied`` words in all, give ``part`` words together.
    """
    by_source = materialize(measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    most = by_source.agg(F.max("n").alias("n")).first().n or 0
    bits = max(0, math.ceil(math.log2(max(1, most / RANGE_ROWS))))
    goal = F.round("target").cast("bigint")
    wanted = targets(by_source.select("source", "source_size"), weights, budget, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    ).withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    wanted = materialize(wanted, "targets")
    span = F.shiftright("score", 64 - bits) if bits else F.lit(0).cast("bigint")
    ranges = measured.withColumn("span", span).groupBy("source", "span").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    inside = lambda: (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    edge = materialize(
        ranges.join(wanted.select("source", "rest").filter("rest > 0"), same(ranges, wanted), "inner").filter(inside())
        .select(ranges["source"], "span", "before", "rest"), "edges")
    rows = measured.withColumn("span", span)
    near = rows.join(edge, same(rows, edge) & (rows["span"] == edge["span"])).select(rows["source"], "score", "size", F.col("before").alias("base"), "rest")
    scores = near.groupBy("source", "score", "base", "rest").agg(F.sum("size").alias("words"))
    below = Window.partitionBy("source").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        scores.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(below), F.lit(0))).filter(inside())
        .select("source", F.col("score").alias("cut"), (F.col("rest") - F.col("before")).alias("part"), F.col("words").alias("tied"))
    )
    return materialize(
        wanted.join(cuts, same(wanted, cuts), "left").select(wanted["source"], "source_size", "target", "whole", "cut", "part", "tied"), "rules")


def _more(size) -> tuple:
    """(taken once more as a whole, words taken of the document at the cut)."""
    once = F.coalesce(F.col("score") < F.col("cut"), F.lit(False))
    partly = F.when(F.col("score") == F.col("cut"), F.floor(size * F.col("part") / F.col("tied"))).otherwise(0).cast("bigint")
    return once, F.coalesce(partly, F.lit(0).cast("bigint"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
        budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, taken.

    Null texts have no words and give none. A null source is a source like any other, the last by name. Rows that
    repeat identifier and text are taken alike; at the cut they share what is left, rounded down. An empty table
    gives no rows; other columns are not looked at. The same seed gives the same mix, in any order of the rows.
    """
    measured = _measured(docs, text, source, doc_id, seed)
    rules = _rules(measured, weights, budget, max_epochs)
    once, partly = _more(F.col("size"))
    return measured.join(rules, measured["source"].eqNullSafe(rules["source"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.when(once, F.col("size")).otherwise(0) + partly).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", length: str | None = None,
                    weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged.

    The document at a source's cut also gives a row of its first words, joined by one space; ``length`` names a
    column that then takes the new text's length.
    """
    rules = _rules(_measured(docs, text, source, doc_id, seed), weights, budget, max_epochs)
    rows = docs.select(F.struct("*").alias("row"), _score(text, doc_id, seed).alias("score"))
    ruled = rows.join(rules, rows["row"][source].eqNullSafe(rules["source"]))
    words = F.regexp_extract_all(F.coalesce(F.col("row")[text], F.lit("")), F.lit(_WORD), F.lit(0))
    once, partly = _more(F.when(F.col("score") == F.col("cut"), F.size(words)))
    counted = ruled.select("row", (F.col("whole") + once.cast("bigint")).cast("int").alias("times"), partly.cast("int").alias("words_more"))
    row = F.col("row")
    short = F.array_join(F.slice(words, F.lit(1), F.col("words_more")), " ")
    cut = row.withField(text, short)
    cut = cut.withField(length, F.length(short).cast(dict(docs.dtypes)[length])) if length else cut
    copies = F.concat(F.array_repeat(row, F.col("times")), F.when(F.col("words_more") > 0, F.array(cut)).otherwise(F.array().cast(f"array<{docs.schema.simpleString()}>")))
    return counted.select(F.explode_outer(copies).alias("row")).filter("row is not null").select("row.*")

