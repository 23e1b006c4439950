"""Translate-and-review loop over work items: bounded rounds, fallback, content-addressed cache.

A work item is one row with its region set as an array. Model passes are pluggable
(:class:`Translator`, :class:`Reviewer`, :class:`Renderer`); each round's answers are
written to the shared folder once, so a lost task never asks a model twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.schemas import MIN_CONFIDENCE, REGION_FIELDS, REGION_TYPE
from panelflow.session import materialize

# What an outcome says when there was no usable review.
CALL_FAILED = "시각 검수 호출 실패"
CALL_FAILED_ISSUE = "시각 검수 결과를 받지 못해 사용자 확인이 필요함"
SKIPPED_SUMMARY = "사용자 설정으로 시각 검수를 생략했습니다."
NO_RESULT = "검수 결과 없음"
DEFAULT_ATTEMPTS = 3  # of an item whose plan names none

REGIONS_TYPE = f"array<{REGION_TYPE}>"
_COLUMNS = sorted(column for _, column, _ in REGION_FIELDS)


# ------------------------------------------------------------- regions as arrays

def region_signature(regions: Column) -> Column:
    """Hash of the ordered regions with their fields in name order."""
    named = F.transform(regions, lambda r: F.struct(*[r[c].alias(c) for c in _COLUMNS]))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def cache_key(content_hash: Column, signature: Column) -> Column:
    """Address of a rendering: the picture's bytes (as their hash) and the regions."""
    return F.sha2(F.concat(content_hash, signature), 256)


def _sure(region: Column) -> Column:
    """The confidence; none for null and for what is no number."""
    return F.nanvl(F.coalesce(region["confidence"], F.lit(0.0)), F.lit(0.0))


def reliable_regions(regions: Column, minimum: float = MIN_CONFIDENCE) -> Column:
    return F.filter(F.coalesce(regions, F.array().cast(REGIONS_TYPE)),
                    lambda r: _sure(r) >= minimum)


def mean_confidence(regions: Column) -> Column:
    total = F.aggregate(regions, F.lit(0.0), lambda acc, r: acc + _sure(r))
    return F.when(F.size(regions) > 0, total / F.size(regions))


# ----------------------------------------------------------------- model surface

class Translator(Protocol):
    def translate(self, texts: DataFrame) -> DataFrame:
        """(keys..., original) -> the same rows with ``translated`` and ``error``."""


class Reviewer(Protocol):
    def review(self, pending: DataFrame) -> DataFrame:
        """(work_id, attempt, regions, rendered) -> (work_id, passed, summary, issues, regions, error)."""


class Renderer(Protocol):
    def render(self, wanted: DataFrame) -> DataFrame:
        """(cache_key, content_hash, regions) -> (cache_key, rendered binary)."""


def _by_halves(
    function: Callable[[pd.DataFrame], pd.DataFrame], batch: pd.DataFrame, failed: Callable[[pd.DataFrame, str], pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """The function's answers with no error; of a batch that fails the halves are tried, down to the rows at fault."""
    parts = [batch]
    while parts:
        part = parts.pop()
        try:
            answer = function(part).assign(error=None)
        except Exception as error:  # one bad row must not stop the job, nor fail its neighbours
            half = len(part) // 2
            if half:
                parts += [part.iloc[half:], part.iloc[:half]]
                continue
            answer = failed(part, f"{type(error).__name__}: {error}")
        yield answer


class FunctionTranslator:
    """Calls a Python function on Arrow batches of at most ``parallelism`` partitions; a bad row fails alone."""

    def __init__(self, function: Callable[[pd.DataFrame], pd.DataFrame], parallelism: int | None = None):
        self.function, self.parallelism = function, parallelism

    def translate(self, texts: DataFrame) -> DataFrame:
        function = self.function

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _by_halves(function, batch, lambda part, error: part.assign(translated=None, error=error))

        source = texts if self.parallelism is None else texts.repartition(self.parallelism)
        schema = ", ".join([*(f"`{n}` {k}" for n, k in texts.dtypes), "translated string, error string"])
        return source.mapInPandas(run, schema=schema)


class LexiconTranslator:
    """Word-by-word translation through a (token, target) table; unknown words stay.

    Texts are dealt out by row once, before they are cut into words: where Spark broadcasts the lexicon, the words of
    a row meet again in the task that has its text, and no word is shuffled.
    """

    def __init__(self, lexicon: DataFrame):
        self.lexicon = lexicon

    def translate(self, texts: DataFrame) -> DataFrame:
        rows = materialize(texts.withColumn("__row", F.monotonically_increasing_id()), "texts").repartition("__row")
        words = rows.select("__row", F.posexplode(F.filter(
            F.split("original", r"(?U)\s+"), lambda w: w != "")).alias("__at", "token"))
        lexicon = self.lexicon.groupBy("token").agg(F.min("target").alias("target"))
        placed = words.join(lexicon, "token", "left").select(
            "__row", F.struct("__at", F.coalesce("target", "token").alias("word")).alias("__w"))
        joined = placed.groupBy("__row").agg(F.array_join(
            F.transform(F.sort_array(F.collect_list("__w")), lambda w: w["word"]), " ").alias("translated"))
        return rows.join(joined, "__row", "left").drop("__row").withColumn(
            "translated", F.coalesce("translated", F.lit(""))).withColumn("error", F.lit(None).cast("string"))


class RuleReviewer:
    """Passes a work item when every region is at least ``minimum`` sure; raises the others by ``step``.

    ``fails`` (a condition on the pending columns) makes the call itself fail.
    """

    def __init__(self, minimum: float = 0.6, step: float = 0.25, fails: Column | None = None):
        self.minimum, self.step = minimum, step
        self.fails = F.lit(False) if fails is None else fails

    def review(self, pending: DataFrame) -> DataFrame:
        weak = F.filter("regions", lambda r: _sure(r) < self.minimum)
        raised = F.transform("regions", lambda r: F.when(
            _sure(r) < self.minimum,
            r.withField("confidence", F.round(F.least(F.lit(1.0), _sure(r) + self.step), 6)),
        ).otherwise(r))
        return pending.select(
            "work_id", (F.size(weak) == 0).alias("passed"),
            F.concat(F.size(weak).cast("string"), F.lit(" weak")).alias("summary"),
            F.transform(weak, lambda r: F.concat(F.lit("weak: "), r["original"])).alias("issues"),
            raised.alias("regions"), F.when(self.fails, "call failed").alias("error"))


class FunctionReviewer:
    """A reviewer calling a Python function on batches; failures become the ``error`` column, row by row."""

    ANSWER = f"passed boolean, summary string, issues array<string>, regions {REGIONS_TYPE}, error string"

    def __init__(self, function: Callable[[pd.DataFrame], pd.DataFrame]):
        self.function = function

    def review(self, pending: DataFrame) -> DataFrame:
        function = self.function

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _by_halves(function, batch, lambda part, error: pd.DataFrame(
                    {"work_id": part["work_id"], "passed": None, "summary": None, "issues": None, "regions": None, "error": error}))

        return pending.mapInPandas(run, schema=f"work_id {dict(pending.dtypes)['work_id']}, {self.ANSWER}")


class FunctionRenderer:
    """Renders batches missing from the cache through a Python function (bytes per row).

    A batch that fails is tried again row by row; a row that fails has no rendering.
    """

    def __init__(self, function: Callable[[pd.DataFrame], pd.Series]):
        self.function = function

    def render(self, wanted: DataFrame) -> DataFrame:
        function = self.function

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    rendered = list(function(batch))
                except Exception:
                    rendered = []
                    for place in range(len(batch)):
                        try:
                            rendered += list(function(batch.iloc[place:place + 1]))
                        except Exception:  # one bad picture must not stop the job
                            rendered.append(None)
                yield pd.DataFrame({"cache_key": batch["cache_key"].to_numpy(), "rendered": pd.Series(rendered, dtype=object)})

        return wanted.mapInPandas(run, schema="cache_key string, rendered binary")


# ------------------------------------------------------------------------ stages

def with_fallback(previous: DataFrame, answers: DataFrame, key: str = "work_id") -> DataFrame:
    """An optional pass: its regions where it answered, else those of the pass before."""
    got = answers.select(key, F.when(F.col("error").isNull(), F.col("regions")).alias("__regions"),
                         F.col("error").alias("pass_error"))
    return previous.join(got, key, "left").withColumn(
        "regions", F.coalesce("__regions", "regions")).drop("__regions")


def cached_renderings(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found with ``rendered``, still to render): hits unless ``bypass``; one row per address to render.

    Only the wanted addresses are fetched from the cache, and each of them once, whatever it holds twice: its rendering
    of the latest ``round``, if the cache has that column.
    """
    asked = wanted.where(~F.col("bypass")).select("cache_key").distinct()
    age = F.col("round") if "round" in cache.columns else F.lit(0)
    held = cache.where("rendered is not null").join(asked, "cache_key", "left_semi").groupBy("cache_key").agg(
        F.min(F.struct((-age).alias("age"), "rendered")).getField("rendered").alias("rendered"))
    hits = wanted.where(~F.col("bypass")).join(held, "cache_key")
    misses = wanted.join(hits.select("work_id"), "work_id", "left_anti").groupBy("cache_key").agg(
        F.min("content_hash").alias("content_hash"), F.min_by("regions", "work_id").alias("regions"))
    return hits, misses


def _empty_cache(work: DataFrame) -> DataFrame:
    return work.sparkSession.createDataFrame([], "cache_key string, rendered binary")


def review_loop(
    work: DataFrame, reviewer: Reviewer, renderer: Renderer, cache: DataFrame | None = None,
) -> DataFrame:
    """Run the render / review / correct rounds and decide the final rendering.

    ``work``: (work_id, content_hash, regions, mode, max_attempts, optional cancelled), one row per ``work_id``.
    Every item that is not cancelled comes out once. Each round is set-based over everything
    still pending, and rounds go on until nothing is: ``max_attempts`` alone limits them, and
    an item without one gets ``DEFAULT_ATTEMPTS``. A rendering the renderer does not give
    counts as a failed call. ``final`` says what is left to do: reuse the reviewed rendering,
    render once more (``final_bypass``: not from the cache), or nothing when no region is left.
    """
    cache = (_empty_cache(work) if cache is None else cache.select("cache_key", "rendered")).withColumn("round", F.lit(0))
    active = work if "cancelled" not in work.columns else work.where(~F.coalesce("cancelled", F.lit(False)))
    start = materialize(
        active.select("work_id", "content_hash", "mode",
                      F.coalesce(F.col("max_attempts").cast("int"), F.lit(DEFAULT_ATTEMPTS)).alias("max_attempts"),
                      reliable_regions(F.col("regions").cast(REGIONS_TYPE)).alias("regions")).select(
            "*", F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("summary"),
            F.array().cast("array<string>").alias("issues"), F.lit(0).alias("attempts"),
            F.lit(None).cast("string").alias("rendered_signature"), F.lit(0).alias("n_rendered"), F.lit(0).alias("n_cached")),
        "work")
    waiting = (F.size("regions") > 0) & (F.col("max_attempts") > 0)
    finished = start.where(~waiting)
    pending, attempt = start.where(waiting), 0
    while not pending.isEmpty():
        attempt += 1
        signature = region_signature(F.col("regions"))
        signed = pending.withColumn("signature", signature).withColumn("cache_key", cache_key(F.col("content_hash"), F.col("signature")))
        signed = signed.withColumn("bypass", F.coalesce(~F.col("passed") & (F.col("signature") == F.col("rendered_signature")), F.lit(False)))
        wanted = signed.select("work_id", "cache_key", "content_hash", "regions", "bypass")
        hits, misses = cached_renderings(wanted, cache)
        fresh = materialize(
            renderer.render(misses).where("rendered is not null").groupBy("cache_key").agg(F.min("rendered").alias("rendered")), "rendered")
        old = hits.select("cache_key", "rendered").dropDuplicates(["cache_key"]).join(fresh.select("cache_key"), "cache_key", "left_anti")
        shown = signed.join(
            fresh.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False))), "cache_key", "left")
        cache = cache.unionByName(fresh.withColumn("round", F.lit(attempt)))  # a flat list of tables; lookups take the latest round
        answers = reviewer.review(shown.where("rendered is not null").select(
            "work_id", F.lit(attempt).alias("attempt"), "regions", "rendered", "mode", "max_attempts"))
        told = answers.select("work_id", F.col("passed").alias("__passed"), F.col("summary").alias("__summary"),
                              F.col("issues").alias("__issues"), F.col("regions").alias("__regions"), F.col("error").alias("__error"))
        told = told.dropDuplicates(["work_id"])
        joined = shown.drop("rendered").join(told, "work_id", "left").withColumn(
            "__ok", F.col("__passed").isNotNull() & F.col("__error").isNull())
        ok = F.col("__ok")
        reviewed = materialize(joined.select(
            "work_id", "content_hash", "mode", "max_attempts",
            reliable_regions(F.when(ok, F.col("__regions")).otherwise(F.col("regions"))).alias("regions"),
            F.when(ok, F.col("__passed")).otherwise(False).alias("passed"),
            F.when(ok, F.col("__summary")).otherwise(CALL_FAILED).alias("summary"),
            F.when(ok, F.coalesce("__issues", F.array().cast("array<string>"))).otherwise(F.array(F.lit(CALL_FAILED_ISSUE))).alias("issues"),
            F.lit(attempt).alias("attempts"), F.when(F.col("fresh").isNotNull(), F.col("signature")).alias("rendered_signature"),
            (F.col("n_rendered") + F.coalesce("fresh", F.lit(False)).cast("int")).alias("n_rendered"),
            (F.col("n_cached") + F.coalesce(~F.col("fresh"), F.lit(False)).cast("int")).alias("n_cached"),
        ), f"round{attempt}")
        over = F.col("passed") | (F.col("max_attempts") <= attempt)
        finished = finished.unionByName(reviewed.where(over))
        pending = reviewed.where(~over)
    return _outcome(finished)


def _outcome(rows: DataFrame) -> DataFrame:
    skipped = F.col("mode") == "skipped"
    passed = F.coalesce("passed", F.lit(False))
    same = F.coalesce(region_signature(F.col("regions")) == F.col("rendered_signature"), F.lit(False))
    nothing = F.size("regions") == 0
    return rows.select(
        "work_id", F.when(~skipped, passed).alias("passed"), skipped.alias("skipped"), "attempts", "mode",
        (~skipped & ~passed & (F.col("attempts") > 0)).alias("requires_user_review"),
        F.when(skipped, SKIPPED_SUMMARY).otherwise(F.coalesce("summary", F.lit(NO_RESULT))).alias("summary"),
        "issues", "regions", mean_confidence(F.col("regions")).alias("average_confidence"),
        F.when(nothing, "none").when(passed & same, "reuse").otherwise("render").alias("final"),
        (~nothing & ~passed & same).alias("final_bypass"), "n_rendered", "n_cached",
    )


def manual_review_round(
    status: DataFrame, requests: DataFrame, work: DataFrame, reviewer: Reviewer, renderer: Renderer,
) -> DataFrame:
    """Reviews asked for while the main job ran: each eligible image once, one attempt.

    ``status``: (archive, image_number, source, state, review_queued); ``requests``: (archive,
    image_number), possibly repeated; ``work``: (archive, image_number, work_id, content_hash,
    regions). Returns the status with the reviewed rows updated to done or review.
    """
    from panelflow.operators.status import reviewable

    yes = F.lit(True)
    eligible = status.where(reviewable(
        F.col("source"), F.col("state"), F.col("review_queued"), yes, yes, yes)).select("archive", "image_number")
    asked = requests.select("archive", "image_number").distinct().join(eligible, ["archive", "image_number"], "left_semi")
    queue = work.join(asked, ["archive", "image_number"]).withColumn("mode", F.lit("manual")).withColumn("max_attempts", F.lit(1))
    told = review_loop(queue, reviewer, renderer).join(queue.select("work_id", "archive", "image_number"), "work_id").select(
        "archive", "image_number", F.when(F.col("requires_user_review"), "review").otherwise("done").alias("__state"),
        (F.size("regions") > 0).alias("changed"), F.col("summary").alias("detail"))
    return status.join(told, ["archive", "image_number"], "left").withColumn(
        "state", F.coalesce("__state", "state")).withColumn("reviewed", F.col("__state").isNotNull()).drop("__state")
