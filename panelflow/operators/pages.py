"""Image candidates of web pages: harvest, screen, rescan, summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.media import absolute_url, background_url, resolve_source
from panelflow.functions.messages import fatal
from panelflow.functions.values import zero_means_default
from panelflow.operators.page_tree import page_elements
from panelflow.session import materialize, spread


def harvest_images(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> one row per image-bearing element in document order, with its address.

    See :func:`page_elements` for what counts as one, and for how display, visibility and opacity come down the tree.
    """
    raw = page_elements(spread(pages))
    element = F.col("element")
    source = (
        F.when(element == "img", resolve_source({n: F.col(n) for n in raw.columns}, F.col("url")))
        .when(element == "canvas", "canvas:").when(element == "svg", "inline-svg:")
        .otherwise(absolute_url(background_url(F.col("background")), F.col("url")))
    )
    return raw.select(
        "page_id", F.col("url").alias("page_url"), "position", "element",
        F.coalesce(source, F.lit("screen-capture:")).alias("source_url"),
        F.regexp_extract("width", r"^\d+", 0).try_cast("bigint").alias("width"),
        F.regexp_extract("height", r"^\d+", 0).try_cast("bigint").alias("height"),
        "visibility", "display", "opacity",
    )


def big_enough(width: Column, height: Column, min_width: Column, min_height: Column, force: Column | None = None) -> Column:
    """At least the set size (120 x 80 unless set, never below 40 x 30); ``force`` lets all pass."""
    fits = (width >= F.greatest(F.lit(40), zero_means_default(min_width, 120))) & (
        height >= F.greatest(F.lit(30), zero_means_default(min_height, 80)))
    return F.coalesce(fits, F.lit(False)) if force is None else force | F.coalesce(fits, F.lit(False))


def visible(visibility: Column, display: Column, opacity: Column, done: Column) -> Column:
    return (visibility != "hidden") & (display != "none") & (opacity > 0.05) & ~F.coalesce(done, F.lit(False))


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose page and source were not scanned before."""
    return candidates.join(seen.select("page_id", "source_url"), ["page_id", "source_url"], "left_anti")


def match_requested(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, page_id, url) -> the first element of the page showing that picture."""
    first = candidates.groupBy("page_id", "source_url").agg(
        F.min("position").alias("position"), F.min_by("element", "position").alias("element"))
    return requests.join(first, (requests["page_id"] == first["page_id"]) & (requests["url"] == first["source_url"])).select(
        "request_id", requests["page_id"], "url", "position", "element")


def rescan_rounds(
    candidates: DataFrame, process: Callable[[DataFrame], DataFrame], rounds: int = 3
) -> DataFrame:
    """Process what each round newly shows; candidates carry ``appears`` (first round to show them).

    ``process`` maps candidates to results that keep page_id and source_url and add
    ``error``. A page with a fatal error takes no part in later rounds. Candidates are written once: what finds
    them, the walk through every page, must not run again for each round.
    """
    candidates = materialize(candidates, "candidates")
    done = None
    for number in range(rounds):
        shown = candidates.where(F.col("appears") <= number)
        if done is not None:
            stopped = done.where(fatal(F.col("error"))).select("page_id").distinct()
            shown = unseen(shown, done).join(stopped, "page_id", "left_anti")
        results = materialize(process(shown).withColumn("round", F.lit(number)), "round")
        if results.isEmpty():
            break
        done = results if done is None else done.unionByName(results)
    return results if done is None else done


def page_summary(results: DataFrame) -> DataFrame:
    """Per page: what was processed, and whether the whole page failed."""
    small, failed = F.coalesce("skipped_small", F.lit(False)), F.col("error").isNotNull()
    return results.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~small & ~failed & (F.col("regions") > 0)).alias("translated"),
        F.coalesce(F.sum(F.when(~small & ~failed, F.col("regions"))), F.lit(0)).alias("phrases"),
        F.count_if(~small & failed).alias("failed"),
        F.count_if(small).alias("small"),
        F.bool_or(fatal(F.col("error"))).alias("fatal"),
    ).withColumn("run_failed", (F.col("failed") == F.col("processed")) | F.col("fatal"))
