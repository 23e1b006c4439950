"""The user-level jobs: whole pipelines put together from the operators."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelflow.functions.text import output_name
from panelflow.operators import archives as a, crops as c, diagnostics as d, pages as p, raster as r, regions as g, status as s
from panelflow.operators.captions import fit_captions, overflow_rates
from panelflow.schemas import MIN_CONFIDENCE
from panelflow.session import materialize, qualified
from panelflow.sources import archives as source
from panelflow.sources.model_json import scan_regions

NO_ANSWER = "no answer"  # the error of an image that could not be read or was not answered

__all__ = [
    "ImageTranslator", "clean_regions", "plan_batches", "process_archives", "apply_manual_reviews", "status", "diagnose_runs", "harvest",
    "fit_captions", "overflow_rates", "screen_pages",
]


def clean_regions(
    answers: DataFrame, image_width: Column, image_height: Column, minimum: float = MIN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(image_id, output) -> (clean pixel regions, quarantine).

    The quarantine also holds regions that were not sure enough (violation ``unreliable``).
    """
    regions, quarantine = scan_regions(answers)
    accepted, rejected = g.split_reliable(regions, minimum)
    unsure = rejected.select("image_id", "ord", F.array(F.lit("unreliable")).alias("violations"))
    normal = g.normalize_regions(accepted, image_width, image_height)
    return g.dedup_regions(normal), quarantine.select("image_id", "ord", "violations").unionByName(unsure)


def plan_batches(
    regions: DataFrame, image_width: Column, image_height: Column, maximum_tiles: int = c.MAX_TILES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions -> (crops, tiles on their sheets, regions in the frame of their sheet)."""
    crops = materialize(c.plan_crops(regions, image_width, image_height), "crops")
    tiles = materialize(c.layout_batches(c.pack_batches(crops, maximum_tiles=maximum_tiles)), "tiles")
    inside = c.crop_regions(crops, regions, image_width, image_height)
    return crops, tiles, c.sheet_regions(tiles, inside)


class ImageTranslator(Protocol):
    def translate(self, images: DataFrame) -> DataFrame:
        """(archive, entry_index, image_number, name, data) -> (archive, entry_index, new_data,
        changed, region_count, review_required, attempts, error, cancelled)."""


def process_archives(
    spark: SparkSession, path: str, folder: str, translator: ImageTranslator, skips: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Translate the archives under ``path`` into ``folder``: (entry outcomes, summary, problems).

    ``skips`` lists (archive, image_number); they are looked up before the model is asked,
    and win over whatever it says. An archive with a cancelled entry or without any image
    is not written, nor is one with an entry that cannot be read; an image without an answer
    has failed. Outputs are named ``<stem>_ko.zip`` in the folders they come from; of archives
    that would share a name the first is written and the others are problems.
    """
    folder = source.make_folder(spark, folder)
    listed = materialize(source.scan_archives(spark, path), "listing")
    broken = listed.where("problem is not null").select("archive", "problem")
    whole = listed.where("problem is null").drop("problem")
    base = F.lit(qualified(spark, path) + "/")
    below = F.when(F.col("archive").startswith(base), F.substring(F.col("archive"), F.length(base) + 1, F.length("archive"))).otherwise(
        F.regexp_extract("archive", "([^/]+)$", 1))
    named = materialize(whole.select("archive").distinct().withColumn("output", output_name(below)).withColumn(
        "place", F.row_number().over(Window.partitionBy("output").orderBy("archive"))), "names")
    taken = named.where("place > 1").select("archive", F.concat(F.lit("output name taken: "), "output").alias("problem"))
    empty = a.archives_without_images(whole)
    images = a.number_images(whole).select("archive", "entry_index", "image_number", "name")
    skipped = images.limit(0) if skips is None else images.join(skips, ["archive", "image_number"], "left_semi")
    asked = images.join(skipped.select("archive", "entry_index"), ["archive", "entry_index"], "left_anti")
    contents = source.read_entries(asked).where("read_problem is null").drop("read_problem")
    answers = materialize(translator.translate(asked.join(contents, ["archive", "entry_index"])), "answers")
    told = answers.withColumn("__told", F.lit(True))
    results = a.outcomes(
        images.join(told, ["archive", "entry_index"], "left")
        .join(skipped.select("archive", "entry_index", F.lit(True).alias("skip")), ["archive", "entry_index"], "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("__told").isNull() & F.col("skip").isNull(), NO_ANSWER))).drop("__told"))
    summary = a.archive_summary(results)
    good = summary.where(~F.col("aborted")).select("archive").join(named.where("place = 1"), "archive")
    new = results.where("outcome = 'translated'").select("archive", "entry_index", "new_data")
    kept = whole.join(good.select("archive", "output"), "archive")
    old = source.read_entries(kept.join(new, ["archive", "entry_index"], "left_anti"))
    entries = kept.join(
        old.unionByName(new.withColumnRenamed("new_data", "data").withColumn("read_problem", F.lit(None).cast("string"))), ["archive", "entry_index"]
    ).drop("archive").withColumnRenamed("output", "archive")
    written = materialize(source.write_archives(entries, folder), "written")
    unread = written.where("problem is not null").select(F.col("archive").alias("output"), "problem").join(
        named.where("place = 1"), "output").select("archive", "problem")
    return results.drop("new_data"), summary, broken.unionByName(empty).unionByName(taken).unionByName(unread)


def apply_manual_reviews(entries: DataFrame, reviewed: DataFrame, renderings: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Put the pictures of changed manual reviews into their archives: (written archives, renderings of no entry).

    ``entries``: whole archives (archive, entry_index, name, data and the listing's metadata); ``reviewed``: the
    rows of :func:`panelflow.operators.review.manual_review_round`; ``renderings``: (archive, image_number, data).
    Only archives with a changed picture are written again, entry by entry.
    """
    folder = source.make_folder(entries.sparkSession, folder)
    changed = reviewed.where("reviewed and changed").select("archive", "image_number")
    wanted = renderings.join(changed, ["archive", "image_number"], "left_semi")
    targets, unknown = a.review_targets(wanted.select("archive", "image_number"), a.number_images(entries))
    updates = wanted.join(targets.select("archive", "image_number", "name"), ["archive", "image_number"]).select(
        "archive", "name", "data", F.col("image_number").alias("seq"))
    touched = entries.join(updates.select("archive").distinct(), "archive", "left_semi")
    merged, _ = a.upsert_entries(touched, updates)
    return materialize(source.write_archives(merged, folder), "written"), unknown


def status(lines: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """(seq, line) -> the latest row per image or task."""
    return s.latest_status(s.attribute_source(s.parse_progress(lines)), skips)


def diagnose_runs(lines: DataFrame, runs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Per run: result path if there is one, else code, headline and details of its failure."""
    found = materialize(d.resolve_results(lines, files, runs, root), "results")
    told = d.failure_class(lines, runs.join(
        found.select("run_id", F.col("path").isNotNull().alias("resolved")), "run_id", "left"))
    return told.join(found, "run_id")


def harvest(pages: DataFrame, seen: DataFrame, min_width: Column, min_height: Column) -> DataFrame:
    """Visible, new image candidates of pages with their position; ``small`` marks those to leave out."""
    found = p.harvest_images(pages).where(p.visible(F.col("visibility"), F.col("display"), F.col("opacity"), F.lit(False)))
    return p.unseen(found, seen).withColumn(
        "small", ~p.big_enough(F.col("width"), F.col("height"), min_width, min_height))


def screen_pages(pixels: DataFrame, sizes: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, page sizes and pixel regions -> (best tiles, components, ink summary per region)."""
    windows = r.region_windows(regions)
    marked = materialize(r.ink_pixels(windows, pixels), "ink")
    lines = r.long_runs(marked.where("candidate"), windows)
    ink = marked.where("ink").join(lines, ["image_id", "ord", "y", "x"], "left_anti")
    components = materialize(r.glyph_components(ink, windows), "components")
    return r.score_tiles(r.tile_stats(pixels, sizes)), components, r.ink_summary(components, windows)
