"""Progress-log analytics: parse, attribute to a source, keep the latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions import progress as p
from panelflow.functions.values import strip_space
from panelflow.operators.ordered import forward_fill, running_sum


def parse_progress(lines: DataFrame) -> DataFrame:
    """(seq, line) -> one row per well-formed line; other lines drop out, also those whose numbers are too large
    to be a task's or image's. Works on streams."""
    line = strip_space(F.col("line"))
    parts = [F.regexp_extract(line, p.LINE_PATTERN, i) for i in range(1, 5)]
    keep = [c for c in lines.columns if c != "line"]
    parsed = lines.where(line.rlike(p.LINE_PATTERN)).select(
        *keep,
        parts[0].alias("time"),
        parts[1].try_cast("bigint").alias("task_number"),
        parts[2].try_cast("bigint").alias("image_number"),
        parts[3].alias("detail"),
    ).where("task_number is not null and image_number is not null")
    return (
        parsed.withColumn("__c", p.classify(F.col("detail")))
        .withColumn("__s", p.source_of(F.col("detail")))
        .select(*parsed.columns, "__c.stage", "__c.state", "__c.terminal", "__s.source", "__s.source_label")
    )


def attribute_source(events: DataFrame, block: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """Give each line its task's last known source; lines before the first one are dropped.

    ``before`` holds sources known from earlier lines: (task_number, __before struct).
    """
    known = F.when(F.col("source").isNotNull(), F.struct("source", "source_label"))
    filled = forward_fill(events, ["task_number"], "seq", known, "__known", block)
    if before is not None:
        filled = filled.join(before, "task_number", "left").withColumn(
            "__known", F.coalesce("__known", "__before")).drop("__before")
    return (
        filled.where("__known is not null")
        .withColumn("source", F.col("__known.source"))
        .withColumn("source_label", F.col("__known.source_label"))
        .drop("__known")
        .withColumn("row_key", p.row_key(F.col("source"), F.col("task_number"), F.col("image_number")))
        .withColumn(
            "name",
            F.when(F.col("source") == "web", p.web_source_name(F.col("detail"), F.col("image_number")))
            .otherwise(F.lit("")),
        )
    )


def latest_status(rows: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Last row per key; a blank name keeps the one before; a requested skip sticks.

    ``skips`` lists (row_key) that a user asked to skip: until the row settles it
    shows as skipped.
    """
    latest = rows.groupBy("row_key").agg(
        F.max_by(
            F.struct("source", "source_label", "task_number", "image_number", "stage", "detail", "state", "terminal",
                     "time", "seq"),
            "seq",
        ).alias("__last"),
        F.max_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("__name"),
    ).select("row_key", "__last.*", F.coalesce("__name", F.lit("")).alias("name"))
    if skips is None:
        return latest
    asked = skips.select("row_key").distinct().withColumn("__asked", F.lit(True))
    held = F.coalesce("__asked", F.lit(False)) & ~F.col("state").isin(*p.SETTLED_STATES)
    return (
        latest.join(asked, "row_key", "left")
        .withColumn("__held", held)
        .withColumn("stage", F.when(F.col("__held"), p.SKIP_STAGE).otherwise(F.col("stage")))
        .withColumn("detail", F.when(F.col("__held"), p.SKIP_DETAIL).otherwise(F.col("detail")))
        .withColumn("state", F.when(F.col("__held"), "skipped").otherwise(F.col("state")))
        .drop("__asked", "__held")
    )


def skippable(state: Column) -> Column:
    """A row may still be skipped."""
    return ~state.isin(*p.SETTLED_STATES)


def reviewable(
    source: Column, state: Column, queued: Column, worker_running: Column, source_exists: Column,
    destination_exists: Column,
) -> Column:
    """A manual review may be asked for: finished archive rows that await one."""
    return (
        source_exists & (worker_running | destination_exists)
        & (source == "zip") & (state == "review") & ~F.coalesce(queued, F.lit(False))
    )


def slot_usage(events: DataFrame, maximum: int | None = None, block: Column | None = None) -> DataFrame:
    """(seq, kind acquire|release, optional keys) -> running and waiting counts after each event.

    With ``maximum`` slots, demand beyond it waits; a release hands its slot on.
    """
    step = F.when(F.col("kind") == "acquire", 1).when(F.col("kind") == "release", -1).otherwise(0).cast("bigint")
    keyed = running_sum(events, [c for c in ("server",) if c in events.columns], "seq", step, "demand", block)
    limit = F.lit(maximum).cast("bigint")
    running = F.col("demand") if maximum is None else F.least(F.col("demand"), limit)
    return keyed.withColumn("running", running).withColumn("waiting", F.col("demand") - F.col("running"))


def pass_durations(events: DataFrame, block: Column | None = None) -> DataFrame:
    """(task_number, label, seq, phase start|complete, at) -> elapsed time per finished pass."""
    begun = F.when(F.col("phase") == "start", F.struct(F.col("at").alias("at"), F.col("seq").alias("seq")))
    paired = forward_fill(events, ["task_number", "label"], "seq", begun, "__begun", block)
    # a start is used by the first completion after it only
    first = (
        paired.where("phase = 'complete' and __begun is not null")
        .groupBy("task_number", "label", F.col("__begun.seq").alias("start_seq"))
        .agg(F.min("seq").alias("seq"), F.min_by("at", "seq").alias("end_at"), F.min("__begun.at").alias("start_at"))
    )
    return first.withColumn("elapsed", F.col("end_at") - F.col("start_at"))


def overdue_passes(events: DataFrame, limit_seconds: int, now: Column, block: Column | None = None) -> DataFrame:
    """Passes (see :func:`pass_durations`) that took longer than the limit or are still
    running at ``now`` beyond it; ``ended`` is null for the latter."""
    starts = events.where("phase = 'start'").select(
        "task_number", "label", F.col("seq").alias("start_seq"), F.col("at").alias("start_at"))
    done = pass_durations(events, block).select("task_number", "label", "start_seq", F.col("end_at").alias("ended"))
    rows = starts.join(done, ["task_number", "label", "start_seq"], "left")
    return rows.where(F.coalesce("ended", now) - F.col("start_at") > limit_seconds)
