"""Run diagnostics: mine event lines for details, result paths and ids, and classify failures.

Lines come one per row as (run_id, stream stdout|stderr, seq, line). First-seen
distinct values are found by a grouped minimum and tails by a ranked filter, so a run
with any number of lines is reduced before it is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions import messages as m
from panelflow.functions.text import single_line
from panelflow.functions.values import strip_space


def scan_run_events(lines: DataFrame) -> DataFrame:
    """Lines that hold JSON, parsed as ``event``; other and broken lines drop out."""
    trimmed = strip_space(F.col("line"))
    return (
        lines.where(trimmed.startswith("{") | trimmed.startswith("["))
        .withColumn("event", F.try_parse_json(trimmed))
        .where("event is not null")
    )


def _text(event: Column, path: str) -> Column:
    """A value as text when it counts as present: not null, empty, zero or false."""
    value = F.try_variant_get(event, path, "string")
    plain = F.schema_of_variant(F.try_variant_get(event, path, "variant")) == "STRING"
    return F.when((value != "") & (plain | ~value.isin("0", "false")), value)


def _error_text(event: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(event, path, "variant"))
    inner = F.coalesce(*[_text(event, f"{path}.{name}") for name in ("message", "detail", "error")])
    return F.when(kind == "STRING", _text(event, path)).when(kind.startswith("OBJECT"), inner)


def event_details(events: DataFrame) -> DataFrame:
    """(run_id, seq, part, detail): what each parsed event tells about a failure."""
    event = F.col("event")
    item_type = F.try_variant_get(event, "$.item.type", "string")
    code = F.try_variant_get(event, "$.item.exit_code", "variant")
    number = F.try_variant_get(event, "$.item.exit_code", "double")
    command_failed = (
        (item_type == "command_execution")
        & ~F.coalesce(F.schema_of_variant(code) == "VOID", F.lit(False))
        & ~F.coalesce(number == 0, F.lit(False))
    )
    failed = F.coalesce(F.try_variant_get(event, "$.type", "string"), F.lit("")).rlike("(?i)error|failed")

    def labelled(condition: Column, prefix: str, value: Column) -> Column:
        return F.when(condition, F.concat(F.lit(prefix), value))

    parts = [
        labelled(item_type == "agent_message", m.AGENT_PREFIX, _text(event, "$.item.text")),
        labelled(command_failed, m.EXIT_PREFIX,
                 F.coalesce(F.try_variant_get(event, "$.item.exit_code", "string"), F.lit("undefined"))),
        labelled(command_failed, m.OUTPUT_PREFIX, _text(event, "$.item.aggregated_output")),
        *[labelled(failed, m.EVENT_PREFIX, _error_text(event, path))
          for path in ("$.message", "$.error", "$.detail", "$.item.error", "$.item.message")],
    ]
    return events.select("run_id", "seq", F.posexplode(F.array(*parts)).alias("part", "detail")).where(
        "detail is not null").withColumn("detail", single_line(F.col("detail"), m.DETAIL_LENGTH))


def _tail(lines: DataFrame, stream: str, count: int, prefix: str) -> DataFrame:
    newest = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return (
        lines.where((F.col("stream") == stream) & (single_line(F.col("line"), m.DETAIL_LENGTH) != ""))
        .withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= count)
        .select("run_id", "seq", F.lit(0).alias("part"), single_line(
            F.concat(F.lit(prefix), single_line(F.col("line"), m.DETAIL_LENGTH)), m.DETAIL_LENGTH).alias("detail"))
    )


def diagnostic_details(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, stage) and lines -> (run_id, position, detail): up to twelve distinct details per run.

    Order: failed stage, events, last six stderr lines; the last four stdout lines only
    when there is nothing else.
    """
    stage = runs.where(F.coalesce("stage", F.lit("")) != "").select(
        "run_id", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("part"),
        single_line(F.concat(F.lit(m.STAGE_PREFIX), F.col("stage")), m.DETAIL_LENGTH).alias("detail"))
    told = event_details(scan_run_events(lines.where("stream = 'stdout'"))).withColumn("layer", F.lit(1)).unionByName(
        _tail(lines, "stderr", m.STDERR_TAIL, m.STDERR_PREFIX).withColumn("layer", F.lit(2)))
    silent = runs.select("run_id").join(told.select("run_id"), "run_id", "left_anti")
    fallback = _tail(lines, "stdout", m.STDOUT_TAIL, m.STDOUT_PREFIX).join(silent, "run_id", "left_semi")
    every = told.unionByName(stage.withColumn("layer", F.lit(0))).unionByName(fallback.withColumn("layer", F.lit(3)))
    first = every.groupBy("run_id", "detail").agg(F.min(F.struct("layer", "seq", "part")).alias("__first"))
    in_order = Window.partitionBy("run_id").orderBy("__first")
    return (
        first.withColumn("position", F.row_number().over(in_order)).where(F.col("position") <= m.MAX_DETAILS)
        .select("run_id", F.col("position").cast("bigint").alias("position"), "detail")
    )


def _details_per_run(details: DataFrame) -> DataFrame:
    """At most twelve rows per run become one array."""
    return details.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "detail"))), lambda d: d["detail"]).alias("details"))


def failure_class(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, stage, exit_code, spawn_error, cancelled, timed_out, resolved) -> code, headline, details."""
    details = _details_per_run(diagnostic_details(lines, runs))
    signs = lines.groupBy("run_id").agg(F.bool_or(F.col("line").rlike(m.COMPATIBILITY)).alias("incompatible"))
    opening = Window.partitionBy("run_id").orderBy("seq")
    # the refusal is looked for in the first 1200 characters, so in at most that many lines, each flat and cut
    head = lines.where((F.col("stream") == "stdout") & (strip_space(F.col("line")) != "")).withColumn(
        "__rn", F.row_number().over(opening)).where(F.col("__rn") <= m.DETAIL_LENGTH)
    refused = head.groupBy("run_id").agg(m.safety_blocked(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", single_line(F.col("line"), m.DETAIL_LENGTH).alias("line")))), lambda s: s["line"]),
        " ")).alias("refused"))
    rows = runs.join(details, "run_id", "left").join(signs, "run_id", "left").join(refused, "run_id", "left")
    no_texts = F.array().cast("array<string>")
    noted = F.array_compact(F.array_append(
        F.coalesce("details", no_texts), F.when(F.col("spawn_error") != "", F.concat(F.lit(m.SPAWN_PREFIX), F.col("spawn_error")))))
    rows = rows.withColumn("details", noted)
    summary = F.get(F.filter(
        "details", lambda d: ~d.startswith(m.STAGE_PREFIX.strip()) & ~d.rlike(m.NOISE)), F.lit(0))
    stripped = F.regexp_replace(F.coalesce(summary, F.lit(m.NO_REASON)), r"^([^:]+):\s*", "")
    label = F.when(F.col("exit_code").isNotNull(), F.concat(F.lit("종료 코드 "), F.col("exit_code").cast("string"))).otherwise("실행 실패")
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(True))
    yes = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("cancelled", "timed_out", "incompatible", "refused", "resolved")}
    code = (
        F.when(yes["cancelled"], m.CODES["cancelled"])
        .when(yes["timed_out"], m.CODES["timeout"])
        .when(failed & yes["incompatible"], m.CODES["compatibility"])
        .when(failed, m.CODES["exec"])
        .when(yes["resolved"], F.lit(None))
        .when(yes["refused"], m.CODES["safety"])
        .otherwise(m.CODES["result"])
    )
    rows = rows.withColumn("code", code)
    headline = (
        F.when(F.col("code") == m.CODES["compatibility"], m.COMPATIBILITY_HEADLINE)
        .when(F.col("code") == m.CODES["safety"], m.SAFETY_HEADLINE)
        .when(F.col("code") == m.CODES["exec"], F.concat(F.lit("Codex "), label, F.lit(" · "), stripped))
    )
    advised = F.when(F.col("code") == m.CODES["compatibility"], F.array_append("details", F.lit(m.ADVICE))).otherwise(F.col("details"))
    return rows.select("run_id", "code", headline.alias("headline"), advised.alias("details"))


# ---------------------------------------------------------------- result files

def _json_strings(lines: DataFrame) -> DataFrame:
    """Every string value inside the JSON lines, unescaped, in document order."""
    # every literal is taken whole, keys with their colon, so none is entered in the middle
    tokens = F.regexp_extract_all(F.col("line"), F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'), F.lit(0))
    literals = F.filter(tokens, lambda token: token.endswith('"'))
    return scan_run_events(lines).select("run_id", "seq", F.posexplode(literals).alias("at", "literal")).select(
        "run_id", "seq", "at", F.try_variant_get(F.try_parse_json("literal"), "$", "string").alias("text"))


def generated_paths(lines: DataFrame) -> DataFrame:
    """(run_id, path, source, seq, at, hit): distinct image paths, by where each was first seen."""
    raw = lines.select("run_id", F.lit(0).alias("source"), "seq", F.lit(0).alias("at"), F.col("line").alias("text"))
    texts = raw.unionByName(_json_strings(lines).withColumn("source", F.lit(1)))
    single = F.regexp_replace("text", r"\\\\", r"\\")
    found = texts.where(F.col("text").rlike("(?i)\\.(png|jpe?g|webp)")).select(
        "run_id", "source", "seq", "at",
        F.posexplode(F.regexp_extract_all(single, F.lit(m.IMAGE_PATH), F.lit(0))).alias("hit", "path"))
    order = F.struct("source", "seq", "at", "hit")
    return found.groupBy("run_id", F.lower("path").alias("__key")).agg(
        F.min(order).alias("__first"), F.min_by("path", order).alias("path")).select("run_id", "path", "__first.*")


def thread_ids(lines: DataFrame) -> DataFrame:
    """(run_id, thread_id, seq, at): distinct well-formed ids, by where each was first seen."""
    pattern = rf'"(?:thread_id|threadId)"\s*:\s*"({m.UUID})"'
    found = scan_run_events(lines).select(
        "run_id", "seq", F.posexplode(F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(1))).alias("at", "thread_id"))
    order = F.struct("seq", "at")
    return found.groupBy("run_id", F.lower("thread_id").alias("__key")).agg(
        F.min(order).alias("__first"), F.min_by("thread_id", order).alias("thread_id")).select(
        "run_id", "thread_id", "__first.*")


def latest_generated_file(files: DataFrame, root: str) -> DataFrame:
    """(path, modified_at) -> newest image per run folder ``root/<thread_id>/...``."""
    rest = F.substring(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), len(root) + 2, 2**31 - 1)
    image = F.col("path").rlike(r"(?i)\.(png|jpe?g|webp)$") & m.inside_root(F.col("path"), F.lit(root))
    return (
        files.where(image).withColumn("thread_key", F.lower(F.split_part(rest, F.lit("/"), F.lit(1))))
        .where(F.contains(rest, F.lit("/")))
        .groupBy("thread_key").agg(F.max(F.struct("modified_at", "path")).alias("__newest"))
        .select("thread_key", F.col("__newest.path").alias("path"), F.col("__newest.modified_at").alias("modified_at"))
    )


def resolve_results(lines: DataFrame, files: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """(run_id, path, problem): the last named existing path inside ``root``, else the newest
    file of the run's own threads (last thread first), else why there is none."""
    named = generated_paths(lines)
    flat = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    existing = files.select(flat.alias("__key"), F.col("path").alias("found"))
    direct = named.where(m.inside_root(F.col("path"), F.lit(root))).withColumn("__key", flat).join(
        existing, "__key").groupBy("run_id").agg(F.max_by("found", F.struct("source", "seq", "at", "hit")).alias("direct"))
    newest = latest_generated_file(files, root)
    by_thread = thread_ids(lines).withColumn("thread_key", F.lower("thread_id")).join(
        newest.select("thread_key", F.col("path").alias("found")), "thread_key").groupBy("run_id").agg(
        F.max_by("found", F.struct("seq", "at")).alias("by_thread"))
    any_path = named.select("run_id").distinct().withColumn("named", F.lit(True))
    rows = runs.select("run_id").join(direct, "run_id", "left").join(by_thread, "run_id", "left").join(any_path, "run_id", "left")
    path = F.coalesce("direct", "by_thread")
    return rows.select(
        "run_id", path.alias("path"),
        F.when(path.isNotNull(), F.lit(None)).when(F.col("named"), "outside_root").otherwise("no_result").alias("problem"))
