"""Archive batch jobs: number images, decide each entry's outcome, summarise, release, replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.text import natural_key
from panelflow.session import materialize
from panelflow.operators.ordered import block_of, numbered

# What counts as an image, and the wording of outcomes.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
SKIPPED = "사용자 스킵 · 원본 유지"
FAILED = "처리 실패로 원본 유지: "
UNCHANGED = "번역할 일본어 없음 · 원본 유지"
PASSED = " · 품질검수 통과"


def suffix_of(name: Column) -> Column:
    """Lower-case suffix of the last path part; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def is_image(name: Column, is_dir: Column) -> Column:
    return ~is_dir & suffix_of(name).isin(*IMAGE_SUFFIXES)


def number_images(entries: DataFrame, key: str = "archive", block: Column | None = None) -> DataFrame:
    """Images only, numbered 1..n per archive in entry order."""
    is_dir = F.col("is_dir") if "is_dir" in entries.columns else F.col("name").endswith("/")
    images = entries.where(is_image(F.col("name"), is_dir))
    return numbered(images, [key], ["entry_index"], "image_number", block_of("entry_index") if block is None else block)


def natural_positions(rows: DataFrame, keys: list[str], label: str, tie: str, out: str = "position") -> DataFrame:
    """Number rows per key in natural order of ``label``.

    The rows are dealt out by sampled ranges of the whole order, so a key of any size is
    sorted by as many tasks as it needs; each range is one block of the numbering.
    """
    order = [natural_key(F.col(label)), F.col(tie)]
    ranged = materialize(
        rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id().cast("bigint")), "ranges")
    return numbered(ranged, keys, order, out, F.col("__range")).drop("__range")


def archives_without_images(entries: DataFrame, key: str = "archive") -> DataFrame:
    is_dir = F.col("is_dir") if "is_dir" in entries.columns else F.col("name").endswith("/")
    return entries.groupBy(key).agg(F.count_if(is_image(F.col("name"), is_dir)).alias("n")).where("n = 0").select(
        key, F.lit("no_images").alias("problem"))


def outcomes(results: DataFrame) -> DataFrame:
    """Add the outcome of an entry to (skip, cancelled, error, changed, region_count,
    review_required, attempts): skip beats cancel beats failure beats change."""
    skip, cancelled = F.coalesce("skip", F.lit(False)), F.coalesce("cancelled", F.lit(False))
    failed, changed = F.col("error").isNotNull(), F.coalesce("changed", F.lit(False))
    review = F.coalesce("review_required", F.lit(False))
    outcome = (
        F.when(skip, "skipped").when(cancelled, "cancelled").when(failed, "failed")
        .when(changed, "translated").otherwise("unchanged")
    )
    checked = F.when(
        review, F.concat(F.lit(" · 자동 검수 "), F.col("attempts").cast("string"), F.lit("회 미통과 · 선택 후 추가 검수 가능"))
    ).otherwise(PASSED)
    rows = results.withColumn("outcome", outcome)
    o = F.col("outcome")
    message = (
        F.when(o == "skipped", SKIPPED)
        .when(o == "failed", F.concat(F.lit(FAILED), F.col("error")))
        .when(o == "translated", F.concat(
            F.lit("번역 문구 "), F.col("region_count").cast("string"), F.lit("개 적용 · 원본 확장자 유지"), checked))
        .when(o == "unchanged", UNCHANGED)
    )
    stage = (
        F.when(o == "skipped", "스킵 완료").when(o == "failed", "오류")
        .when((o == "translated") & review, "사용자 검수 필요").when(o == "translated", "완료").when(o == "unchanged", "원본 유지")
    )
    state = (
        F.when(o == "failed", "error").when((o == "translated") & review, "review").when(o == "translated", "done")
        .when(o.isin("skipped", "unchanged"), "skipped")
    )
    return rows.withColumn("message", message).withColumn("stage", stage).withColumn("state", state).withColumn(
        "keep_original", o != "translated")


def archive_summary(results: DataFrame, key: str = "archive") -> DataFrame:
    """Counts per archive; an unchanged image counts in none, a cancelled one ends the job."""
    return results.groupBy(key).agg(
        F.count_if(F.col("outcome") == "translated").alias("translated"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.bool_or(F.col("outcome") == "cancelled").alias("aborted"),
    )


def progress_fraction(results: DataFrame, finished: Column, key: str = "archive") -> DataFrame:
    """Percentage of images done per archive."""
    return results.groupBy(key).agg(
        F.count_if(finished).alias("finished"), F.count(F.lit(1)).alias("total"),
    ).withColumn("percent", F.coalesce(F.try_divide(F.col("finished") * 100, F.col("total")), F.lit(0.0)))


def ordered_release(entries: DataFrame, ready: Column, key: str = "archive") -> DataFrame:
    """Entries before the first one that is not ready yet."""
    first_open = entries.groupBy(key).agg(F.min(F.when(~F.coalesce(ready, F.lit(False)), F.col("entry_index"))).alias("__open"))
    return entries.join(first_open, key).where(
        F.col("__open").isNull() | (F.col("entry_index") < F.col("__open"))).drop("__open")


def upsert_entries(current: DataFrame, updates: DataFrame, key: str = "archive") -> tuple[DataFrame, DataFrame]:
    """Replace exactly the named entries' ``data``: (all entries with ``replaced``, updates naming no entry).

    Several updates of one entry: the one with the greatest ``seq`` counts.
    """
    latest = updates.groupBy(key, "name").agg(F.max_by("data", "seq").alias("__data")).withColumn("__new", F.lit(True))
    merged = current.join(latest, [key, "name"], "left").withColumn(
        "replaced", F.coalesce("__new", F.lit(False))).withColumn(
        "data", F.when(F.col("replaced"), F.col("__data")).otherwise(F.col("data"))).drop("__new", "__data")
    unknown = latest.join(current.select(key, "name"), [key, "name"], "left_anti").select(key, "name")
    return merged, unknown


def review_targets(requests: DataFrame, images: DataFrame, key: str = "archive") -> tuple[DataFrame, DataFrame]:
    """(archive, image_number) requests -> (the entries meant, requests with a bad number)."""
    asked = requests.select(key, "image_number").distinct()
    targets = asked.join(images, [key, "image_number"])
    return targets, asked.join(images.select(key, "image_number"), [key, "image_number"], "left_anti")


def acknowledgement_lines(acks: DataFrame) -> DataFrame:
    """Add the log ``message`` of an acknowledgement; rows without a usable request id drop out."""
    is_zip = F.coalesce(F.col("element_type") == "zip", F.lit(False))
    given = F.coalesce("element_type", F.lit("")) != ""
    element = F.when(given, F.concat(F.lit("<"), F.substring("element_type", 1, 20), F.lit(">"))).otherwise("이미지")
    reason = F.substring(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("원인 미상")), 1, 500)
    failed = F.concat(F.when(is_zip, "ZIP 이미지 저장").otherwise("페이지 이미지 교체"), F.lit(" 실패 · "), reason)
    done = F.concat(F.when(is_zip, "ZIP 이미지 저장 확인").otherwise("페이지 이미지 교체 확인"), F.lit(" · "), element)
    return acks.where(F.col("request_id") > 0).withColumn(
        "message", F.when(F.coalesce(F.col("success"), F.lit(True)), done).otherwise(failed))


def latest_acknowledgements(work: DataFrame, acks: DataFrame) -> DataFrame:
    """Every work item with its latest acknowledgement, if any."""
    latest = acknowledgement_lines(acks).groupBy("request_id").agg(
        F.max_by(F.struct("success", "message"), "seq").alias("__last"))
    return work.join(latest, "request_id", "left").select(*[work[c] for c in work.columns], "__last.success", "__last.message")
