"""Registered queries of the translate-and-review job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions import media, prompts
from panelflow.operators import review as r
from panelflow.plans.derived import table, view, with_views
from panelflow.session import spread


def _regions(conv: Column, turn: Column, shift: int = 0) -> Column:
    """One to three regions per message with formula-made confidences."""

    def region(i: Column) -> Column:
        number = F.lit(0.0)
        box = F.array(i * 100.0, turn * 50.0, i * 100.0 + 80, turn * 50.0 + 40)
        text = F.lit(None).cast("string")
        return F.struct(
            box.alias("box"), box.alias("layout_box"), F.concat(F.lit("r"), i.cast("string")).alias("original"),
            F.concat(F.lit("t"), i.cast("string")).alias("translated"),
            ((conv * 3 + turn * 5 + i * 7 + shift) % 10 / 10.0).alias("confidence"), F.lit("sfx").alias("region_kind"),
            F.lit("vertical").alias("orientation"), (i * 9.5).alias("font_size"), F.lit("#112233").alias("text_color"),
            text.alias("background_color"), F.lit(True).alias("bold"), F.lit("serif").alias("font_style"),
            text.alias("stroke_color"), (number + 2).alias("stroke_width"), F.lit(False).alias("italic"),
            number.alias("rotation"), F.lit("left").alias("align"), F.lit(False).alias("background_complex"),
        )

    return F.transform(F.sequence(F.lit(1), (turn % 3 + 1).cast("int")), region)


def _attempts(plan: Column) -> Column:
    """The plan's attempts, for some messages none at all, unknown, or more than any plan gives."""
    which = (F.col("conv_id") * 10 + F.col("turn")) % 17
    return F.when(plan["mode"] != "automatic", plan["max_attempts"]).when(which == 1, None).when(which == 2, 6).when(
        which == 3, 9).when(which == 4, 0).when(which == 5, 5).otherwise(plan["max_attempts"])


class DigestRenderer:
    """Stands in for a picture renderer: the rendering is a digest of its own address; ``lost`` ones are not given."""

    def __init__(self, lost: Column | None = None):
        self.lost = F.lit(False) if lost is None else lost

    def render(self, wanted: DataFrame) -> DataFrame:
        return wanted.where(~self.lost).select(
            "cache_key", F.encode(F.sha2(F.concat(F.lit("rendered "), "cache_key"), 256), "UTF-8").alias("rendered"))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_requests", heavy=True)
    plan = media.review_plan(F.col("review_mode"), F.col("skip"), F.col("attempts"))
    return rows.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("work_id"), F.md5("text").alias("content_hash"),
        _regions(F.col("conv_id"), F.col("turn")).alias("regions"), plan["mode"].alias("mode"), _attempts(plan).alias("max_attempts"),
        (F.col("conv_id") % 19 == 0).alias("cancelled"))


def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewer = r.RuleReviewer(0.6, 0.1, fails=(F.col("work_id") % 11 == 0) & (F.col("attempt") == 1))
    work = _work(spark, sf_dir)
    key = r.cache_key(F.col("content_hash"), r.region_signature(r.reliable_regions(F.col("regions").cast(r.REGIONS_TYPE))))
    known = work.where(F.col("content_hash").startswith("1")).select(key.alias("cache_key"), F.encode(F.lit("known"), "UTF-8").alias("rendered"))
    told = r.review_loop(work, reviewer, DigestRenderer(F.col("content_hash").startswith("0")), known.unionByName(known))
    return told.select(
        "work_id", "passed", "skipped", F.col("attempts").cast("bigint").alias("attempts"), "mode", "requires_user_review",
        "summary", F.array_join("issues", "|").alias("issues"), F.size("regions").cast("bigint").alias("n_regions"),
        F.round("average_confidence", 6).alias("average_confidence"), "final", "final_bypass",
        F.col("n_rendered").cast("bigint").alias("n_rendered"), F.col("n_cached").cast("bigint").alias("n_cached"))


def _judge(batch: pd.DataFrame) -> pd.DataFrame:
    """What RuleReviewer(0.6, 0.1) does, as a Python model."""
    told = []
    for regions in batch["regions"]:
        rows = [r if isinstance(r, dict) else r.asDict() for r in regions]
        weak = [r for r in rows if (r["confidence"] or 0.0) < 0.6]
        raised = [{**r, "confidence": round(min(1.0, (r["confidence"] or 0.0) + 0.1), 6)} if (r["confidence"] or 0.0) < 0.6 else r for r in rows]
        told.append((not weak, f"{len(weak)} weak", [f"weak: {r['original']}" for r in weak], raised))
    passed, summary, issues, regions = zip(*told) if told else ((), (), (), ())
    return pd.DataFrame({"work_id": batch["work_id"].to_numpy(), "passed": passed, "summary": summary, "issues": issues, "regions": regions})


def _picture(batch: pd.DataFrame) -> pd.Series:
    if batch["content_hash"].str.startswith("0").any():
        raise ValueError("no picture")
    return batch["cache_key"].map(str.encode)


def function_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop with a reviewer and a renderer that are Python functions, the latter failing for some pictures."""
    told = r.review_loop(_work(spark, sf_dir), r.FunctionReviewer(_judge), r.FunctionRenderer(_picture))
    return told.select("work_id", "passed", F.col("attempts").cast("bigint").alias("attempts"), "summary", F.array_join("issues", "|").alias("issues"),
                       F.size("regions").cast("bigint").alias("n_regions"), "final", F.col("n_rendered").cast("bigint").alias("n_rendered"))


def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which work items find their rendering and which addresses have to be rendered."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("work_id"), F.md5("text").alias("content_hash"),
        _regions(F.lit(1), F.length("lang")).alias("regions"), (F.col("doc_id") % 5 == 0).alias("bypass"))
    keyed = rows.withColumn("cache_key", r.cache_key(F.col("content_hash"), r.region_signature(F.col("regions"))))
    cache = keyed.where("work_id % 3 = 0").select("cache_key").distinct().withColumn("rendered", F.encode(F.lit("x"), "UTF-8"))
    hits, misses = r.cached_renderings(keyed, cache)
    return hits.select(F.lit("hit").alias("kind"), "content_hash").unionByName(misses.select(F.lit("render").alias("kind"), "content_hash")).groupBy(
        "kind", "content_hash").agg(F.count(F.lit(1)).alias("n"))


def audited_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional audit pass: its regions, or those before where it failed or never ran."""
    rows = view(spark, sf_dir, "v_requests", heavy=True).withColumn("work_id", F.col("conv_id") * 10 + F.col("turn"))
    first = rows.select("work_id", _regions(F.col("conv_id"), F.col("turn")).alias("regions"))
    audit = rows.where("conv_id % 4 <> 1").select(
        "work_id", _regions(F.col("conv_id"), F.col("turn"), 2).alias("regions"),
        F.when(F.col("conv_id") % 4 == 2, "timeout").alias("error"))
    kept = r.with_fallback(first, audit).withColumn("regions", r.reliable_regions(F.col("regions")))
    return kept.select("work_id", "pass_error", F.size("regions").cast("bigint").alias("n_regions"),
                       F.round(r.mean_confidence(F.col("regions")), 6).alias("average_confidence"))


def lexicon_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document translated word by word with a lexicon made from the benchmark texts."""
    lexicon = table(spark, sf_dir, "benchmark").select(F.explode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("token")).distinct().withColumn(
        "target", F.concat(F.lit("k-"), "token"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("original"))
    return r.LexiconTranslator(lexicon).translate(docs).select(
        "doc_id", F.md5("translated").alias("digest"), F.length("translated").cast("bigint").alias("n_chars"), "error")


def manual_review_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_requests", heavy=True)
    image = [F.col("conv_id").alias("archive"), F.col("turn").alias("image_number")]
    status = rows.select(*image, F.when(F.col("conv_id") % 5 == 0, "web").otherwise("zip").alias("source"),
                         F.when(F.col("turn") % 2 == 0, "review").otherwise("done").alias("state"), (F.col("conv_id") % 7 == 0).alias("review_queued"))
    requests = rows.where("turn < 4").select(*image)
    work = rows.select(*image, (F.col("conv_id") * 10 + F.col("turn")).alias("work_id"), F.md5("text").alias("content_hash"),
                       _regions(F.col("conv_id"), F.col("turn")).alias("regions"))
    told = r.manual_review_round(status, requests.unionByName(requests), work, r.RuleReviewer(), DigestRenderer())
    return told.select("archive", "image_number", "source", "state", "reviewed", F.coalesce("changed", F.lit(False)).alias("changed"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_requests", heavy=True).withColumn("regions", _regions(F.col("conv_id"), F.col("turn")))
    small = F.transform("regions", lambda x: F.struct(x["original"], x["translated"]))
    manual = F.coalesce(F.col("review_mode") == "manual", F.lit(False))
    issues = F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("fix  "), "role_text"), F.lit("")))
    details = F.array(*[F.struct(F.lit(n).alias("path"), F.array(F.lit(1), F.lit(2), F.col("turn"), F.lit(4)).alias("box")) for n in ("d1", "d2")])
    attachments = F.array(F.lit("page"), F.when(F.col("turn") % 2 == 0, "d2").otherwise("grid"), F.lit("d1"))
    return rows.withColumn("role_text", F.coalesce("element", F.lit("none"))).select(
        "conv_id", "turn", prompts.recognition_prompt().alias("recognition"), prompts.audit_prompt(small).alias("audit"),
        prompts.visual_prompt(small, F.col("turn") + 1, F.lit(3), manual).alias("visual"),
        prompts.render_prompt(F.col("regions"), F.col("turn"), issues).alias("render"),
        prompts.detail_guide(details, attachments).alias("guide"))


# ------------------------------------------------------------------ SQL twins

_CONFS = "list_transform(range(1, turn % 3 + 2), lambda i: ((conv_id * 3 + turn * 5 + i * 7{shift}) % 10) / 10.0::DOUBLE)"

_LOOP = f"""
WITH RECURSIVE work AS (
  SELECT conv_id * 10 + turn AS work_id,
    list_filter(list_transform(range(1, turn % 3 + 2), lambda i: {{'i': i, 'c': ((conv_id * 3 + turn * 5 + i * 7) % 10) / 10.0::DOUBLE}}), lambda x: x.c >= 0.45) AS rs,
    CASE WHEN review_mode = 'manual' THEN 'manual' WHEN skip THEN 'skipped' ELSE 'automatic' END AS mode,
    CASE WHEN review_mode = 'manual' THEN 1 WHEN skip THEN 0
      WHEN (conv_id * 10 + turn) % 17 = 1 THEN {r.DEFAULT_ATTEMPTS} WHEN (conv_id * 10 + turn) % 17 = 2 THEN 6 WHEN (conv_id * 10 + turn) % 17 = 3 THEN 9
      WHEN (conv_id * 10 + turn) % 17 = 4 THEN 0 WHEN (conv_id * 10 + turn) % 17 = 5 THEN 5
      WHEN attempts <> floor(attempts) THEN 3 ELSE least(5, greatest(1, attempts)) END AS max_attempts, left(md5(text), 1) AS mark
  FROM v_requests WHERE conv_id % 19 <> 0
),
loop AS (
  SELECT work_id, rs, mode, max_attempts, 0 AS k, FALSE AS passed, FALSE AS same, NULL::VARCHAR AS summary, []::VARCHAR[] AS issues,
    len(rs) > 0 AND max_attempts > 0 AS going, 0 AS rendered, 0 AS cached, mark FROM work
  UNION ALL
  SELECT work_id, after, mode, max_attempts, k + 1, ok AND len(weak) = 0, mark <> '0' AND (NOT ok OR len(weak) = 0),
    CASE WHEN ok THEN len(weak) || ' weak' ELSE '{r.CALL_FAILED}' END,
    CASE WHEN ok THEN list_transform(weak, lambda x: 'weak: r' || x.i) ELSE ['{r.CALL_FAILED_ISSUE}'] END,
    NOT (ok AND len(weak) = 0) AND k + 1 < max_attempts,
    rendered + CASE WHEN mark = '0' OR mark = '1' AND k = 0 THEN 0 ELSE 1 END, cached + CASE WHEN mark = '1' AND k = 0 THEN 1 ELSE 0 END, mark
  FROM (
    SELECT *, mark <> '0' AND NOT (work_id % 11 = 0 AND k = 0) AS ok, list_filter(rs, lambda x: x.c < 0.6) AS weak,
      CASE WHEN mark = '0' OR work_id % 11 = 0 AND k = 0 THEN rs ELSE
        list_transform(rs, lambda x: CASE WHEN x.c < 0.6 THEN {{'i': x.i, 'c': round(least(1.0::DOUBLE, x.c + 0.1::DOUBLE), 6)}} ELSE x END) END AS after
    FROM loop WHERE going
  ) s
)"""

QUERIES = {
    "review_outcomes": review_outcomes,
    "function_models": function_models,
    "cache_plan": cache_plan,
    "audited_regions": audited_regions,
    "lexicon_translation": lexicon_translation,
    "manual_review_round": manual_review_round,
    "prompt_texts": prompt_texts,
}


def _region_line(i: str) -> str:
    box = f"{i} * 100 || ',' || turn * 50 || ',' || {i} * 100 + 80 || ',' || turn * 50 + 40"
    size = f"regexp_replace(printf('%.1f', {i} * 9.5), '\\.0$', '')"
    return (f"{i} || '. \"r' || {i} || '\" -> \"t' || {i} || '\" kind=sfx box=[' || {box} || '] layout=[' || {box} || "
            f"'] direction=vertical size=' || {size} || ' color=#112233 outline=#ffffff/2'")


_T = prompts.TEMPLATES
_JSON = "'[' || array_to_string(list_transform(range(1, turn % 3 + 2), lambda i: '{\"original\":\"r' || i || '\",\"translated\":\"t' || i || '\"}'), ',') || ']'"
_FENCE = f"'{_T['untrusted']}' || chr(10) || '<{_T['fence']}>' || chr(10) || {_JSON} || chr(10) || '</{_T['fence']}>'"

_FUNCTIONS = _LOOP.replace("work_id % 11 = 0 AND k = 0", "FALSE").replace("mark = '1' AND k = 0", "FALSE")

ORACLES = {
    "function_models": with_views(_FUNCTIONS.replace("WITH RECURSIVE", "WITH", 1) + f"""
, ended AS (SELECT * FROM loop WHERE NOT going)
SELECT work_id, CASE WHEN mode = 'skipped' THEN NULL ELSE passed END AS passed, k::BIGINT AS attempts,
  CASE WHEN mode = 'skipped' THEN '{r.SKIPPED_SUMMARY}' ELSE coalesce(summary, '{r.NO_RESULT}') END AS summary, array_to_string(issues, '|') AS issues,
  len(rs) AS n_regions, CASE WHEN len(rs) = 0 THEN 'none' WHEN passed THEN 'reuse' ELSE 'render' END AS final, rendered::BIGINT AS n_rendered
FROM ended""", "v_requests").replace("WITH ", "WITH RECURSIVE ", 1),
    "review_outcomes": with_views(_LOOP.replace("WITH RECURSIVE", "WITH", 1) + f"""
, ended AS (SELECT * FROM loop WHERE NOT going)
SELECT work_id, CASE WHEN mode = 'skipped' THEN NULL ELSE passed END AS passed, mode = 'skipped' AS skipped, k::BIGINT AS attempts, mode,
  mode <> 'skipped' AND NOT passed AND k > 0 AS requires_user_review,
  CASE WHEN mode = 'skipped' THEN '{r.SKIPPED_SUMMARY}' ELSE coalesce(summary, '{r.NO_RESULT}') END AS summary,
  array_to_string(issues, '|') AS issues, len(rs) AS n_regions, round(list_avg(list_transform(rs, lambda x: x.c)), 6) AS average_confidence,
  CASE WHEN len(rs) = 0 THEN 'none' WHEN passed THEN 'reuse' ELSE 'render' END AS final,
  len(rs) > 0 AND NOT passed AND same AS final_bypass, rendered::BIGINT AS n_rendered, cached::BIGINT AS n_cached
FROM ended""", "v_requests").replace("WITH ", "WITH RECURSIVE ", 1),
    "cache_plan": """
WITH d AS (SELECT doc_id, md5(text) AS h, length(lang) AS sig FROM documents),
cache AS (SELECT DISTINCT h, sig FROM d WHERE doc_id % 3 = 0),
m AS (SELECT d.*, c.h IS NOT NULL AND doc_id % 5 <> 0 AS hit FROM d LEFT JOIN cache c USING (h, sig))
SELECT 'hit' AS kind, h AS content_hash, count(*) AS n FROM m WHERE hit GROUP BY h
UNION ALL SELECT 'render', h, count(DISTINCT sig) FROM m WHERE NOT hit GROUP BY h""",
    "audited_regions": with_views(f"""
WITH c AS (
  SELECT conv_id * 10 + turn AS work_id, CASE WHEN conv_id % 4 = 2 THEN 'timeout' END AS pass_error,
    list_filter(CASE WHEN conv_id % 4 IN (1, 2) THEN {_CONFS.format(shift='')} ELSE {_CONFS.format(shift=' + 2')} END, lambda x: x >= 0.45) AS cs
  FROM v_requests
)
SELECT work_id, pass_error, len(cs) AS n_regions, round(list_avg(cs), 6) AS average_confidence FROM c""", "v_requests"),
    "lexicon_translation": """
WITH lexicon AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS token FROM benchmark),
words AS (
  SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS at_pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) q
),
done AS (
  SELECT doc_id, string_agg(CASE WHEN l.token IS NULL THEN w.token ELSE 'k-' || w.token END, ' ' ORDER BY at_pos) AS t
  FROM words w LEFT JOIN lexicon l USING (token) GROUP BY doc_id
)
SELECT doc_id, md5(coalesce(t, '')) AS digest, length(coalesce(t, '')) AS n_chars, NULL::VARCHAR AS error FROM documents LEFT JOIN done USING (doc_id)""",
    "manual_review_round": with_views("""
WITH s AS (
  SELECT conv_id AS archive, turn AS image_number, CASE WHEN conv_id % 5 = 0 THEN 'web' ELSE 'zip' END AS source,
    CASE WHEN turn % 2 = 0 THEN 'review' ELSE 'done' END AS state,
    conv_id % 5 <> 0 AND turn % 2 = 0 AND conv_id % 7 <> 0 AND turn < 4 AS reviewed,
    list_filter(list_transform(range(1, turn % 3 + 2), lambda i: ((conv_id * 3 + turn * 5 + i * 7) % 10) / 10.0::DOUBLE), lambda c: c >= 0.45) AS cs
  FROM v_requests
)
SELECT archive, image_number, source, CASE WHEN NOT reviewed THEN state WHEN len(cs) > 0 AND len(list_filter(cs, lambda c: c < 0.6)) > 0 THEN 'review' ELSE 'done' END AS state,
  reviewed, reviewed AND len(cs) > 0 AS changed FROM s""", "v_requests"),
    "prompt_texts": with_views(f"""
SELECT conv_id, turn, '{_T['recognition']}' AS recognition, '{_T['audit']}' || chr(10) || {_FENCE} AS audit,
  '{_T['visual']}' || chr(10) || (CASE WHEN review_mode = 'manual' THEN '{_T['manual']}' ELSE 'Automatic review ' || (turn + 1) || '/3.' END) || chr(10) || {_FENCE} AS visual,
  '{_T['render']}' || chr(10) || 'Render attempt ' || greatest(1, turn) || '.' || chr(10) ||
    array_to_string(list_transform(range(1, turn % 3 + 2), lambda i: {_region_line('i')}), chr(10)) ||
    (CASE WHEN turn % 2 = 0 THEN chr(10) || '{_T['issues']}' || chr(10) || rtrim('- fix ' || coalesce(element, 'none')) ELSE '' END) AS render,
  '{_T['details_open']}' || chr(10) || '{_T['details_intro']}' || chr(10) || 'Attachment 3 shows original coordinates [1, 2, ' || turn || ', 4].' || chr(10) ||
    (CASE WHEN turn % 2 = 0 THEN 'Attachment 2 shows original coordinates [1, 2, ' || turn || ', 4].' || chr(10) ELSE '' END) || '{_T['details_close']}' AS guide
FROM v_requests""", "v_requests"),
}
