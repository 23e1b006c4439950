"""Registered queries that run whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.plans import jobs

from panelflow.plans.derived import table, view
from panelflow.plans.diagnostics_queries import ORACLES as DIAGNOSTICS, ROOT, run_lines
from panelflow.plans.layout_queries import _GROUPS, _recursive
from panelflow.plans.region_queries import styled_regions
from panelflow.session import materialize, scratch_path
from panelflow.sources import archives as source

# archive names without suffix: one in two folders, blanks, other scripts, escapes
_STEM = "CASE page_id % 5 WHEN 0 THEN 'my set' WHEN 1 THEN 'x/vol' WHEN 2 THEN 'y/vol' WHEN 3 THEN '한국[3]' ELSE 's%41' END"


class _Prefix:
    """Stands in for a picture translator: puts a mark before the bytes; some entries fail or stay."""

    def translate(self, images: DataFrame) -> DataFrame:
        i = F.col("entry_index")
        return images.select(
            "archive", "entry_index", F.concat(F.encode(F.lit("ko:"), "UTF-8"), "data").alias("new_data"), (i % 4 != 0).alias("changed"),
            (i % 5).alias("region_count"), (i % 6 == 0).alias("review_required"), F.lit(2).alias("attempts"),
            F.when(i % 7 == 3, "down").alias("error"), (F.col("archive").endswith("한국[3].ZIP") & (i == 10)).alias("cancelled"))

def process_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives, the archives translated, the results read back."""
    k = F.col("page_id")
    entries = table(spark, sf_dir, "pages").select(
        F.concat(F.expr(_STEM), F.when(k % 5 == 3, ".ZIP").otherwise(".zip")).alias("archive"), k.alias("entry_index"),
        F.concat(F.lit("p"), k.cast("string"), F.when(k % 5 == 4, ".txt").when(k % 2 == 0, ".png").otherwise(".txt")).alias("name"),
        F.encode("html", "UTF-8").alias("data"))
    folder, out = (source.make_folder(spark, scratch_path(spark, n)) for n in ("in", "out"))
    source.write_archives(entries, folder).write.format("noop").mode("overwrite").save()
    archives = source.scan_archives(spark, folder).select("archive").distinct()
    skips = archives.select("archive", F.explode(F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint"))).alias("image_number"))
    jobs.process_archives(spark, folder, out, _Prefix(), skips)
    written = materialize(source.scan_archives(spark, out), "written")
    content = source.read_entries(written).select("archive", "entry_index", F.sha2("data", 256).alias("digest"))
    return written.join(content, ["archive", "entry_index"]).select(
        F.substring(F.col("archive"), F.lit(len(out) + 2), F.length("archive")).alias("archive"), "entry_index", "name", "digest")

def plan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, sheets and placed regions per image."""
    crops, tiles, regions = jobs.plan_batches(styled_regions(spark, sf_dir), F.lit(1000), F.lit(1400))
    per_image = crops.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_crops")).join(
        tiles.groupBy("image_id").agg(F.max("batch").alias("n_sheets")), "image_id")
    return per_image.join(regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_regions")), "image_id")

def diagnose_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = jobs.diagnose_runs(
        run_lines(spark, sf_dir), view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_files"), ROOT)
    return told.select("run_id", "code", "headline", "path", "problem")

QUERIES = {"process_archives": process_archives, "plan_batches": plan_batches, "diagnose_runs": diagnose_runs}

_PROCESSED = f"""
WITH e AS (
  SELECT {_STEM} || '_ko.zip' AS archive, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS entry_index,
    'p' || page_id || (CASE WHEN page_id % 5 = 4 OR page_id % 2 = 1 THEN '.txt' ELSE '.png' END) AS name, html
  FROM pages
),
n AS (SELECT *, name LIKE '%.png' AS image, count(*) FILTER (name LIKE '%.png') OVER (PARTITION BY archive ORDER BY entry_index) AS k FROM e),
d AS (SELECT *, image AND k NOT IN (2, 3) AND entry_index % 7 <> 3 AND entry_index % 4 <> 0 AS translated,
  bool_or(image AND k NOT IN (2, 3) AND archive = '한국[3]_ko.zip' AND entry_index = 10) OVER (PARTITION BY archive) AS stopped,
  bool_or(image) OVER (PARTITION BY archive) AS any_image FROM n)
SELECT archive, entry_index, name, sha256(CASE WHEN translated THEN 'ko:' || html ELSE html END) AS digest FROM d WHERE NOT stopped AND any_image"""

_CLASSED = DIAGNOSTICS["failure_class"].rsplit("SELECT run_id, code, headline, array_to_string(", 1)[0]

ORACLES = {
    "process_archives": _PROCESSED,
    "plan_batches": _recursive(_GROUPS.rstrip() + """,
cs AS (SELECT image_id, crop_index, r - l AS w, b - t AS h, len(mem) AS n FROM crops),
pk AS (
  SELECT image_id, crop_index, 1::BIGINT AS batch, 0 AS pos, w AS mw, h AS mh FROM cs WHERE crop_index = 1
  UNION ALL
  SELECT image_id, crop_index, CASE WHEN ok THEN batch ELSE batch + 1 END, CASE WHEN ok THEN pos + 1 ELSE 0 END, CASE WHEN ok THEN nw ELSE w END, CASE WHEN ok THEN nh ELSE h END
  FROM (SELECT c.*, p.batch, p.pos, greatest(p.mw, c.w) AS nw, greatest(p.mh, c.h) AS nh, p.pos < 3 AND greatest(p.mw, c.w) * 2 + 96 <= 4096
    AND greatest(p.mh, c.h) * ((p.pos + 3) // 2) + 32 * ((p.pos + 3) // 2 + 1) <= 4096 AS ok
    FROM pk p JOIN cs c ON c.image_id = p.image_id AND c.crop_index = p.crop_index + 1) q
)
SELECT image_id, (SELECT count(*) FROM cs c WHERE c.image_id = p.image_id) AS n_crops, max(batch) AS n_sheets,
  (SELECT CAST(sum(n) AS BIGINT) FROM cs c WHERE c.image_id = p.image_id) AS n_regions FROM pk p GROUP BY image_id""", "v_styled"),
    "diagnose_runs": _CLASSED + "SELECT run_id, code, headline, path, problem FROM worded JOIN resolved USING (run_id)",
}
