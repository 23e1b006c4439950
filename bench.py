"""Headline queries, timed: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
BENCH_QUERIES (comma separated, or ``all``) overrides the headline list.
"""

from __future__ import annotations

import json
import os
import time

from panelflow.plans import catalog
from panelflow.session import build_session

HEADLINE = (
    "latest_status", "slot_usage", "quarantined_regions", "normalize_regions", "overlap_report", "dedup_regions",
    "dedup_chained_regions", "plan_crops", "batch_tiles", "fit_captions", "diagnostic_details", "failure_class", "resolve_results",
    "harvest_images", "page_summary", "archive_summary", "upsert_entries", "archive_roundtrip", "review_outcomes",
    "lexicon_translation", "tile_stats", "glyph_components", "text_presence", "live_status", "acknowledged_requests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = catalog.queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries["latest_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and Python workers
    timings = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
