"""python tests/check.py [sf] [name ...]: compare registered queries with their SQL twins."""

import os
import pathlib
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from oracle import connect, difference  # noqa: E402

from panelflow.plans import catalog  # noqa: E402
from panelflow.session import build_session  # noqa: E402


def main(sf="0.001", *names):
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": os.environ.get("CHECK_PARTITIONS", "8"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ckpt-")})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    for name in names or queries:
        begin = time.time()
        try:
            if name in oracles:
                told = difference(spark, con, sf_dir, queries[name], oracles[name]) or "ok"
            else:
                told = f"no sql, {queries[name](spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            told = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:32s} {time.time() - begin:6.1f}s  {told}", flush=True)


main(*sys.argv[1:])
