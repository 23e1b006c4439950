"""Session set-up and the written tables that cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "panelflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a full URI of the session's file systems, so that Python tasks read and write where Spark does."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "panelflow", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table of this application."""
    return os.path.join(_scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def discard_scratch(spark: SparkSession) -> None:
    """Drop every intermediate table of this application, once its results are written."""
    _delete(spark, _scratch_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


ROWS_PER_FILE = 50_000


def files_for(rows: int) -> int:
    """Partitions for a narrow table of about so many rows: small tables should not become many tiny files."""
    return max(1, -(-rows // ROWS_PER_FILE))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute, survives lost executors, and a
    nondeterministic stage (a model call) runs exactly once per row.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Drop the files of a table made by :func:`materialize` that nothing reads any more."""
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain table scan at least as many partitions as there are cores.

    Only for scans feeding heavy per-row work: a table of few large row groups would
    otherwise keep most cores idle. A scan that already has enough is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
