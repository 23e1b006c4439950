"""Counters of a job's stages, taken while their tables are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelflow.session import materialize


class StageMetrics:
    """Rows and failed rows of each stage, observed by the write itself, so that counting costs no further pass.

    The observation sits on top of the written plan, where every row passes once. It is for reporting: should Spark
    repeat a finished task after an executor is lost, its rows may count again; the written table is right regardless.
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, int, int]] = []

    def written(self, df: DataFrame, stage: str, failed: Column) -> DataFrame:
        """``df`` as a written table; a row with null in ``failed`` has not failed."""
        seen = Observation(stage)
        table = materialize(df.observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(failed, F.lit(False))).alias("n_failed")), stage)
        self._stages.append((stage, seen.get["n_rows"], seen.get["n_failed"]))
        return table

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, n_rows, n_failed), one row for each table written so far."""
        return spark.createDataFrame(self._stages, "stage string, n_rows bigint, n_failed bigint")
