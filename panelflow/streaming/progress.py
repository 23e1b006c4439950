"""The progress log as a stream: source attribution, live status, timeouts, ordered release, acknowledgements.

Log lines carry a time of day only. Event time is the ingestion date plus that time; a
time more than twelve hours behind the ingestion time is taken as just after midnight,
one more than twelve hours ahead as just before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelflow.functions import progress as p
from panelflow.operators.archives import acknowledgement_lines
from panelflow.operators.status import attribute_source, latest_status, parse_progress
from panelflow.session import scratch_path

DEFAULT_DELAY = "10 minutes"
# How long a labelled pass, a rendering and a whole request may take, in seconds.
PASS_LIMIT, RENDER_LIMIT, REQUEST_LIMIT, MODEL_REQUEST_LIMIT = 300, 15 * 60, 60 * 60, 3 * 60 * 60
# Keys of the state: tasks share a call, so that its cost is by lines and not by tasks.
BUCKETS = 1024


def event_time(ingested: Column, time_of_day: Column) -> Column:
    """Timestamp of a line from when it came in and the ``HH:MM:SS`` it carries."""
    day = F.date_trunc("DAY", ingested)
    seconds = (
        F.substring(time_of_day, 1, 2).cast("int") * 3600 + F.substring(time_of_day, 4, 2).cast("int") * 60
        + F.substring(time_of_day, 7, 2).cast("int"))
    at = F.unix_seconds(day) + seconds
    apart = at - F.unix_seconds(ingested)
    return F.timestamp_seconds(at + F.when(apart < -43200, 86400).when(apart > 43200, -86400).otherwise(0))


def progress_stream(lines: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Streaming (seq, ingested, line) -> parsed, classified lines with ``event_at`` and its watermark."""
    parsed = parse_progress(lines.select("seq", "ingested", "line"))
    return parsed.withColumn("event_at", event_time(F.col("ingested"), F.col("time"))).withWatermark("event_at", delay)


ATTRIBUTED = (
    "task_number bigint, seq bigint, time string, image_number bigint, detail string, stage string, state string, "
    "terminal boolean, source string, source_label string, timed_out boolean"
)
_COLUMNS = [c.split()[0] for c in ATTRIBUTED.split(", ")]


_PHASED = [c for c in _COLUMNS if c != "timed_out"] + ["event_at", "phase"]


def _phase(detail: Column, terminal: Column) -> Column:
    """What a line is to its task's pass: ``begin``, ``end`` or null."""
    begins = detail.endswith("시작") | detail.contains(" 시작 ·")
    return F.when(begins, "begin").when(terminal | detail.contains(" 완료 ·") | detail.endswith("완료"), "end")


class TaskSource(StatefulProcessor):
    """Remembers each task's source and its running pass; a key is a bucket of tasks, whose lines are worked on as columns.

    Lines before a task's first source are dropped, as in the batch job. A pass whose
    limit runs out in event time without an end, or before its end, gives one extra row
    with ``timed_out``.
    The state is kept by task: a call reads and writes that of the tasks it has lines of. A bucket has one timer, at
    or before its earliest deadline; when it runs, the bucket's running passes are looked through once.
    What one call holds is one bucket's lines of one trigger, which the source's
    ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` bounds; for the status table itself use
    :func:`live_status`, which has no such group.
    """

    def __init__(self, limit_seconds: int = PASS_LIMIT):
        self.limit_ms = limit_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.source = handle.getMapState("source", "task_number bigint", "source string, source_label string")
        self.running = handle.getMapState("running", "task_number bigint", "image_number bigint, detail string, deadline bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the lines of one trigger, in order; earlier triggers are in the state
        lines = pd.concat(list(rows), ignore_index=True).sort_values(["task_number", "seq"], ignore_index=True)
        known = self._fill(lines)
        late = self._passes(lines)
        yield lines[known].assign(timed_out=False)[_COLUMNS]
        if late:
            yield self._told(late)

    def _fill(self, lines: pd.DataFrame) -> np.ndarray:
        """Fill in the sources of ``lines``; tells which lines have one."""
        task, source, label = (lines[c].to_numpy(dtype) for c, dtype in (("task_number", None), ("source", object), ("source_label", object)))
        place, told = np.arange(len(lines)), lines["source"].notna().to_numpy()
        first = _changes(task)
        source, label, before = source.copy(), label.copy(), {}
        for i in np.flatnonzero(first & ~told):
            state = self.source.getValue((int(task[i]),))
            if state:
                before[task[i]] = source[i], label[i] = tuple(state)
                told[i] = True
        at = np.maximum.accumulate(np.where(told, place, -1))
        known = at >= np.maximum.accumulate(np.where(first, place, 0))
        lines["source"], lines["source_label"] = np.where(known, source[at], None), np.where(known, label[at], None)
        for i in np.flatnonzero(known & np.roll(first, -1)):
            pair = (source[at[i]], label[at[i]])
            if before.get(task[i]) != pair:
                self.source.updateValue((int(task[i]),), pair)
        return known

    def _passes(self, lines: pd.DataFrame) -> list:
        """Take the passes that begin and end into the state; gives rows of those that ran too long."""
        steps = lines[lines["phase"].notna()]
        task, image, detail = steps["task_number"].to_numpy(), steps["image_number"].tolist(), steps["detail"].tolist()
        at = steps["event_at"].to_numpy("datetime64[ms]").astype("int64")
        # a pass that begins at no known time has no limit
        begins, first = ((steps["phase"] == "begin") & steps["event_at"].notna()).to_numpy(), _changes(task)
        # each step ends the pass that the one before it began
        running = [(n, text, ms + self.limit_ms) if b else None for n, text, ms, b in zip(image, detail, at.tolist(), begins)]
        before = {t: self.running.getValue((t,)) for t in task[first].tolist()}
        ended = [before[t] if f else pass_ for t, f, pass_ in zip(task.tolist(), first, [None, *running])]
        told = zip(task.tolist(), at.tolist(), ended, steps["source"].tolist(), steps["source_label"].tolist())
        late = [(t, pass_[0], pass_[1], *pair) for t, ms, pass_, *pair in told if pass_ and ms > pass_[2]]
        earliest = None
        for i in np.flatnonzero(np.roll(first, -1)):
            t, now = int(task[i]), running[i]
            if now:
                self.running.updateValue((t,), now)
                earliest = now[2] if earliest is None else min(earliest, now[2])
            elif before[t]:
                self.running.removeKey((t,))
        if earliest is not None:
            timer = self.timer.get()[0] if self.timer.exists() else None
            if timer is None or earliest < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self._wake(earliest)
        return late

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        passes = [(task, tuple(state)) for (task,), state in self.running.iterator()]
        late = []
        for task, (image_number, detail, deadline) in sorted(passes):
            if deadline < now:
                late.append((task, image_number, detail, *(self.source.getValue((task,)) or (None, None))))
                self.running.removeKey((task,))
        left = [state[2] for _, state in passes if state[2] >= now]
        if left:
            self._wake(min(left))
        else:
            self.timer.clear()
        yield self._told(late)

    @staticmethod
    def _told(late: list) -> pd.DataFrame:
        return pd.DataFrame(
            [(task, None, None, image_number, detail, "오류", "error", False, *source, True) for task, image_number, detail, *source in late],
            columns=_COLUMNS)

    def close(self) -> None:
        pass


def _changes(keys: np.ndarray) -> np.ndarray:
    """True where a sorted key is not that of the row before; ``np.roll`` by -1 gives the last rows."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def attributed_stream(progress: DataFrame, limit_seconds: int = PASS_LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """The stream of :func:`progress_stream` with each line's source filled in, plus timeouts.

    ``buckets`` is part of the state and must stay as it was when the stream first started.
    """
    phased = progress.withColumn("phase", _phase(F.col("detail"), F.col("terminal"))).select(
        F.pmod(F.xxhash64("task_number"), F.lit(buckets)).alias("bucket"), *_PHASED)
    told = phased.groupBy("bucket").transformWithStateInPandas(
        TaskSource(limit_seconds), outputStructType=ATTRIBUTED, outputMode="Append", timeMode="EventTime")
    return told.withColumn("row_key", p.row_key(F.col("source"), F.col("task_number"), F.col("image_number"))).withColumn(
        "name", F.when(F.col("source") == "web", p.web_source_name(F.col("detail"), F.col("image_number"))).otherwise(F.lit("")))


class StatusTable:
    """Live status kept by plain micro-batches, without keyed state.

    Every batch writes two small parts named after it, so a repeated batch overwrites
    itself: the latest row per key, and the last source per task. A batch attributes its
    lines set-based (a hot task is split into blocks like in the batch job) and falls back
    to the sources of the batches before. :meth:`compact` folds the parts together.
    """

    def __init__(self, path: str, block: Column | None = None):
        self.path, self.block = path, block

    def _sources(self, spark, before: int) -> DataFrame | None:
        path = f"{self.path}/sources"
        if not _exists(spark, path):
            return None
        parts = spark.read.parquet(path).where(F.col("batch") < before)
        return parts.groupBy("task_number").agg(F.max_by(F.struct("source", "source_label"), "seq").alias("__before"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("seq", "time", "task_number", "image_number", "detail", "stage", "state", "terminal", "source", "source_label")
        batch.persist()
        attributed = attribute_source(batch, self.block, self._sources(batch.sparkSession, batch_id))
        latest_status(attributed).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        batch.where("source is not null").groupBy("task_number").agg(
            F.max_by(F.struct("source", "source_label"), "seq").alias("__s"), F.max("seq").alias("seq")).select(
            "task_number", "seq", "__s.*").write.mode("overwrite").parquet(f"{self.path}/sources/batch={batch_id}")
        batch.unpersist()

    def read(self, spark, skips: DataFrame | None = None) -> DataFrame:
        return latest_status(spark.read.parquet(f"{self.path}/rows").drop("batch"), skips)

    def compact(self, spark, path: str) -> "StatusTable":
        """The same table as a single part at ``path``, for a stream stopped after its last batch."""
        self.read(spark).write.parquet(f"{path}/rows/batch=-1")
        sources = spark.read.parquet(f"{self.path}/sources").groupBy("task_number").agg(
            F.max_by(F.struct("source", "source_label"), "seq").alias("__s"), F.max("seq").alias("seq"))
        sources.select("task_number", "seq", "__s.*").write.parquet(f"{path}/sources/batch=-1")
        return StatusTable(path, self.block)


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def live_status(progress: DataFrame, table: StatusTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Start keeping ``table`` up to date from the stream of :func:`progress_stream`."""
    return (
        progress.writeStream.outputMode("append").foreachBatch(table.write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


RELEASED = "archive bigint, entry_index bigint, name string"


class OrderedRelease(StatefulProcessor):
    """Holds entries that are ready too early and lets them go in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "entry_index bigint")
        self.waiting = handle.getMapState("waiting", "entry_index bigint", "name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # only what has to wait longer goes into the state; in-order arrivals pass through
        arrived = {int(i): name for batch in rows for i, name in zip(batch["entry_index"], batch["name"])}
        index = self.next.get()[0] if self.next.exists() else 0
        out = []
        while True:
            if index in arrived:
                out.append((key[0], index, arrived.pop(index)))
            elif self.waiting.containsKey((index,)):
                out.append((key[0], index, self.waiting.getValue((index,))[0]))
                self.waiting.removeKey((index,))
            else:
                break
            index += 1
        for later, name in arrived.items():
            self.waiting.updateValue((later,), (name,))
        self.next.update((index,))
        yield pd.DataFrame(out, columns=["archive", "entry_index", "name"])

    def close(self) -> None:
        pass


def ordered_release_stream(ready: DataFrame) -> DataFrame:
    """(archive, entry_index, name) in any order -> the same in order, each as soon as all before it came."""
    return ready.groupBy("archive").transformWithStateInPandas(
        OrderedRelease(), outputStructType=RELEASED, outputMode="Append", timeMode="None")


def acknowledged_stream(requests: DataFrame, acks: DataFrame, delay: str = DEFAULT_DELAY, within: str = "3 hours") -> DataFrame:
    """Requests (request_id, requested_at) with their acknowledgements (request_id, acked_at, ...).

    A request without one comes out with nulls once the watermark has passed ``within``.
    """
    asked = requests.withWatermark("requested_at", delay).alias("r")
    answered = acknowledgement_lines(acks).withWatermark("acked_at", delay).alias("a")
    return asked.join(
        answered,
        F.expr(f"r.request_id = a.request_id and a.acked_at >= r.requested_at and a.acked_at <= r.requested_at + interval {within}"),
        "left",
    ).select("r.request_id", "r.requested_at", "a.acked_at", "a.success", "a.message")


def run_live_status(progress: DataFrame, skips: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """Process everything available into a fresh status table and return its content."""
    spark = progress.sparkSession
    table = StatusTable(scratch_path(spark, "status"), block)
    live_status(progress, table, scratch_path(spark, "status-checkpoint")).awaitTermination()
    return table.read(spark, skips)
