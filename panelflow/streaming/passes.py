"""Time limits of passes and requests in the progress log, as a stream.

Every labelled pass of an image, and its request as a whole, runs under a limit of its own. A task works on several of
them at once, so the state of an image is a map from label to the running pass. Images share the calls of a bucket, so that
the cost is by lines and not by images, and the bucket's one event-time timer. A line every ten seconds is a pass's sign of
life: it tells how long the pass has run, so it also opens a pass whose first line came before the stream.

A pass is reported once, when its end comes after its deadline or the watermark passes the deadline without an end. What is
reported does not depend on how lines are dealt to triggers, as long as none is later than the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelflow.streaming.progress import BUCKETS, MODEL_REQUEST_LIMIT, PASS_LIMIT, RENDER_LIMIT, REQUEST_LIMIT

# Wording of the log.
RECEIVED, REQUEST, MODEL_MODE = "요청 수신", "요청", "렌더 모드 · Codex"
RENDERS = ("Codex 이미지 렌더", "Codex 대사 작업 시트", "Codex 대사 크롭", "Codex 대사 영역")
_STARTS, _ALIVE, _ENDS = r"^(.*?) 시작(?: ·.*)?$", r"^(.*?) 진행 중 · (?:(\d+)분 )?(\d+)초 경과$", r"^(.*?) (?:완료(?: ·.*)?|실패 ·.*)$"

TIMED_OUT = "task_number bigint, image_number bigint, label string, started_at bigint, limit_seconds bigint, last_seen bigint"
_NAMES = [c.split()[0] for c in TIMED_OUT.split(", ")]


def pass_limit(label: Column) -> Column:
    """Seconds that a pass of this label may take: a request, a rendering, any other."""
    render = label.startswith(RENDERS[0])
    for name in RENDERS[1:]:
        render = render | label.startswith(name)
    return F.when(label == REQUEST, REQUEST_LIMIT).when(render, RENDER_LIMIT).otherwise(PASS_LIMIT)


def pass_lines(progress: DataFrame) -> DataFrame:
    """Parsed lines (with ``event_at``) -> those that begin, prove or end a pass: kind, label, elapsed, limit_seconds.

    ``close`` ends all passes of the image, ``model`` says that its request waits for the model.
    A line without a time has no place in the order and drops out. Works on streams.
    """
    detail = F.col("detail")
    minutes, seconds = (F.regexp_extract(detail, _ALIVE, g).try_cast("bigint") for g in (2, 3))

    def told(kind: str, label: Column, elapsed: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), (F.lit(None) if elapsed is None else elapsed).cast("bigint").alias("elapsed"))

    line = (
        F.when(F.col("terminal"), told("close", F.lit(REQUEST)))
        .when(detail.startswith(RECEIVED), told("start", F.lit(REQUEST)))
        .when(detail.startswith(MODEL_MODE), told("model", F.lit(REQUEST)))
        .when(detail.rlike(_ALIVE), told("alive", F.regexp_extract(detail, _ALIVE, 1), F.coalesce(minutes, F.lit(0)) * 60 + seconds))
        .when(detail.rlike(_STARTS), told("start", F.regexp_extract(detail, _STARTS, 1)))
        .when(detail.rlike(_ENDS), told("end", F.regexp_extract(detail, _ENDS, 1)))
    )
    # the event time in the test keeps Spark from pushing it, and all it is made of, below the watermark and into the scan
    told_at = F.when(F.col("event_at").isNotNull(), F.col("__p.kind"))
    return progress.withColumn("__p", line).where(told_at.isNotNull()).select(
        "task_number", "image_number", "seq", "event_at", "__p.kind", "__p.label", "__p.elapsed",
        pass_limit(F.col("__p.label")).cast("bigint").alias("limit_seconds"))


class PassLimits(StatefulProcessor):
    """The running passes of images; a key is a bucket of images.

    A bucket's running passes are one list, read and written once a call, and it has one timer, at or before its earliest
    deadline. So a call costs by its lines and by what runs in its bucket, not by images. It holds a bucket's lines of one
    trigger, which the source's options bound.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getListState(
            "running", "task_number bigint, image_number bigint, label string, started bigint, deadline bigint, seen bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows), ignore_index=True).sort_values(["event_at", "seq"], kind="stable")
        running, late = self._read(), []

        def finish(image: tuple, label: str, at: int) -> None:
            state = running[image].pop(label, None)
            if state and at > state[1]:
                late.append((image, label, state))

        images = zip(lines["task_number"].tolist(), lines["image_number"].tolist())
        times = lines["event_at"].to_numpy("datetime64[ms]").astype("int64").tolist()
        told = (lines[c].tolist() for c in ("kind", "label", "elapsed", "limit_seconds"))
        for image, at, kind, label, elapsed, limit in zip(images, times, *told):
            now = running.setdefault(image, {})
            if kind == "close":
                for other in sorted(now):
                    finish(image, other, at)
            elif kind == "model":
                if label in now and at <= now[label][1]:
                    started, _, seen = now[label]
                    now[label] = (started, started + MODEL_REQUEST_LIMIT * 1000, max(seen, at))
            elif kind == "alive":
                if label in now and at > now[label][1]:
                    finish(image, label, at)
                if label in now:
                    started, deadline, seen = now[label]
                    now[label] = (started, deadline, max(seen, at))
                elif elapsed <= limit:  # else its time-out was told before
                    started = at - int(elapsed) * 1000
                    now[label] = (started, started + int(limit) * 1000, at)
            else:
                finish(image, label, at)
                if kind == "start":
                    now[label] = (at, at + int(limit) * 1000, at)
        self._write(running)
        earliest = min((state[1] for passes in running.values() for state in passes.values()), default=None)
        if earliest is not None:
            timer = self.timer.get()[0] if self.timer.exists() else None
            if timer is None or earliest < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self._wake(earliest)
        yield self._told(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        running, late = self._read(), []
        for image, passes in sorted(running.items()):
            for label in sorted(label for label, state in passes.items() if state[1] <= now):
                late.append((image, label, passes.pop(label)))
        self._write(running)
        earliest = min((state[1] for passes in running.values() for state in passes.values()), default=None)
        if earliest is None:
            self.timer.clear()
        else:
            self._wake(earliest)
        yield self._told(late)

    def _read(self) -> dict[tuple, dict]:
        running: dict[tuple, dict] = {}
        for task, image, label, *times in self.running.get():
            running.setdefault((int(task), int(image)), {})[label] = tuple(map(int, times))
        return running

    def _write(self, running: dict[tuple, dict]) -> None:
        passes = [(*image, label, *state) for image, found in running.items() for label, state in found.items()]
        if passes:
            self.running.put(passes)
        else:
            self.running.clear()

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    @staticmethod
    def _told(late: list) -> pd.DataFrame:
        rows = [(*image, label, started // 1000, (deadline - started) // 1000, seen // 1000) for image, label, (started, deadline, seen) in late]
        return pd.DataFrame(rows, columns=_NAMES)

    def close(self) -> None:
        pass


def timed_out_stream(progress: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The stream of :func:`progress_stream` -> one row per pass or request that ran beyond its limit.

    ``started_at`` and ``last_seen`` are seconds since 1970; the latter is the last sign of life within the limit. Images are
    dealt to buckets, so a busy task is spread over the images it works on. ``buckets`` is part of the state and must stay as
    it was when the stream first started.
    """
    bucket = F.pmod(F.xxhash64("task_number", "image_number"), F.lit(buckets)).alias("bucket")
    return pass_lines(progress).select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        PassLimits(), outputStructType=TIMED_OUT, outputMode="Append", timeMode="EventTime")
