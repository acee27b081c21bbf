"""Changes of options as a stream: a session's state decides which changes become jobs, and from which stage they run.

A change waits for ``wait`` milliseconds of event time; another change of its session in that time
takes its place. What runs is compared with the session's last run, so a row says the first stage
that has to run again. The batch form of the same rule is ``operators.jobs.debounced``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rasterloom.functions.workers import reach_workers
from rasterloom.operators.jobs import STAGE_OPTIONS

#: Milliseconds that a change waits for the next one.
WAIT = 150
#: The store that keyed state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dirty_stage(last: dict | None, new: dict) -> str:
    """The first stage to run again: 'pre' for a new image, 'fit' where no earlier stage's options differ."""
    if last is None or last.get("image_fp") != new.get("image_fp"):
        return "pre"
    for stage, options in STAGE_OPTIONS:
        if any(last.get(c) != new.get(c) for c in options):
            return stage
    return "fit"


class JobProcessor(StatefulProcessor):
    """State of a session: changes that wait, by job, and the image and options of its last run."""

    def __init__(self, wait: int, options: list[str]):
        self.wait, self.options = wait, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "job_id long", "ms long, change string")
        self.last = handle.getValueState("last", "change string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        for r in rows:
            if r.ms < now:  # late: what it could have changed is decided
                continue
            change = json.dumps({c: r[c] for c in self.options}, default=str)
            self.waiting.updateValue((r.job_id,), (r.ms, change))
            first = r.ms if first is None else min(first, r.ms)
        if first is not None:
            self.handle.registerTimer(first + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Decide every change whose time is over, in order; none that is earlier can come any more. The next one gets a timer."""
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((v[0], k[0], v[1]) for k, v in self.waiting.iterator())
        for i, (ms, job, change) in enumerate(waiting):
            if ms + self.wait > now:
                self.handle.registerTimer(ms + self.wait)
                break
            ran, stage = i + 1 == len(waiting) or waiting[i + 1][0] - ms >= self.wait, None
            if ran:
                was = self.last.get()
                stage = dirty_stage(json.loads(was[0]) if was else None, json.loads(change))
                self.last.update((change,))
            self.waiting.removeKey((job,))
            yield Row(session=key[0], job_id=job, run_ms=ms + self.wait, ran=ran, stage=stage)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The state store that the processor needs, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def job_stream(changes: DataFrame, wait: int = WAIT, delay: str = "0 seconds") -> DataFrame:
    """(session, job_id, run_ms, ran, stage) of each change of a stream, once its time is over.

    ``changes`` has session, job_id, ts, image_fp and any of the options that stages depend on.
    Changes that come more than ``delay`` behind the latest one seen are dropped. Start its query
    inside ``state_store``. Job ids are unique in a session; equal times are ordered by them.
    """
    known = [c for _, options in STAGE_OPTIONS for c in options if c in changes.columns]
    reach_workers(changes.sparkSession)
    rows = changes.withWatermark("ts", delay).select("session", "job_id", "ts", F.unix_millis("ts").alias("ms"), "image_fp", *known)
    schema = StructType.fromDDL("session string, job_id long, run_ms long, ran boolean, stage string")
    keyed = rows.withColumn("session", F.col("session").cast("string")).groupBy("session")
    return keyed.transformWithState(statefulProcessor=JobProcessor(wait, ["image_fp", *known]), outputStructType=schema, outputMode="Append", timeMode="EventTime")
