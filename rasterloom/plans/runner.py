"""Jobs of sessions: a newer job of a session takes an older one's place, and stages tell how far they are."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans.jobs import vectorize_jobs
from rasterloom.plans.store import StageStore


class Superseded(Exception):
    """A newer job of the same session was submitted, or the session was cancelled."""


class JobRunner:
    """Runs one job of a session at a time, each in a thread whose Spark jobs carry a tag of its own.

    Submitting interrupts the Spark jobs of the session's job before. What that one had stored
    stays, so a job that differs only in later options goes on from there.
    """

    def __init__(self, spark: SparkSession, folder: str, progress: Callable[[str, int, str, dict], None] | None = None):
        """``progress`` gets the session, the number of its job, a stage, and its tables' rows once they are written."""
        self.spark, self.folder, self.progress = spark, folder, progress or (lambda *a: None)
        self.lock, self.running, self.numbers = threading.Lock(), {}, {}

    def cancel(self, session: str) -> None:
        """Stop the session's job, if one runs."""
        with self.lock:
            tag, stop = self.running.pop(session, (None, None))
        if tag:
            stop.set()
            self.spark.interruptTag(tag)

    def submit(self, session: str, pixels: DataFrame, jobs: DataFrame) -> Future:
        """The rows of ``vectorize_jobs`` as a list, or Superseded."""
        self.cancel(session)
        tag, stop, done = f"rasterloom-{uuid.uuid4().hex}", threading.Event(), Future()
        with self.lock:
            self.numbers[session] = number = self.numbers.get(session, 0) + 1
            self.running[session] = (tag, stop)

        def told(stage: str, rows: dict) -> None:
            if stop.is_set():  # between two Spark jobs there is nothing to interrupt
                raise Superseded(session)
            self.progress(session, number, stage, rows)

        def run() -> None:
            self.spark.addTag(tag)
            try:
                rows = vectorize_jobs(pixels, jobs, StageStore(self.spark, self.folder, told)).collect()
                if stop.is_set():
                    raise Superseded(session)
                done.set_result(rows)
            except Exception as e:
                done.set_exception(Superseded(session) if stop.is_set() else e)
            finally:
                self.spark.removeTag(tag)
                with self.lock:
                    if self.running.get(session, (None,))[0] == tag:
                        del self.running[session]

        InheritableThread(target=run, session=self.spark, daemon=True).start()
        return done
