"""Controls of running queries: cancellation, time limits, progress, threads and what errors do."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cancelled(RuntimeError):
    """The query was cancelled, or its time was up."""


class Control:
    """A handle of the jobs that run inside ``running``; another thread may cancel them or ask for their progress."""

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark, self.seconds = spark, seconds
        self.tag = f"vellum-{uuid.uuid4().hex}"
        self.cancelled = False
        self._most = (0, 0)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """For loops on the driver: raises once the flag is set."""
        if self.cancelled:
            raise Cancelled(self.tag)

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks known, neither ever less than before."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        done, total = sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)
        self._most = max(self._most[0], done), max(self._most[1], total, done)
        return self._most

    @contextmanager
    def running(self) -> Iterator[Control]:
        context = self.spark.sparkContext
        timer = threading.Timer(self.seconds, self.cancel) if self.seconds else None
        context.addJobTag(self.tag)
        if timer:
            timer.daemon = True
            timer.start()
        try:
            self.check()
            yield self
            self.check()
        except Cancelled:
            raise
        except Exception as e:
            if self.cancelled:
                raise Cancelled(self.tag) from e
            raise
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(self.tag)


def threads(run: int | None, everywhere: int | None, automatic: int) -> int:
    """How many partitions a shuffle has: the run's number, else the global one, else the automatic one; 1 at least."""
    return max(1, next(n for n in (run, everywhere, automatic) if n))


@contextmanager
def partitions(spark: SparkSession, run: int | None = None, everywhere: int | None = None) -> Iterator[int]:
    before = spark.conf.get("spark.sql.shuffle.partitions")
    n = threads(run, everywhere, int(before))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def by_policy(rows: DataFrame, policy: str, state: str = "state") -> DataFrame:
    """``abort``: the first row whose state isn't ``ok`` fails the query; ``collect``: rows keep their state."""
    if policy == "collect":
        return rows
    fine = F.when(F.col(state) == "ok", F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("member failed: "), F.coalesce(F.col(state), F.lit("unknown")))))
    return rows.where(fine.isNull())


def wait(control: Control, work: Callable[[], object], every: float = 0.2, seen: Callable[[int, int], None] | None = None) -> object:
    """The result of ``work`` run under ``control``; ``seen`` is told the progress meanwhile."""
    over = threading.Event()

    def watch() -> None:
        while not over.wait(every):
            seen(*control.progress())

    watcher = threading.Thread(target=watch, daemon=True) if seen else None
    if watcher:
        watcher.start()
    try:
        with control.running():
            return work()
    finally:
        over.set()
        if watcher:
            watcher.join()
