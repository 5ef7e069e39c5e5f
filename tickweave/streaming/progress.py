"""Progress and cancellation of queries."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with each micro-batch's number, input rows and rows a second, and once a query has ended, with its error if any."""

    def __init__(self, on_batch: Callable[[int, int, float], None], on_end: Callable[[str | None], None] = lambda error: None) -> None:
        self.on_batch, self.on_end = on_batch, on_end

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.on_batch(p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.on_end(event.exception)


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs of the block carry a tag; the function that it gives cancels those that run, from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield lambda: spark.sparkContext.cancelJobsWithTag(tag)
    finally:
        spark.sparkContext.removeJobTag(tag)


def stage_progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    found = (tracker.getStageInfo(s) for s in tracker.getActiveStageIds())
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in found if i]


def wait(condition: Callable[[], bool], seconds: float) -> bool:
    """Whether a condition came true in time."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if condition():
            return True
        time.sleep(0.05)
    return False
