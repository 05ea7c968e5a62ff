"""Progress of a run: a counter that speaks now and then, and a watch on a session's tasks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two messages, at least.
SPACING = 0.25


class Counter:
    """Counts steps and bytes from any thread, and tells ``tell`` (done, total, bytes) of them at most
    every ``spacing`` seconds, and once more when all steps are done."""

    def __init__(self, total: int, tell: Callable[[int, int, int], None], spacing: float = SPACING, clock: Callable[[], float] = time.monotonic) -> None:
        self.total, self.tell, self.spacing, self.clock = total, tell, spacing, clock
        self.done = self.bytes = 0
        self._spoke, self._lock = -float("inf"), threading.Lock()

    def step(self, steps: int = 1, size: int = 0) -> None:
        with self._lock:
            self.done += steps
            self.bytes += size
            now = self.clock()
            if now - self._spoke < self.spacing and self.done != self.total:
                return
            self._spoke = now
            told = self.done, self.total, self.bytes
        self.tell(*told)


@contextmanager
def watched(spark: SparkSession, tell: Callable[[str, int, int], None], label: str = "echofold", spacing: float = SPACING) -> Iterator[None]:
    """Tells (label, tasks done, tasks known) of the jobs that run inside the block, by Spark's own
    counts: when they have changed, and at most every ``spacing`` seconds."""
    context, group, stop = spark.sparkContext, f"{label}-{time.time_ns()}", threading.Event()
    context.setJobGroup(group, label)
    tracker, seen = context.statusTracker(), {}

    def look() -> tuple[int, int]:
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                told = tracker.getStageInfo(stage)
                if told and told.numCompletedTasks + told.numActiveTasks:  # stages that are skipped never start
                    seen[stage] = (told.numCompletedTasks, told.numTasks)
        return sum(d for d, _ in seen.values()), sum(n for _, n in seen.values())

    def poll() -> None:
        last = (0, 0)
        while True:
            ended = stop.wait(spacing)
            now = look()
            if now != last:
                tell(label, *now)
                last = now
            if ended:
                return

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
