"""Jobs: phases in their order, one worker, stopping between items, smoothed pace."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: Phases in order, and those that end a job.
PHASES = ("queued", "checking", "manifest", "loading", "processing", "consolidating", "clustering")
ENDED = ("done", "failed", "stopped")


class Stopped(Exception):
    pass


@dataclass
class Job:
    job_id: int
    event_id: str
    steps: dict[str, Callable[["Job"], None]]
    phase: str = "queued"
    error: str | None = None
    done: int = 0
    total: int = 0
    pace: float | None = None
    recorded: bool = False
    history: list[str] = field(default_factory=lambda: ["queued"])
    stop: threading.Event = field(default_factory=threading.Event)
    _last: float | None = None

    @property
    def finished(self) -> bool:
        """Ended, and its end is on record."""
        return self.phase in ENDED and self.recorded

    def enter(self, phase: str) -> None:
        self.phase = phase
        self.history.append(phase)

    def item(self, now: float | None = None) -> None:
        """Called after each item: counts, smooths the pace, and stops here if asked to."""
        now = time.monotonic() if now is None else now
        if self._last is not None:
            self.pace = (now - self._last) if self.pace is None else 0.7 * self.pace + 0.3 * (now - self._last)
        self._last = now
        self.done += 1
        if self.stop.is_set():
            raise Stopped

    @property
    def seconds_left(self) -> float | None:
        return None if self.pace is None else max(0, self.total - self.done) * self.pace


class Runner:
    """Runs jobs one after another; `record` is told of each end."""

    def __init__(self, record: Callable[[Job], None] = lambda job: None):
        self.jobs: list[Job] = []
        self._queue: queue.Queue[Job | None] = queue.Queue()
        self._record = record
        self._worker = threading.Thread(target=self._work, daemon=True)
        self._worker.start()

    def submit(self, event_id: str, steps: dict[str, Callable[[Job], None]]) -> Job:
        if unknown := [p for p in steps if p not in PHASES]:
            raise ValueError(f"no such phase: {unknown[0]}")
        job = Job(len(self.jobs), event_id, steps)
        self.jobs.append(job)
        self._queue.put(job)
        return job

    def active(self, event_id: str) -> Job | None:
        return next((j for j in reversed(self.jobs) if j.event_id == event_id and not j.finished), None)

    def close(self) -> None:
        self._queue.put(None)
        self._worker.join()

    def _work(self) -> None:
        while (job := self._queue.get()) is not None:
            try:
                for phase in PHASES[1:]:
                    if job.stop.is_set():
                        raise Stopped
                    if phase in job.steps:
                        job.enter(phase)
                        job.steps[phase](job)
                job.enter("done")
            except Stopped:
                job.enter("stopped")
            except Exception as e:  # one job's failure must not end the worker
                job.error = f"{type(e).__name__}: {e}"
                job.enter("failed")
            finally:
                self._record(job)
                job.recorded = True
