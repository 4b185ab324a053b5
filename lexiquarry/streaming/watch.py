"""When to reconcile: at the start, after a burst of changes has settled, and every so often anyway.

A hint carries no data, it only schedules a reconcile, which reads the tree itself. Hints can come from
a Structured Streaming query over the tree; since a file source shows neither deletions nor renames,
the periodic run bounds how late those are seen.
"""

from __future__ import annotations

import queue
import time
from collections.abc import Callable
from dataclasses import dataclass, field

CLOSED, OVERFLOW, HINT = "closed", "overflow", "hint"


class Clock:
    def now(self) -> float:
        return time.monotonic()


class Events:
    """A queue of hints; ``wait`` gives the next one, or None after ``timeout`` seconds."""

    def __init__(self):
        self._queue: queue.Queue = queue.Queue()

    def put(self, event: str = HINT) -> None:
        self._queue.put(event)

    def wait(self, timeout: float) -> str | None:
        try:
            return self._queue.get(timeout=max(timeout, 0.001))
        except queue.Empty:
            return None


def watch(events: Events, reconcile: Callable[[], None], debounce: float = 0.5, periodic: float = 600.0, clock: Clock | None = None) -> int:
    """Runs until the source closes; returns how often it reconciled."""
    clock = clock or Clock()
    reconcile()
    runs, last = 1, clock.now()
    while True:
        event = events.wait(max(0.0, last + periodic - clock.now()))
        if event == CLOSED:
            return runs
        if event is None:
            if clock.now() < last + periodic:
                continue
        else:
            settled = clock.now() + debounce
            while (left := settled - clock.now()) > 0 and clock.now() < last + periodic:
                event = events.wait(left)
                if event == CLOSED:
                    return runs
                if event is not None:
                    settled = clock.now() + debounce
        reconcile()
        runs, last = runs + 1, clock.now()


def stream_hints(spark, root: str, events: Events, checkpoint: str, interval: str = "500 milliseconds"):
    """A streaming query over the tree that puts a hint for every batch with new or changed files."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root).select("path", "modificationTime", "length")

    def batch(frame, _) -> None:
        if not frame.isEmpty():
            events.put(HINT)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def indexed_stream(frames, store_batch: Callable, checkpoint: str):
    """Micro-batches of (id, text) handed to ``store_batch(frame, batch_id)``; all that has come is worked off, then it stops."""
    return frames.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Governor:
    """Holds background work to so many bytes a second and a share of the time; pauses on low resources."""

    bytes_per_second: float = 50 << 20
    duty: float = 0.5
    pause_seconds: float = 30.0
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    must_pause: Callable[[], bool] = lambda: False
    _tokens: float = field(default=-1.0)
    _at: float = field(default=0.0)

    def spend(self, n: int) -> float:
        """Waits until ``n`` bytes may be read; a burst is one second's worth. Returns the seconds waited."""
        now = self.now()
        if self._tokens < 0:
            self._tokens, self._at = self.bytes_per_second, now
        self._tokens = min(self.bytes_per_second, self._tokens + (now - self._at) * self.bytes_per_second)
        self._at = now
        self._tokens -= n
        wait = max(0.0, -self._tokens / self.bytes_per_second)
        if wait:
            self.sleep(wait)
        return wait

    def rest(self, worked: float) -> float:
        """After ``worked`` seconds of work, sleeps so that work is ``duty`` of the time."""
        wait = worked * (1 - self.duty) / self.duty if 0 < self.duty < 1 else 0.0
        if wait:
            self.sleep(wait)
        while self.must_pause():
            self.sleep(self.pause_seconds)
            wait += self.pause_seconds
        return wait
