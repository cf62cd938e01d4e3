"""A tracker beside the metric sink that can't hold it up (T-4).

The tracker lives on one thread of its own: it is opened there, gets every point there, and is closed there. Callers hand
points over through a bounded queue and never wait: what finds no room is dropped and counted. Opening is time-boxed;
points that were queued for a tracker that doesn't open in time, or can't be opened, are dropped and counted. A point that
the tracker refuses counts as failed. offered = sent + failed + dropped + waiting, at any time.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .metrics import started

POINT = "step bigint, metrics map<string,double>"
COUNTS = "sent bigint, failed bigint, dropped bigint, waiting bigint"


class Tracker:
    """open() gives an object with log(metrics, step) and, if it likes, finish()."""

    def __init__(self, open: Callable[[], object], start_seconds: float = 60.0, capacity: int = 10_000):
        self._waiting: queue.Queue = queue.Queue(capacity)
        self._lock = threading.Lock()
        self._opened, self._given_up, self._done = (threading.Event() for _ in range(3))
        self.sent = self.failed = self.dropped = 0
        threading.Thread(target=self._serve, args=(open,), daemon=True).start()
        self._box = threading.Timer(start_seconds, self._give_up)
        self._box.daemon = True
        self._box.start()

    @property
    def waiting(self) -> int:
        return self._waiting.qsize()

    def room(self) -> int:
        """How many points can be handed over now."""
        return 0 if self._given_up.is_set() else self._waiting.maxsize - self._waiting.qsize()

    def offer(self, points, more: int = 0, patience: float = 0.0) -> int:
        """Hands over (step, metrics) as far as there is room; `more` points that were not even read count as dropped. With patience it
        waits for room, for so many seconds at most over all points, and no longer than the tracker's time to open."""
        taken = lost = 0
        until = time.monotonic() + patience
        for point in points:
            try:
                if self._given_up.is_set():
                    raise queue.Full
                try:
                    self._waiting.put_nowait(point)
                except queue.Full:
                    self._waiting.put(point, timeout=max(0.0, until - time.monotonic()))
                taken += 1
            except queue.Full:
                lost += 1
        self._drop(lost + more)
        if self._given_up.is_set():
            self._empty()
        return taken

    def finish(self, seconds: float = 10.0) -> bool:
        """Lets the tracker work off what waits and close, for so long at most; True if it did. What is left then is dropped."""
        try:
            self._waiting.put(None, timeout=seconds)
        except queue.Full:
            pass
        closed = self._done.wait(seconds)
        if not closed:
            self._give_up(even_opened=True)
        return closed and not self._given_up.is_set()

    def counts(self) -> dict[str, int]:
        return {"sent": self.sent, "failed": self.failed, "dropped": self.dropped, "waiting": self.waiting}

    def _drop(self, n: int) -> None:
        with self._lock:
            self.dropped += n

    def _give_up(self, even_opened: bool = False) -> None:
        if even_opened or not self._opened.is_set():
            self._given_up.set()
            self._empty()

    def _empty(self) -> None:
        while True:
            try:
                self._drop(self._waiting.get_nowait() is not None)
            except queue.Empty:
                return

    def _serve(self, open: Callable[[], object]) -> None:
        try:
            tracker = open()
        except Exception:
            tracker = None
        self._opened.set()
        if tracker is None or self._given_up.is_set():
            self._give_up(even_opened=True)
            self._done.set()
            return
        while not self._given_up.is_set():
            point = self._waiting.get()
            if point is None:
                break
            try:
                tracker.log(point[1], step=point[0])
                self.sent += 1
            except Exception:
                self.failed += 1
        try:
            getattr(tracker, "finish", lambda: None)()
        except Exception:
            pass
        self._done.set()


def write_tracked(stream: DataFrame, out: str, checkpoint: str, tracker: Tracker, available_now: bool = True):
    """Points (step, metrics) as JSON lines, a folder batch=N for each micro-batch (a batch that is repeated replaces its own), and
    then to the tracker. The tracker gets what it has room for, read back from what was written; the rest isn't fetched."""

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{out}/batch={number}"
        batch.write.mode("overwrite").json(folder)
        written = batch.sparkSession.read.schema(POINT).json(folder)
        n, room = written.count(), tracker.room()
        points = [(r["step"], r["metrics"]) for r in written.orderBy("step").limit(room).collect()] if room and n else []
        tracker.offer(points, more=n - len(points))

    return started(stream, write, checkpoint, available_now)


def write_tracked_by_task(
    stream: DataFrame, out: str, checkpoint: str, counts: str, open: Callable[[], object], start_seconds: float = 60.0, capacity: int = 10_000, patience: float = 0.0,
    finish_seconds: float = 10.0, available_now: bool = True,
):
    """As write_tracked, for more points than the driver takes: every task that reads a micro-batch back opens a tracker of its own
    and hands it all points of its part, as Tracker.offer does with that patience for a task. No point passes the driver. What became of them is
    written to the folder `counts`, a row a task below batch=N. A task takes `patience` and `finish_seconds` longer at most."""

    def serve(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tracker, until = Tracker(open, start_seconds, capacity), time.monotonic() + patience
        for batch in batches:
            points = zip(batch.column(0).to_pylist(), (dict(m or ()) for m in batch.column(1).to_pylist()), strict=True)
            tracker.offer(points, patience=max(0.0, until - time.monotonic()))
        tracker.finish(finish_seconds)
        yield pa.RecordBatch.from_pylist([tracker.counts()])

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{out}/batch={number}"
        batch.write.mode("overwrite").json(folder)
        batch.sparkSession.read.schema(POINT).json(folder).mapInArrow(serve, COUNTS).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return started(stream, write, checkpoint, available_now)
