"""Training logs as metric streams (T-1..T-7). Logs are followed as they grow (see tail); a tracker stands beside the sink
(see tracker)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.text import metric_line
from .tail import LogTail

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def ensure_folder(spark: SparkSession, path: str) -> None:
    """T-3: a stream may start before its log does."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def points(lines: DataFrame, *keep: str) -> DataFrame:
    """step and metrics of the lines that have any, with what else is to be kept of the lines."""
    return lines.select(*keep, metric_line(F.col("value")).alias("m")).filter("m IS NOT NULL").select(*keep, "m.*")


def tailed(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """T-1, T-3: the lines (file, at, value) of logs that grow, and of those that come; split: bytes of a task's range."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", path)
    return (reader if split is None else reader.option("split", split)).load()


def metric_stream(spark: SparkSession, folder: str, first_only: bool = True) -> DataFrame:
    """T-1, T-2: the first record of each step, also across restarts (state: the steps seen). With first_only=False all
    records pass, for a merge of their maps."""
    ensure_folder(spark, folder)
    rows = points(tailed(spark, folder), "file", "at")
    return first_in_stream(rows) if first_only else rows.select("step", "metrics")


def first_in_stream(rows: DataFrame) -> DataFrame:
    """T-2 on a stream of file, at, step and metrics: of a step's records in one micro-batch the first by (file, at), and none in later
    ones. A step's state is its first record and the times of the first and last micro-batch that had it (equal: it is new); states
    are never dropped, as a step may be logged again at any time. For output mode update (write_metrics, write_tracked)."""
    timed = rows.withColumn("_now", F.current_timestamp())  # one time for a micro-batch
    seen = timed.groupBy("step").agg(F.min_by("metrics", F.struct("file", "at")).alias("metrics"), F.min("_now").alias("_from"), F.max("_now").alias("_to"))
    return seen.filter("_from = _to").select("step", "metrics")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their states in RocksDB, as states of all steps need not fit into memory."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    """Starts a stream whose micro-batches `write` gets with their numbers; one that is repeated comes with the same number."""
    writer = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    with state_on_disk(stream.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def write_metrics(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """T-1: points as JSON lines, a folder batch=N for each micro-batch (a batch that is repeated replaces its own); the checkpoint
    lets a restart go on where it stopped."""
    ensure_folder(stream.sparkSession, out)
    return started(stream, lambda batch, number: batch.write.mode("overwrite").json(f"{out}/batch={number}"), checkpoint, available_now)


def first_by_step(rows: DataFrame, order: list[str]) -> DataFrame:
    """T-2 on a table: the first record of each step in the order given."""
    return rows.groupBy("step").agg(F.min_by("metrics", F.struct(*order)).alias("metrics"))


def merged_by_step(rows: DataFrame, order: list[str]) -> DataFrame:
    """All metrics that any record of a step has; the first in the order counts (a variant that loses nothing)."""
    cells = rows.select("step", F.struct(*order).alias("o"), F.explode("metrics").alias("k", "v")).groupBy("step", "k").agg(F.min_by("v", "o").alias("v"))
    return cells.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics"))


def periodic_eval(rows: DataFrame, every: int) -> DataFrame:
    """T-7: means of graded completions in windows of `every` steps."""
    return rows.groupBy((F.expr(f"step div {every}") * every).alias("step")).agg(
        F.avg(F.col("correct").cast("int")).alias("val_accuracy"), F.avg(F.col("parsed").cast("int")).alias("parse_rate"), F.avg("n_tokens").alias("mean_completion_tokens"),
    )


class ProgressMonitor(StreamingQueryListener):
    """T-6: keeps the latest progress of queries aside from their sinks and tells stalled ones. It never blocks: of a
    full list the oldest entries go."""

    def __init__(self, stall_seconds: float = 5400, keep: int = 1000):
        from collections import deque

        self.stall_seconds, self.seen = stall_seconds, deque(maxlen=keep)
        self.last: dict[str, float] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event):
        self._mark(str(event.id))

    def onQueryProgress(self, event):
        self.seen.append((str(event.progress.id), event.progress.batchId, event.progress.numInputRows))
        if event.progress.numInputRows:
            self._mark(str(event.progress.id))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.id)] = event.exception

    def _mark(self, query: str) -> None:
        import time

        self.last[query] = time.monotonic()

    def stalled(self) -> list[str]:
        import time

        return [q for q, t in self.last.items() if q not in self.ended and time.monotonic() - t > self.stall_seconds]
