"""What the operators of this package share: staging, numbering and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []
_MADE: list[str] = []
#: The folders of the run that is under way, if one is (each thread has its own).
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)
#: Staged tables (kept, so that an id stays theirs) and their folders.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; unset, one of our own if all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is unset, and on {master} a folder of this machine would not be shared")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tracewright-"))
    return _OWN_DIR[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    path = f"{shared_dir(spark)}/tracewright-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if _RUN.get() is not None:
        _RUN.get().append(path)
    return path


@contextmanager
def run_folders():
    """The list of the folders that are made in this thread until the end of the block, by this run alone; runs may be nested."""
    own: list[str] = []
    outer = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(outer)
        if _RUN.get() is not None:
            _RUN.get().extend(own)


def made() -> list[str]:
    """The folders that this driver made in the shared one and that are still there."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the folders that this driver made in the shared one (or these of them). For the end of a job, or of a
    part of it whose result is written: results that still read them are lost."""
    gone = 0
    for path in made() if paths is None else list(paths):
        if path in _MADE:  # what a step has unstaged itself is gone already
            _MADE.remove(path)
            gone += _delete(spark, path)
    for key, (_, path) in list(_PATHS.items()):
        if path not in _MADE:
            del _PATHS[key]
    return gone


def stage(df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back. options: further ones of the writer.

    This cuts the lineage (a lost executor re-reads files instead of recomputing), and pins
    non-deterministic columns such as partition numbers.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.options(compression=codec, **options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(staged)] = staged, path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Delete what stage() wrote for these, once nothing that is still to be computed reads it."""
    for df in staged:
        _, path = _PATHS.pop(id(df))
        _MADE.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `pos`, its 0-based place in the order, without a one-partition sort.

    Rows are dealt by range, sorted inside each partition and numbered there; the sizes of the
    partitions (as many rows as partitions) give each its offset.
    """
    width = shuffle_width(df.sparkSession)
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    placed = stage(
        dealt.withColumn("_at", mark).withColumn("_part", F.shiftright("_at", 33)), name
    ).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("pos", F.col("_off") + F.col("_at"))
        .drop("_part", "_at", "_off")
    )


def running_sum(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with `before`: the sum of value over the earlier rows of the group, in the order.

    A group may span many partitions: the range partitioning cuts it by the order columns, each
    piece is summed on its own, and the pieces' totals (partitions + groups rows) give the offsets.
    group must not be null.
    """
    width = shuffle_width(df.sparkSession)
    placed = stage(
        df.repartitionByRange(width, group, *order).withColumn("_part", F.spark_partition_id()), name
    )
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    pieces = placed.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_part", group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    return (
        local.join(offsets, ["_part", group])
        .withColumn("before", F.col("_local") + F.col("_off"))
        .drop("_part", "_local", "_off")
    )


def range_bounds(df: DataFrame, width: int, each: int = 20, most: int = 1_000_000) -> list[tuple]:
    """Up to width - 1 ascending rows of df (no nulls) that cut it into runs of like size.

    They come from a seeded sample of `each` rows a run, `most` in all, as Spark's own range partitioning takes
    its bounds: the sample decides where files end, never what is in them.
    """
    wanted = min(each * width, most)
    rows = df.count()
    some = df if rows <= wanted else df.sample(min(1.0, 1.1 * wanted / rows), 17)
    found = sorted(tuple(r) for r in some.collect())
    return sorted({found[len(found) * k // width] for k in range(1, width)}) if found else []
