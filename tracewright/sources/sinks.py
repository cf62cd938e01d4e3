"""Writers (K1-K8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates


def append_jsonl(df: DataFrame, path: str) -> None:
    """K1"""
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """K2"""
    df.write.mode("overwrite").json(path)


def summary(df: DataFrame, path: str) -> None:
    """K3: a small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def parquet(df: DataFrame, path: str) -> None:
    """K4"""
    df.write.mode("overwrite").parquet(path)


def by_arm_and_split(df: DataFrame, path: str) -> None:
    """K5: a folder for each arm and split; rows of one cell are written by as many tasks as it has partitions."""
    df.write.mode("overwrite").partitionBy("arm", "split").parquet(path)


def paired(dialogue: DataFrame, monologue: DataFrame, path: str, key: str = "pid") -> None:
    """K6: both arms by key, in key order; fails if they cover different keys."""
    gates.same_keys(dialogue, monologue, key)
    dialogue.join(monologue, key).orderBy(key).write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: list[str], schema) -> None:
    """Append what the sink doesn't have yet."""
    from pyspark.errors import AnalysisException

    from ..operators import corpus

    try:
        done = df.sparkSession.read.schema(schema).parquet(path)
        done.schema
    except AnalysisException:
        done = None
    (df if done is None else corpus.not_done(df, done, key)).write.mode("append").parquet(path)


def open_chunks(plan: DataFrame, path: str, chunk: str = "chunk") -> DataFrame:
    """T-5: the plan's rows of chunks that have no file yet."""
    from pyspark.errors import AnalysisException

    try:
        whole = plan.sparkSession.read.schema(f"{chunk} long").parquet(path).select(chunk).distinct()
        whole.schema
    except AnalysisException:
        return plan
    return plan.join(whole, chunk, "left_anti")


def write_chunks(plan: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], chunk: str = "chunk", tasks: int | None = None) -> None:
    """K7, T-5: works all open chunks off in one job, a folder for each.

    A chunk is one task's (which may have several), before the work and so in its file, and a task's files are moved to their place
    when it ends (Hadoop's committer of version 2), not when the job does: a chunk is whole if it has a file. After a run that
    broke off, the chunks of the tasks that had ended are there, and the next run works off the rest. work() maps rows (a shuffle in
    it would part a chunk). A chunk that yields no row has no file, and is worked off again by each run.
    """
    width = tasks or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = work(open_chunks(plan, path, chunk).repartition(width, chunk))
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(chunk).parquet(path)


def commit_chunks(plan: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], chunk: str = "chunk") -> list[int]:
    """K7, T-5 for work that must see one chunk alone (write_chunks has one job for all): works a plan's chunks off one after the other, each into a folder of its own that counts once its
    _SUCCESS is there; a run that broke off goes on with what isn't whole. The plan stays the same over restarts. Returns
    the chunks of this run; only their numbers reach the driver."""
    spark = plan.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for (i,) in plan.select(chunk).distinct().orderBy(chunk).collect():
        folder = f"{path}/{chunk}={i}"
        if not system.exists(place(f"{folder}/_SUCCESS")):
            work(plan.filter(F.col(chunk) == i)).drop(chunk).write.mode("overwrite").parquet(folder)
            done.append(i)
    return done
