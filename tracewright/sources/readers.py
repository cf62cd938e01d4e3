"""Scans (S1-S15)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import grading, text
from ..operators import sampling


def jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """Records by line; blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path, schema: str) -> DataFrame:
    """S3: as jsonl, without lines that a writer left torn."""
    full = f"{schema}, {schemas.CORRUPT} string"
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", schemas.CORRUPT).json(path)
    # a query on the corrupt column alone would need the whole row anyway
    return rows.filter(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT)


def json_document(spark: SparkSession, path, schema: str, field: str | None = None) -> DataFrame:
    """An array of records, or the array in one field of a wrapper object."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    wrapped = spark.read.schema(f"{field} array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return wrapped.select(F.explode(field).alias("r")).select("r.*")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def shards(spark: SparkSession, folder: str, schema: str, keep: str | None = None) -> DataFrame:
    """Gzipped line shards below a folder, and nothing else there. Gzip can't be split: keep names a Parquet folder
    that is written once and, once it is whole, read from then on."""
    read = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl.gz").option("recursiveFileLookup", True)
    if keep is None:
        return read.json(folder)
    made = spark._jvm.org.apache.hadoop.fs.Path
    system = made(keep).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(made(f"{keep}/_SUCCESS")):
        # absent, or left half-written: written anew under another name and moved when whole
        fresh = f"{keep.rstrip('/')}.{uuid.uuid4().hex}.tmp"
        read.json(folder).write.parquet(fresh)
        if not system.exists(made(f"{keep}/_SUCCESS")):
            # of two that write at once, the later one finds the cache whole and leaves it
            system.delete(made(keep), True)
            if not system.rename(made(fresh), made(keep)) and not system.exists(made(f"{keep}/_SUCCESS")):
                raise OSError(f"{fresh} can't be moved to {keep}")
        system.delete(made(fresh), True)
    return spark.read.schema(schema).parquet(keep)


def with_fallback(first: Callable[[], DataFrame], second: Callable[[], DataFrame]) -> DataFrame:
    """A source, or its mirror if the first isn't there."""
    try:
        out = first()
        out.schema
        return out
    except AnalysisException:
        return second()


def in_file_order(spark: SparkSession, path, schema: str) -> DataFrame:
    """Several files of records with `file` and `line` (0-based, blank lines not counted), to order by.

    A file may be read in many splits, by as many tasks. Records are counted by split where they are read, and sums over a
    file's splits say where each begins; only these counts (a row a split) are shuffled.
    """
    rows = spark.read.schema(schema).json(path)
    # a task reads a split from its beginning to its end, so numbers rise inside it, without gaps
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy(F.col("file").alias("_f"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a file's splits
    starts = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return placed.join(starts, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).withColumn("line", F.col("_at") + F.col("_off")).drop("_block", "_at", "_f", "_b", "_off")


def run_summaries(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """A row for each run and metric of summary documents; a run's name defaults to its file's."""
    rows = spark.read.schema(schemas.RUN_SUMMARY).option("multiLine", True).json(list(paths))
    named = rows.withColumn("name", F.coalesce("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")))
    return named.select("name", "embedder", "shuffle", "handling", "n", F.explode("metrics").alias("metric", "m")).select("name", "embedder", "shuffle", "handling", "n", "metric", "m.*")


def log_traces(spark: SparkSession, path) -> DataFrame:
    """The traces of whole logs, with their place in the file."""
    logs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return logs.select("file", F.posexplode(text.log_traces(F.col("value"))).alias("pos", "trace"))


def first_long_texts(df: DataFrame, column: str, key: str, n: int, least: int = 200) -> DataFrame:
    """The first n texts longer than `least`."""
    return df.filter(F.length(F.trim(column)) > least).orderBy(key).limit(n)


def balanced_corpus(df: DataFrame, label: str, key: str, per_class: int, seed=0, scan: int | None = None) -> DataFrame:
    """As many rows of each class, from the whole corpus or (a report on its head) its first `scan` rows."""
    if scan is not None:
        df = df.orderBy(key).limit(scan)
    return sampling.balanced_sample(df, label, key, per_class, seed)


def balanced_scan(read: Callable[[list[str]], DataFrame], shards: dict[str, str], label: str, classes: list, key: str, per_class: int, seed=0, most_rows: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """S6 with an early stop: as many rows of each of the classes from as few shards as that takes, and how many were read.

    shards: name to path. They are read in a seeded order of their names, in waves of 1, 2, 4, ... shards; after a wave the
    rows of each class are counted, and the scan stops once every class has enough (or `most_rows` were read). The sample is drawn from all
    shards of these waves by the key's draw, so it depends on names, seed and quota alone. A class with too few rows has all
    that there are; rows with a null label are of no class.
    """
    import hashlib

    order = sorted(shards, key=lambda n: hashlib.md5(f"{seed}|{n}".encode()).hexdigest())
    have, scanned, taken, wave = dict.fromkeys(classes, 0), 0, 0, 1
    while taken < len(order) and min(have.values()) < per_class and (most_rows is None or scanned < most_rows):
        some = order[taken : taken + wave]
        for r in read([shards[n] for n in some]).groupBy(label).count().collect():  # a row a class
            scanned += r["count"]
            if r[label] in have:
                have[r[label]] += r["count"]
        taken, wave = taken + len(some), wave * 2
    rows = read([shards[n] for n in order[:taken]]).filter(F.col(label).isin(classes))
    return sampling.balanced_sample(rows, label, key, per_class, seed), {"shards": len(order), "read": taken, "rows": scanned}


# --- problems and pools ----------------------------------------------------------------------

# Prompts of the tasks.
MCQ = "{question}\n\nThink step by step inside <think> </think> tags, then give the letter of the correct option (A, B, C, or D) inside \\boxed{{}}."
MATH = "{problem}\n\nThink step by step inside <think> </think> tags, then put your final answer inside \\boxed{{}}."


def _no_meta() -> Column:
    return F.lit(None).cast("struct<nums:array<int>,target:int,type:string,level:string>")


def choice_problems(df: DataFrame, question: str, right: str, wrong: list[str]) -> DataFrame:
    """Multiple choice. The order of the options depends on the problem's pid alone."""
    options = sampling.shuffled_options(F.array(F.col(right), *[F.col(w) for w in wrong]), F.col("pid"))
    body = F.concat(F.col(question), F.lit("\n\n"), text.choices(F.col("_o")))
    letter = F.char(F.array_position("_o", F.col(right)).cast("int") + 64)
    return df.withColumn("_o", options).select("pid", F.lit("gpqa").alias("task"), text.prompt(MCQ, question=body).alias("prompt"), letter.alias("answer"), _no_meta().alias("meta"))


def math_problems(df: DataFrame) -> DataFrame:
    """Problem, solution, type, level; rows whose solution has no box can't be graded and go."""
    boxed = df.withColumn("answer", grading.extract_boxed(F.col("solution"))).filter("answer IS NOT NULL")
    meta = F.struct(F.lit(None).cast("array<int>").alias("nums"), F.lit(None).cast("int").alias("target"), F.col("type"), F.col("level"))
    return boxed.select("pid", F.lit("math_hard").alias("task"), text.prompt(MATH, problem=F.col("problem")).alias("prompt"), "answer", meta.alias("meta"))


def countdown_problems(df: DataFrame) -> DataFrame:
    """Nums and target; the answer packs both."""
    meta = F.struct(F.col("nums").cast("array<int>").alias("nums"), F.col("target").cast("int").alias("target"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("level"))
    packed = F.concat(F.col("target").cast("string"), F.lit("|"), F.array_join(F.col("nums").cast("array<string>"), ","))
    filled = text.prompt(text.COUNTDOWN_PROMPT, numbers=text.number_list(F.col("nums")), target=F.col("target"))
    return df.select("pid", F.lit("countdown").alias("task"), filled.alias("prompt"), packed.alias("answer"), meta.alias("meta"))


def pool_rows(df: DataFrame, source: str, task: Column, answer: Column, subtask: Column | None = None, gradable: bool = True, options: Column | None = None) -> DataFrame:
    """Any benchmark in the pool's shape."""
    return df.select(
        F.concat(F.lit(f"{source}/"), F.col("pid").cast("string")).alias("pid"), F.lit(source).alias("source"), (F.lit(None).cast("string") if subtask is None else subtask).alias("subtask"),
        task.alias("task"), answer.alias("answer"), F.lit(gradable).alias("gradable"), (F.array().cast("array<string>") if options is None else options).alias("options"),
    )


def _placed(df: DataFrame, source: str, subtask: str) -> DataFrame:
    """pid becomes subtask/pid; in the pool it stands behind the source."""
    return df.withColumn("pid", F.concat_ws("/", F.col(subtask), F.col("pid").cast("string")))


def bbh_pool(df: DataFrame) -> DataFrame:
    """Pid, subtask, input, target: an answer in words."""
    return pool_rows(_placed(df, "bbh", "subtask"), "bbh", F.col("input"), F.col("target").cast("string"), F.col("subtask"))


def gpqa_pool(df: DataFrame, right: str = "right", wrong: tuple[str, ...] = ("wrong1", "wrong2", "wrong3")) -> DataFrame:
    """Pid, subtask, question, the right answer and three wrong ones: shown in an order that subtask and pid decide, the gold
    is the right one's letter."""
    tidy = [F.btrim(F.col(c).cast("string")) for c in (right, *wrong)]
    shown = sampling.shuffled_options(F.array(*tidy), F.col("subtask"), F.col("pid"))
    rows = df.withColumn("_o", shown).withColumn("_a", F.char(F.array_position("_o", tidy[0]).cast("int") + 64))
    return pool_rows(_placed(rows, "gpqa", "subtask"), "gpqa", _with_choices(F.btrim("question"), F.col("_o")), F.col("_a"), F.col("subtask"), options=F.col("_o"))


def math_hard_pool(df: DataFrame) -> DataFrame:
    """Pid, subtask, problem, solution: the gold is the solution's last box; without one a row goes."""
    rows = df.withColumn("_a", grading.extract_boxed(F.col("solution"))).filter("_a IS NOT NULL")
    return pool_rows(_placed(rows, "math_hard", "subtask"), "math_hard", F.col("problem"), F.col("_a"), F.col("subtask"))


def mmlu_pro_pool(df: DataFrame) -> DataFrame:
    """Pid, category ("mixed" if null), question, options, answer (a letter)."""
    return pool_rows(df, "mmlu_pro", _with_choices(F.col("question"), F.col("options")), F.btrim(F.col("answer").cast("string")), F.coalesce("category", F.lit("mixed")), options=F.col("options"))


def musr_pool(df: DataFrame) -> DataFrame:
    """Pid, subtask, narrative, question, choices, answer_index (from 0)."""
    task = F.concat(F.col("narrative"), F.lit("\n\n"), F.col("question"), F.lit("\n"), text.choices(F.col("choices")))
    return pool_rows(_placed(df, "musr", "subtask"), "musr", task, F.char(F.col("answer_index").cast("int") + 65), F.col("subtask"), options=F.col("choices"))


def ifeval_pool(df: DataFrame) -> DataFrame:
    """Pid, prompt: in the pool, but nothing to grade by."""
    return pool_rows(df, "ifeval", F.col("prompt"), F.lit(""), F.lit("instruction_following"), gradable=False)


def _with_choices(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), text.choices(options))


def pool(parts: list[DataFrame]) -> DataFrame:
    """U1"""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Claims with their verdicts; n caps a validation set at its first rows."""
    rows = df if n is None else df.orderBy(key).limit(n)
    return rows.withColumn("verdict", grading.recode_label(F.col("label")))
