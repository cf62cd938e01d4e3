"""The corpus pipeline: documents to token records, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and hands it on, read again. All but the last return the columns of documents.

Cases. Null texts count as empty; null ids are kept by the filters (of near copies, rows with an id stay
first) and come first in the records; repeated rows are near copies of each other; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, mixing, quality, simhash, token_records
from tracewright.llm.batches import free_name
from tracewright.llm.common import release, run_folders, stage, words_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field takes for good."""
    field = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "quality")
    return quality.scored(docs, field, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, a null one last."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them."""
    return mixing.repeated(docs, words_of(F.col("text")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token records, read back."""
    return token_records.encode_and_read(docs, token_records.default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]

#: The stages learn, hash and encode: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with run_folders() as own:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        # the stage is written: what it staged, and what it read, have served
        release(spark, before + own[:-1])
        before = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
