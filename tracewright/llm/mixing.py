"""Mixing sources to target weights by capped water-filling.

Every source has a weight and at most `max_epochs` times its own size. Sources whose share
exceeds that are clamped there and the excess goes to the others by weight, until none is above.
A source then takes whole repetitions of all its documents, and for the fraction left the first
documents in a seeded order until their words reach it.

Cases. A source at its cap takes no fraction, so no row, be it without words, is taken more than `max_epochs` times; a null text has size 0; a null source is a source of its own, the last; null ids sort
first; repeated rows are documents of their own; an empty table or one without words gives
targets of 0; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import free_name
from .common import numbered, running_sum, stage, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-17"


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for (source_key, source_size) rows; the keys' order deals the weights in turn.

    The rows stay a DataFrame; each round brings one row of sums to the driver, and a round clamps
    at least one source more.
    """
    ranked = numbered(totals, ["source_key"], "mix-sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = stage(
        ranked.withColumn("weight", F.element_at(cycle, (F.pmod("pos", F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .select("source_key", "source_size", "weight", "cap"),
        "mix-weights",
    )
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], (row["all"] - row["held"]) / row["free"]
    level = 0.0 if level is None else level
    share = F.col("weight") * F.lit(float(level))
    return ranked.select(
        "source_key",
        "source_size",
        F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def mix(documents: DataFrame, size, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source_key, size, source_size, target and copies (how often the mix repeats the row), and the columns
    `ties`, which order rows that share id and size."""
    keyed = documents.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
        size.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"),
        *ties,
    )
    placed = stage(running_sum(keyed, "source_key", ["draw", "doc_id", "size", *ties], "size", "mix-order"), "mix-before")
    totals = placed.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        placed.join(targets, "source_key")
        .withColumn("_whole", whole)
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn(
            "copies",
            F.col("_whole") + F.when((F.col("_whole") < max_epochs) & (F.col("before") + F.col("size") / F.lit(2.0) <= F.col("_rest")), 1).otherwise(0),
        )
        .select("doc_id", "source_key", "size", "source_size", "target", "copies", *ties)
    )


def repeated(documents: DataFrame, size, **how) -> DataFrame:
    """documents with every row as often as the mix takes it (its own columns alone).

    Every row has a number of its own, so rows that share id, size or everything else are taken each on its own;
    which of them come first depends on their texts.
    """
    columns = documents.columns
    spot, number = free_name(documents, "_spot"), free_name(documents, "_number")
    rows = stage(documents.withColumn(spot, F.xxhash64("text")).withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    times, again = free_name(documents, "_times"), free_name(documents, "_again")
    taken = mix(rows, size, ties=(spot, number), **how).filter("copies > 0").select(number, F.col("copies").cast("long").alias(times))
    met = rows.join(taken, number).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return met.select(*columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, words_of(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
w AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS INT)] AS weight
  FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, no_source, source) AS k FROM w),
p AS (
  SELECT *, CAST((SELECT sum(source_size) FROM o) AS BIGINT)
            - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM o),
l AS (
  SELECT CAST(rest AS DOUBLE) / free AS level FROM p
  WHERE (CAST(rest AS DOUBLE) / free) * weight <= cap ORDER BY k LIMIT 1),
t AS (
  SELECT no_source, source, source_size,
         CASE WHEN weight * level > cap THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target
  FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (
           PARTITION BY d.no_source, d.source
           ORDER BY md5('mix-17|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (no_source, source))
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
