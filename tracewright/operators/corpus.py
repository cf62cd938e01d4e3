"""Feature tables, pairs of arms and training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grading, text
from . import gates, sampling, stats


def features_with_explanations(features: DataFrame, explanations: DataFrame, order: str) -> DataFrame:
    """Features and, where there is one, the last explanation of each."""
    last = explanations.groupBy("index").agg(F.max_by(F.struct("description", "embedding"), order).alias("_e"))
    return features.join(last, "index", "left").select(*features.columns, F.col("_e.description").alias("description"), F.col("_e.embedding").alias("embedding"))


def calibrated(features: DataFrame, calibration: DataFrame) -> DataFrame:
    """A calibration's arrays laid over features by index; beyond its length features keep theirs."""
    cells = calibration.select(F.posexplode(F.arrays_zip("max_act", "frac_nonzero")).alias("index", "_c"))
    return features.join(cells, "index", "left").withColumn("max_act", F.coalesce("_c.max_act", "max_act")).withColumn("frac_nonzero", F.coalesce("_c.frac_nonzero", "frac_nonzero")).drop("_c")


def not_done(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The plan without finished work; null keys are keys, and doubles count to six places."""
    kind = dict(plan.dtypes)
    norm = lambda df, c: F.round(df[c], 6) if kind[c] in ("double", "float") else df[c]
    have = done.select(*[norm(done, k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
    same = None
    for i, k in enumerate(keys):
        c = norm(plan, k).eqNullSafe(have[f"_{i}"])
        same = c if same is None else same & c
    return plan.join(have, same, "left_anti")


def grid(problems: DataFrame, samples: int, conditions: DataFrame) -> DataFrame:
    """Every problem under every condition, sample by sample. The conditions are a plan's few rows."""
    return problems.crossJoin(F.broadcast(conditions)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def pair_arms(dialogue: DataFrame, monologue: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Rows that both arms have, filtered."""
    both = dialogue.join(monologue, key)
    return both if keep is None else both.filter(keep)


def pair_arms_checked(dialogue: DataFrame, monologue: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """J3 with G8: no pair is an error."""
    out = pair_arms(dialogue, monologue, key, keep)
    gates.enough(out.limit(1), 1, "pairs")
    return out


def rejection_reason(dialogue: Column, monologue: Column, gold: Column, options: Column) -> Column:
    """Why a pair is dropped (the first reason that holds), or "kept"."""
    da, ma = text.dialogue_answer(dialogue), text.monologue_answer(monologue)
    dok, mok = grading.is_correct(da, gold, options), grading.is_correct(ma, gold, options)
    return (
        F.when(~text.well_formed_dialogue(dialogue), "bad_dialogue_tags").when(da.isNull(), "no_dialogue_answer").when(ma.isNull(), "no_monologue_answer")
        .when(~dok & ~mok, "both_wrong").when(~mok, "monologue_wrong").when(~dok, "dialogue_wrong").otherwise("kept")
    )


def kept_traces(df: DataFrame, drop_truncated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Traces that are whole and not empty, and one row with how many were dropped for which reason."""
    cut = F.coalesce(F.col("truncated"), F.lit(False)) & F.lit(drop_truncated)
    empty = F.length(F.trim(F.coalesce("response", F.lit("")))) == 0
    counts = df.agg(F.count(F.when(cut, 1)).alias("truncated"), F.count(F.when(~cut & empty, 1)).alias("empty"), F.count(F.when(~cut & ~empty, 1)).alias("kept"))
    return df.filter(~cut & ~empty), counts


def accuracy_by_source(df: DataFrame, source: str, correct: Column, truncated: Column) -> DataFrame:
    """Overall and among finished traces, to three places."""
    done = ~truncated
    part = lambda n, d: F.round(F.count(F.when(n, 1)) / F.greatest(F.count(F.when(d, 1)), F.lit(1)), 3)
    return df.groupBy(source).agg(F.count("*").alias("n"), part(correct, F.lit(True)).alias("accuracy"), part(correct & done, done).alias("finished_accuracy"), part(truncated, F.lit(True)).alias("truncated_share"))


def marker_means(df: DataFrame, markers: str, steered: Column) -> DataFrame:
    """Means of every marker with and without steering, and the direction."""
    rows = df.select(steered.alias("_s"), F.explode(markers).alias("marker", "n"))
    out = rows.groupBy("marker").agg(F.avg(F.when(~F.col("_s"), F.col("n"))).alias("baseline"), F.avg(F.when(F.col("_s"), F.col("n"))).alias("steered"))
    way = F.when(F.col("steered") > F.col("baseline"), "up").when(F.col("steered") < F.col("baseline"), "down").otherwise("flat")
    return out.withColumn("direction", way)


def early_late(df: DataFrame, order: str, size: int, value: Column, kept: Column, measures: dict[str, Column] | None = None) -> DataFrame:
    """The first and last `size` rows (a third of the rows, if they are fewer than twice that): means of value
    over all of them, and of kept rows' measures."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    width = F.when(F.col("_n") < 2 * size, F.expr("_n div 3")).otherwise(F.lit(size))
    placed = sampling.positions(df, order).crossJoin(n)
    bin_ = F.when(F.col("pos") < width, "early").when(F.col("pos") >= F.col("_n") - width, "late")
    return placed.withColumn("bin", bin_).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("rows"), F.avg(value).alias("rate"), F.count(F.when(kept, 1)).alias("kept"), *[F.avg(F.when(kept, m)).alias(name) for name, m in (measures or {}).items()])


def activation_summary(df: DataFrame, index: str, value: str) -> DataFrame:
    """A27"""
    return df.groupBy(index).agg(F.max(value).alias("max_act"), F.avg((F.col(value) > 0).cast("int")).alias("frac_nonzero"))


def layer_rank(df: DataFrame, layer: str, value: str, shown: Callable[[Column], Column] = stats.steady_mean) -> DataFrame:
    """Layers by falling mean change, ties by layer. Places go by steady means, also where `shown` makes the mean that is
    returned. The window runs over the layers' means, not over rows."""
    means = df.groupBy(layer).agg(shown(F.col(value)).alias("mean_change"), stats.steady_mean(F.col(value)).alias("_steady"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_steady"), layer))).drop("_steady")


def argmax(df: DataFrame, by: list[str], what: str, score: str) -> DataFrame:
    """O17; of equal scores the least `what` counts, and none that is null."""
    least = df.groupBy(*by, score).agg(F.min(what).alias(what))
    return least.groupBy(*by).agg(F.max_by(what, F.when(F.col(what).isNotNull(), F.col(score))).alias(what), F.max(score).alias(score))


def alignment(basis: Column, direction: Column) -> Column:
    """length of a unit direction's projection on orthonormal rows."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(direction, direction))
    parts = F.transform(basis, lambda row: dot(row, direction) / size)
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v))


def jump_relu(z: Column, threshold: Column, log_threshold: bool = False) -> Column:
    """F46"""
    return F.zip_with(z, threshold, lambda x, t: F.when(x > (F.exp(t) if log_threshold else t), x).otherwise(0.0))


def steering_vector(direction: Column, strength: Column, scale: float = 1.0) -> Column:
    """F47"""
    return F.transform(direction, lambda x: x * strength * scale)


def sft_rows(paired: DataFrame, arm: str, prompt: Column, one_block: bool = False) -> DataFrame:
    """Training rows of one arm; a dialogue can be collapsed into one block first."""
    body = text.one_think_block(F.col(arm)) if one_block else F.col(arm)
    return paired.select("pid", "source", prompt.alias("prompt"), text.response_target(body).alias("response"))


def claim_rows(claims: DataFrame, prompt: Column, split: str, index: str) -> DataFrame:
    """Rule-graded rows of claims with verdicts."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    model = F.struct(F.lit("rule").alias("style"), F.create_map(F.lit("verdict"), F.col("verdict")).alias("ground_truth"))
    extra = F.struct(F.lit(split).alias("split"), F.col(index).cast("bigint").alias("index"), F.col("label").cast("int").alias("raw_label"))
    return claims.select(F.lit("claims").alias("data_source"), message.alias("prompt"), F.lit("fact-checking").alias("ability"), model.alias("reward_model"), extra.alias("extra_info"))
