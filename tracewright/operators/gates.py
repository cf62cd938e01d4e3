"""Data-quality gates (G1-G11): checks that raise, each on counts that the cluster made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate that data didn't pass."""


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of each side alone and of both, in one row."""
    a, b = (x.select(*keys).distinct().withColumn(f"_{s}", F.lit(1)) for x, s in ((left, "l"), (right, "r")))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("shared"),
    )


def same_keys(left: DataFrame, right: DataFrame, key: str | list[str]) -> None:
    """Both sides cover the same keys, and some (two empty sides are equal, too)."""
    r = key_differences(left, right, [key] if isinstance(key, str) else key).first()
    if not r["shared"] and not r["left_only"] and not r["right_only"]:
        raise GateError("both sides are empty")
    if r["left_only"] or r["right_only"]:
        raise GateError(f"{r['left_only']} keys are only on the left, {r['right_only']} only on the right")


def least_rate(df: DataFrame, by: str, flag: Column, least: float = 0.95, what: str = "rate") -> None:
    """G2, A31"""
    for r in df.groupBy(by).agg(F.avg(flag.cast("int")).alias("rate")).filter(F.coalesce("rate", F.lit(0.0)) < least).orderBy(by).limit(20).collect():
        raise GateError(f"{what} of {r[by]} is {r['rate']}, below {least}")


def solved(df: DataFrame, correct: Column, most_bad: float = 0.05) -> None:
    """Retained examples solve their problems."""
    bad = df.agg(F.avg(1 - F.coalesce(correct.cast("int"), F.lit(0)))).first()[0]
    if bad is None or bad > most_bad:
        raise GateError(f"share of examples that don't solve their problem: {bad}")


def curves_have_runs(curves: DataFrame, runs: DataFrame, key: str) -> None:
    """Every curve has a run with a checkpoint."""
    n = curves.join(runs.filter("has_checkpoint"), key, "left_anti").select(key).distinct().count()
    if n:
        raise GateError(f"{n} curves without a run")


def not_copied(values: DataFrame, column: str, reference: list[float], most: float = 0.25) -> None:
    """Measured points aren't the published ones."""
    from .stats import near_reference_share

    share = values.agg(near_reference_share(F.col(column), reference)).first()[0]
    if share is not None and share > most:
        raise GateError(f"{share:.0%} of the points equal the reference")


def enough(df: DataFrame, least: int = 1, what: str = "rows") -> int:
    """G8, G11"""
    n = df.count()
    if n < least:
        raise GateError(f"{n} {what}, {least} are needed")
    return n


def pool_total(df: DataFrame, total: int, allow_short: bool = False) -> int:
    """G9"""
    n = df.count()
    if n != total and not (allow_short and n < total):
        raise GateError(f"the pool has {n} rows, its plan {total}")
    return n


def without_baseline(df: DataFrame, task: str, baseline: Column) -> DataFrame:
    """Tasks that have no baseline rows (to report and skip)."""
    return df.groupBy(task).agg(F.count(F.when(baseline, 1)).alias("n")).filter("n = 0").select(task)


def report(left: DataFrame, right: DataFrame, keys: list[str], arms: DataFrame, arm: str, parsed: Column, least: float = 0.95) -> DataFrame:
    """G1, G2 as rows: gate, passed, value."""
    d = key_differences(left, right, keys)
    same = d.select(F.lit("same_keys").alias("gate"), ((F.col("left_only") + F.col("right_only") == 0) & (F.col("shared") > 0)).alias("passed"), (F.col("left_only") + F.col("right_only")).cast("double").alias("value"))
    rates = arms.groupBy(arm).agg(F.avg(parsed.cast("int")).alias("value")).select(F.concat(F.lit("parse_rate:"), F.col(arm)).alias("gate"), (F.col("value") >= least).alias("passed"), "value")
    return same.unionByName(rates)


def rates(arms: DataFrame, arm: str, flags: dict[str, Column], least: float = 0.95) -> DataFrame:
    """G2 as rows: of every arm each flag's rate (a null flag is a failure) and whether it suffices."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.coalesce(f.cast("int"), F.lit(0)).alias("v")) for n, f in flags.items()]))
    share = arms.select(F.col(arm).alias("_arm"), cells.alias("c")).groupBy("_arm", "c.n").agg(F.avg("c.v").alias("value"))
    return share.select(F.concat_ws(":", F.col("n"), F.col("_arm")).alias("gate"), (F.col("value") >= least).alias("passed"), "value")


def _gate(counted: DataFrame, name: str, passed: Column, value: Column) -> DataFrame:
    """One row (gate, passed, value) of a table of one row."""
    return counted.select(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))


def solved_row(df: DataFrame, correct: Column, most_bad: float = 0.05, name: str = "solved") -> DataFrame:
    """G4 as a row: the share of examples that don't solve their problem (a null is one); none at all don't pass."""
    bad = df.agg(F.avg(1 - F.coalesce(correct.cast("int"), F.lit(0))).alias("v"))
    return _gate(bad, name, F.col("v") <= most_bad, F.col("v"))


def curves_row(curves: DataFrame, runs: DataFrame, key: str, name: str = "curves_have_runs") -> DataFrame:
    """G5 as a row: how many curves have no run with a checkpoint."""
    n = curves.join(runs.filter("has_checkpoint"), key, "left_anti").select(key).distinct().agg(F.count("*").alias("v"))
    return _gate(n, name, F.col("v") == 0, F.col("v"))


def enough_row(df: DataFrame, least: int = 1, name: str = "enough") -> DataFrame:
    """G8, G11 as a row: how many rows there are."""
    return _gate(df.agg(F.count("*").alias("v")), name, F.col("v") >= least, F.col("v"))


def total_row(df: DataFrame, total: int, allow_short: bool = False, name: str = "pool_total") -> DataFrame:
    """G9 as a row: how many rows the pool has."""
    n = df.agg(F.count("*").alias("v"))
    return _gate(n, name, (F.col("v") == total) | (F.lit(allow_short) & (F.col("v") < total)), F.col("v"))


def failing(gate_rows: DataFrame, most: int = 20) -> None:
    """Raises with the gates of a report that didn't pass."""
    bad = gate_rows.filter(~F.col("passed")).orderBy("gate").limit(most).collect()
    if bad:
        raise GateError("; ".join(f"{r['gate']}: {r['value']}" for r in bad))


def disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    """Two slices share no key; returns how many keys they have together."""
    r = key_differences(left, right, keys).first()
    if r["shared"]:
        raise GateError(f"{r['shared']} keys are in both slices")
    return r["left_only"] + r["right_only"]


# --- training configuration (F43) -----------------------------------------------------------

LEAST_PROMPTS, LEAST_GENERATIONS = 2, 2


def prompts_per_step(batch_size: int, grad_accum: int, num_generations: int) -> int:
    """Distinct prompts of an optimiser step; batch_size counts completions."""
    if num_generations <= 0:
        raise ValueError("num_generations is positive")
    return batch_size * grad_accum // num_generations


def training_config(batch_size: int, grad_accum: int, num_generations: int, lr: float | None = None) -> int:
    """raises for a configuration that would compare attempts at one prompt only, or a learning rate out of range."""
    if num_generations < LEAST_GENERATIONS:
        raise ValueError(f"num_generations is {num_generations}; a group needs {LEAST_GENERATIONS}: raise num_generations")
    if batch_size * grad_accum % num_generations:
        raise ValueError("batch_size x grad_accum isn't a multiple of num_generations: change one of them")
    n = prompts_per_step(batch_size, grad_accum, num_generations)
    if n < LEAST_PROMPTS:
        raise ValueError(f"{n} prompts a step; {LEAST_PROMPTS} are needed: raise grad_accum or batch_size, or lower num_generations")
    if lr is not None and not 1e-8 < lr < 1e-2:
        raise ValueError(f"learning rate {lr} is not between 1e-8 and 1e-2")
    return n


def config_findings(batch_size: Column, grad_accum: Column, num_generations: Column, lr: Column | None = None) -> Column:
    """F43 on a table of configurations: prompts of a step, and what is wrong (null: nothing), the first of training_config's rules that
    a configuration breaks. A null number is out of range."""
    n, total = F.coalesce(num_generations, F.lit(0)).cast("long"), F.coalesce(batch_size * grad_accum, F.lit(0)).cast("long")
    prompts = F.when(n > 0, F.floor(total / n)).cast("long")
    wrong = F.when(n < LEAST_GENERATIONS, "num_generations is too small").when(total % F.greatest(n, F.lit(1)) != 0, "no multiple of num_generations").when(prompts < LEAST_PROMPTS, "too few prompts a step")
    if lr is not None:
        wrong = wrong.when(~F.coalesce((lr > 1e-8) & (lr < 1e-2), F.lit(False)), "learning rate out of range")
    return F.struct(prompts.alias("prompts"), wrong.alias("wrong"))
