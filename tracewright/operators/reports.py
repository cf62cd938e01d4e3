"""Full summaries, keys, ranks and run states (A3, A4, A8, A13, A25, A30, K8, O1-O3, P7, P12, P13, T-6, W2, W6).

Cases. Empty tables give no rows (one row of nulls where there is no key). Null flags count as neither side, null measures
leave the means; ties go by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

MEASURES = ("hse_norm", "mean_dist", "hse", "n_segments", "words")


def ordered_cells(df: DataFrame, cell: list[str], order: list[str], unit: str, value: Column) -> DataFrame:
    """A3, O1: the two-level mean of every cell, in the order of several keys."""
    return stats.two_level_mean(df, cell, unit, value).orderBy(*order)


def normal_alpha(feature: Column, alpha: Column) -> Column:
    """Rows without a steered feature (-1) have dose 0."""
    return F.when(feature == -1, F.lit(0.0)).otherwise(alpha.cast("double"))


def summary_by_dose(df: DataFrame, alpha: str) -> DataFrame:
    """A4: of every dose n, single voices and the means of words, segments, diversity, distance and correctness."""
    mean = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    return df.groupBy(alpha).agg(
        F.count("*").alias("n"), F.count_if("single_voice").alias("single_voice"), mean("words", "words"), mean("n_segments", "segments"),
        mean("hse_norm", "hse_norm"), mean("mean_dist", "mean_dist"), stats.rate(F.col("correct")).alias("accuracy"),
    )


def metric_report(df: DataFrame, flag: str, metrics: tuple[str, ...] = MEASURES) -> DataFrame:
    """The class difference of every measure."""
    return stats.welch(stats.unpivoted(df, [flag], list(metrics)), ["metric"], flag, "value")


def dropped_by_class(df: DataFrame, flag: str, single: Column, value: Column) -> DataFrame:
    """Single voices of each class, and traces of several voices whose measure is null or not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return df.groupBy(flag).agg(F.count("*").alias("n"), F.count_if(single).alias("single_voice"), F.count_if(~single & ~finite).alias("degenerate"))


def change_of_bins(bins: DataFrame, measures: list[str]) -> DataFrame:
    """A row a measure with its early and late mean, their difference, and that over the early one (null at 0)."""
    long = bins.select("bin", *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(["bin"], measures, "measure", "value")
    side = lambda b: F.max(F.when(F.col("bin") == b, F.col("value"))).alias(b)  # noqa: E731  one row a bin
    delta = F.col("late") - F.col("early")
    return long.groupBy("measure").agg(side("early"), side("late")).select("measure", "early", "late", delta.alias("delta"), F.try_divide(delta, F.col("early")).alias("change"))


def component_means(df: DataFrame, batch: str, accuracy: Column, layout: Column) -> DataFrame:
    """A batch's mean accuracy and format reward, and the mean of their weighted sum."""
    a, f = accuracy.cast("double"), layout.cast("double")
    return df.groupBy(batch).agg(F.avg(a).alias("accuracy"), F.avg(f).alias("format"), F.avg(0.9 * a + 0.1 * f).alias("reward"))


def gradable_rows(pool: DataFrame, source: str | None = None, math: str = "math_hard") -> DataFrame:
    """Rows of the pool that can be graded and aren't mathematics, of one source if it is named."""
    rows = pool.filter(F.col("gradable") & (F.col("source") != math))
    return rows if source is None else rows.filter(F.col("source") == source)


def problem_key(numbers: Column, target: Column) -> Column:
    """A number puzzle's key: its numbers in order, repeats kept, and its target."""
    return F.struct(F.array_sort(numbers).alias("numbers"), target.alias("target"))


def anchor_and_top(scored: DataFrame, key: str, score: str, anchor, n: int) -> DataFrame:
    """O2: the anchor, and beside it the n best other rows (a top-n, no full sort). Without an anchor the n rows alone."""
    first = scored.filter(F.col(key) == anchor).withColumn("role", F.lit("anchor"))
    rest = scored.filter(F.col(key) != anchor).orderBy(F.desc(score), key).limit(n).withColumn("role", F.lit("candidate"))
    return first.unionByName(rest)


def largest_shifts(df: DataFrame, layer: str, value: str, n: int = 6) -> DataFrame:
    """The n layers with the largest absolute mean shift, with their place. The window runs over n rows."""
    means = df.groupBy(layer).agg(stats.steady_mean(F.col(value)).alias("shift"))
    top = means.orderBy(F.desc(F.abs("shift")), layer).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("shift")), layer)))


def intervals(bounds: Column) -> Column:
    """From each bound to the next; of fewer than two bounds, none."""
    ends = F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0)))
    starts = F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(0)))
    return F.arrays_zip(starts.alias("start"), ends.alias("stop"))


def report_lines(df: DataFrame, fields: list[tuple[str, int, str | None]]) -> DataFrame:
    """K8: rows as lines of a table of fixed width. A field is (column, width, number format): with a format it stands on
    the right, without on the left; null is a dash; what is wider widens its line, so that no number loses digits."""

    def cell(name: str, width: int, form: str | None) -> Column:
        body = F.col(name).cast("string") if form is None else F.when(F.col(name).isNotNull(), F.format_string(form, F.col(name)))
        body = F.coalesce(body, F.lit("-"))
        wide = F.greatest(F.lit(width), F.length(body))
        return F.rpad(body, wide, F.lit(" ")) if form is None else F.lpad(body, wide, F.lit(" "))

    return df.select(F.concat(*[cell(*f) for f in fields]).alias("line"))


# What a training log says at its end, of a validation and of a step.
END_MARK = "Final validation metrics"
VALIDATION = r"step:(\d+) - .*val/test_score"
STEP = r"step:(\d+) - global_seqlen"


def run_states(lines: DataFrame, run: str, at: str, line: str, now: Column, steps: int = 250, idle_seconds: int = 5400) -> DataFrame:
    """T-6: "done" by any of three signals (the end's mark, a validation at the last step or beyond, a training step at the
    last but one or beyond), else "stalled" if the newest line is as old as the idle time or older, else "running"."""
    number = lambda pattern: F.regexp_extract(line, pattern, 1).try_cast("bigint")
    seen = lines.groupBy(run).agg(
        F.max(F.col(line).contains(END_MARK)).alias("_end"), F.max(number(VALIDATION)).alias("_val"), F.max(number(STEP)).alias("_step"), F.max(at).alias("_last")
    )
    done = F.coalesce("_end", F.lit(False)) | (F.coalesce("_val", F.lit(0)) >= steps) | (F.coalesce("_step", F.lit(0)) >= steps - 1)
    old = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("_last"), F.lit(idle_seconds)) >= idle_seconds
    return seen.select(run, F.when(done, "done").when(old, "stalled").otherwise("running").alias("state"))
