"""Statistics of conditions and classes (A1-A14, A16-A29, A32, A34, W1-W4). Estimates that too few rows carry are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import order_stats, sampling

Z = 1.96


def rate(flag: Column) -> Column:
    """A2: share of true; null without rows."""
    return F.avg(flag.cast("int"))


def steady_mean(value: Column) -> Column:
    """The mean as it is in whatever order rows come, so that groups of equal values tie: values are summed exactly, to 18 places. Where
    these can't hold them (values of 1e20 or more or not finite, or none as large as 1e-3) the plain mean."""
    v = value.cast("double")
    places = v.try_cast("decimal(38,18)")
    held = (F.count(places) == F.count(v)) & (F.max(F.abs(v)) >= 1e-3)
    return F.coalesce(F.when(held, F.try_sum(places).cast("double") / F.count(v)), F.avg(v))


def two_level_mean(df: DataFrame, cell: list[str], unit: str, value: Column) -> DataFrame:
    """A1: the mean over units of each unit's mean."""
    return df.groupBy(*cell, unit).agg(F.avg(value).alias("unit_mean")).groupBy(*cell).agg(F.avg("unit_mean").alias("mean"), F.count("*").alias("units"))


def welch(df: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """Difference of the flagged rows' mean from the others', with a normal interval. Null below two rows a side."""
    pick = lambda f, side: f(F.when(F.col(flag) == F.lit(side), F.col(value)))
    sides = df.groupBy(*by).agg(
        pick(F.count, True).alias("n_correct"), pick(F.count, False).alias("n_incorrect"),
        pick(F.avg, True).alias("correct_mean"), pick(F.avg, False).alias("incorrect_mean"),
        pick(F.var_samp, True).alias("_vc"), pick(F.var_samp, False).alias("_vi"),
    )
    enough = (F.col("n_correct") >= 2) & (F.col("n_incorrect") >= 2)
    se = F.sqrt(F.col("_vc") / F.col("n_correct") + F.col("_vi") / F.col("n_incorrect"))
    return (
        sides.withColumn("difference", F.when(enough, F.col("correct_mean") - F.col("incorrect_mean")))
        .withColumn("se", F.when(enough, se))
        .withColumn("ci95_low", F.col("difference") - Z * F.col("se"))
        .withColumn("ci95_high", F.col("difference") + Z * F.col("se"))
        .withColumn("ci_excludes_zero", (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0))
        .drop("_vc", "_vi")
    )


def unpivoted(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric."""
    return df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keep, metrics, "metric", "value")


def paired_ci(value: str) -> list[Column]:
    """Mean, half width and count of paired differences."""
    n = F.count(value)
    return [n.alias("n_pairs"), F.avg(value).alias("difference"), (Z * F.stddev_samp(value) / F.sqrt(F.greatest(n, F.lit(1)))).alias("half_width")]


def within_group_paired(df: DataFrame, group: str, flag: str, value: str, least: int = 30) -> DataFrame:
    """Differences of class means inside groups that have both classes; each group counts once."""
    sides = df.groupBy(group).agg(
        F.avg(F.when(F.col(flag), F.col(value))).alias("_yes"), F.avg(F.when(~F.col(flag), F.col(value))).alias("_no")
    )
    both = F.col("_yes").isNotNull() & F.col("_no").isNotNull()
    out = sides.withColumn("_d", F.when(both, F.col("_yes") - F.col("_no"))).agg(
        F.count("_d").alias("n_groups"),
        F.count(F.when(F.col("_yes").isNotNull() & F.col("_no").isNull(), 1)).alias("all_correct"),
        F.count(F.when(F.col("_yes").isNull() & F.col("_no").isNotNull(), 1)).alias("all_incorrect"),
        F.avg("_d").alias("_mean"),
        (Z * F.stddev_samp("_d") / F.sqrt(F.greatest(F.count("_d"), F.lit(1)))).alias("_half"),
    )
    enough = F.col("n_groups") >= max(least, 2)
    return out.select(
        "n_groups", "all_correct", "all_incorrect",
        F.when(enough, F.col("_mean")).alias("difference"),
        F.when(enough, F.col("_mean") - F.col("_half")).alias("ci95_low"),
        F.when(enough, F.col("_mean") + F.col("_half")).alias("ci95_high"),
    )


def quantile_strata(df: DataFrame, length: str, bins: int = 8) -> DataFrame:
    """Df with the number of its bin between exact quantiles of `length` (lo <= x < hi, the last open). Repeated
    edges leave empty bins."""
    edges = order_stats.quantiles(df, [], length, [i / bins for i in range(bins)]).withColumnRenamed("quantiles", "_edges")  # one row
    bin_of = F.greatest(F.size(F.filter("_edges", lambda e: e <= F.col(length))) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", bin_of).drop("_edges")


def stratified(df: DataFrame, flag: str, value: str, length: str, bins: int = 8, least: int = 30) -> DataFrame:
    """A10: the class difference in each length bin; bins with fewer than `least` rows of a class aren't usable."""
    out = welch(quantile_strata(df, length, bins), ["bin"], flag, value)
    usable = (F.col("n_correct") >= least) & (F.col("n_incorrect") >= least)
    return out.select("bin", "n_correct", "n_incorrect", F.when(usable, F.col("difference")).alias("difference"), F.when(usable, F.col("se")).alias("se"), usable.alias("usable"))


def fixed_effects(strata: DataFrame) -> DataFrame:
    """The usable strata's differences, weighted by inverse variance."""
    w = 1 / F.greatest(F.col("se") * F.col("se"), F.lit(1e-12))
    pooled = strata.filter("usable").agg(F.sum(w).alias("_w"), (F.sum(w * F.col("difference")) / F.sum(w)).alias("difference"), F.count("*").alias("n_strata"))
    se = F.sqrt(1 / F.col("_w"))
    return pooled.select("n_strata", "difference", (F.col("difference") - Z * se).alias("ci95_low"), (F.col("difference") + Z * se).alias("ci95_high"))


def shrinkage(adjusted: Column, unadjusted: Column) -> Column:
    """the part of an effect that an adjustment removes."""
    return 1 - F.abs(adjusted) / F.greatest(F.abs(unadjusted), F.lit(1e-12))


def verdict_of_ci(low: Column, high: Column, more: str = "more", less: str = "less", none: str = "no difference") -> Column:
    """F40"""
    return F.when(low > 0, more).when(high < 0, less).otherwise(none)


def sign_stability(runs: DataFrame, handling: str = "zero") -> DataFrame:
    """Over the runs of one handling whose interval excludes zero, whether each metric keeps its sign."""
    sign = F.when(F.col("ci_excludes_zero") & (F.col("handling") == handling), F.when(F.col("difference") > 0, 1).otherwise(-1))
    out = runs.groupBy("metric").agg(F.count(sign).alias("n_runs"), F.min(sign).alias("_lo"), F.max(sign).alias("_hi"))
    verdict = (
        F.when(F.col("n_runs") == 0, "none").when(F.col("n_runs") == 1, "single")
        .when(F.col("_lo") != F.col("_hi"), "unstable").when(F.col("_lo") > 0, "stable_more").otherwise("stable_less")
    )
    return out.select("metric", "n_runs", verdict.alias("verdict"))


def upper_median(value: Column) -> Column:
    """A24 as an aggregate, for groups of bounded size, which it collects; order_stats.upper_medians is for any."""
    values = F.array_sort(F.collect_list(value))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def length_stats(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Of each group count, medians (cut to integers) of characters and words, the longest, and the upper median of words.
    Texts are read once."""
    from ..functions.text import word_count

    sizes = scratch.stage(df.select(*by, F.length(text).alias("chars"), word_count(F.col(text)).cast("int").alias("words")), "lengths")
    out = sizes.groupBy(*by).agg(F.count("*").alias("n"), F.max("chars").alias("max_chars"))
    each = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in ("chars", "words")])).alias("x")).select(*by, "x.m", "x.v")
    # both ends of the middle: the upper one is the upper median
    middle = lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2))
    ends = order_stats.order_statistics(each, [*by, "m"], "v", middle)
    pick = lambda m, r: F.max(F.when((F.col("m") == m) & (F.col("rank") == r), F.col("value")))  # noqa: E731  one row each
    half = lambda m: ((pick(m, 0) + pick(m, 1)) / 2).cast("int").alias(f"median_{m}")
    found = ends.groupBy(*by).agg(half("chars"), half("words"), pick("words", 1).alias("upper_median_words"))
    return order_stats._beside(out, found, by).select(*by, "n", "median_chars", "median_words", "max_chars", "upper_median_words")


def population_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation and three percentiles of each group."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    tail = F.col("quantiles")
    found = order_stats.quantiles(df, by, value, [0.05, 0.5, 0.95])
    return order_stats._beside(out, found, by).select(*by, "mean", "std", tail[0].alias("p05"), tail[1].alias("p50"), tail[2].alias("p95"))


def percentile_position(population: Column, anchor: Column) -> Column:
    """Percentage of the population strictly below the anchor."""
    return F.avg((population < anchor).cast("int")) * 100


def variance_cutoff(df: DataFrame, by: list[str], value: str, share: float = 0.99) -> DataFrame:
    """How many of the largest squared values it takes to explain the share, values taken from the greatest down.

    Rows are counted by group and value where they are read, the distinct values are dealt into ranges, and the ranges' sums give
    each its offset: a group may span any number of tasks. Null values are left out; a group without a sum has 1, as one with NaN.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v.alias("_v")).agg(F.count("*").alias("_n"))
    placed = sampling.ranges(counts, [*keys, F.desc("_v")]).withColumn("_s", F.col("_v") * F.col("_v"))
    mass, group, zero = F.sum(F.col("_s") * F.col("_n")), Window.partitionBy(*keys), F.lit(0.0)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of a group, as many rows as ranges
    pieces = placed.groupBy("_range", *keys).agg(mass.alias("_m")).withColumn("_below", F.coalesce(F.sum("_m").over(earlier), zero)).withColumn("_all", F.sum("_m").over(group))
    inside = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_local", F.coalesce(mass.over(inside), zero))
    left = F.lit(share) * F.col("_all") - F.col("_below") - F.col("_local")
    # equal values are one row: how many of them stay below the share
    taken = F.when(F.isnan("_all") | (left <= 0), 0).when(F.col("_s") == 0, F.col("_n")).otherwise(F.greatest(F.lit(0), F.least(F.col("_n"), F.ceil(left / F.col("_s")) - 1)))
    below = order_stats._beside(run, pieces.drop("_m"), ["_range", *keys]).groupBy(*keys).agg(F.sum(taken).alias("_k"))
    groups = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    named = below.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "_k")
    return order_stats._beside(groups, named, by).select(*by, (F.coalesce("_k", F.lit(0)) + 1).alias("k"))


def explained_variance(x: str, approx: str, mean: str) -> Column:
    """1 - residual / total, from arrays."""
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.sum(gap(x, approx)) / F.sum(gap(x, mean))


def near_reference_share(value: Column, reference: list[float], within: float = 0.005) -> Column:
    """Share of points within a distance of any reference value."""
    return F.avg(F.exists(F.array(*[F.lit(float(r)) for r in reference]), lambda r: F.abs(r - value) <= within).cast("int"))


def curve_windows(df: DataFrame, step: Column, windows: dict[str, tuple[int, int]], curve: str, value: str, first, second) -> DataFrame:
    """The means of two curves in each window of steps (both ends in it) and their gap. A window without points of either has
    no row; windows that overlap count a point in each."""
    parts = F.array(*[F.when(step.between(a, b), F.lit(n)) for n, (a, b) in windows.items()])
    side = lambda c: F.avg(F.when(F.col(curve) == c, F.col(value)))
    some = df.filter(F.col(curve).isin(first, second)).select(curve, value, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("part"))
    return some.groupBy("part").agg(side(first).alias("first"), side(second).alias("second"), (side(first) - side(second)).alias("gap"))
