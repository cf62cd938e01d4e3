"""Exact order statistics of any number of groups, by selection on the cluster.

Rows are counted by group and value where they are read; the distinct values are dealt into ranges. A range's count in a
group is a coarse bin: sums over the bins before tell which one holds a rank, and only in such a bin are values counted
through. No task sees a group whole, so one group may hold all rows, and no group's values are gathered.

Cases. Null values are left out; a group without values gives null; NaN is the largest value; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling


def order_statistics(df: DataFrame, by: list[str], value: str, ranks) -> DataFrame:
    """by, rank (its index in the list) and the value at each of the 0-based ranks that ranks(n) names (an array column,
    from the group's number of values). A rank out of range has no row."""
    keys = [f"_g{i}" for i in range(len(by))]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = sampling.ranges(counts, [*keys, "_v"])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of a group, as many rows as ranges
    bins = placed.groupBy("_range", *keys).agg(F.sum("_n").alias("_m")).withColumn("_below", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_all", F.sum("_m").over(group))
    asked = bins.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"{k}_") for k in keys], "_m", "_below", F.posexplode(ranks(F.col("_all"))).alias("rank", "_k"))
    asked = asked.withColumn("_k", F.col("_k") - F.col("_below")).filter("_k >= 0 AND _k < _m")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    through = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = placed.join(asked, same, "left_semi").withColumn("_upto", F.sum("_n").over(through))
    found = held.join(asked, same).filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_n")))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "rank", F.col("_v").alias("value"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and `quantiles`: an array of the exact quantiles, between the two values next to a share by linear interpolation."""
    double = df.select(*by, F.col(value).cast("double").alias("_x"))
    at = lambda n: F.array(*[r for p in shares for r in (F.floor(p * (n - 1)), F.ceil(p * (n - 1)))])
    n = double.groupBy(*by).agg(F.count("_x").alias("_n"))
    ends = order_statistics(double, by, "_x", at).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_e"))  # two of a share

    def between(k: int, p: float) -> Column:
        place = p * (F.col("_n") - 1)
        low, high = F.col("_e")[2 * k], F.col("_e")[2 * k + 1]
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return _beside(n, ends, by).select(*by, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("quantiles"))


def upper_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """By and `upper_median`, the middle of the sorted values, the upper of two."""
    n = df.groupBy(*by).agg(F.count(value).alias("_n"))
    found = order_statistics(df, by, value, lambda n: F.array(F.floor(n / 2))).drop("rank")
    return _beside(n, found, by).select(*by, F.col("value").alias("upper_median"))


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right, by group (null is one); without groups both have one row at most."""
    named = right.withColumnsRenamed({c: f"_{c}_" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return left.join(named if by else F.broadcast(named), same, "left").drop(*[f"_{c}_" for c in by])
