"""Length matching and control matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sampling
from .sampling import positions
from .stats import Z


def match_lengths(treated: np.ndarray, controls: np.ndarray, caliper: float) -> list[tuple[int, int]]:
    """Greedy 1:1 pairs without replacement, in the order given: each treated length takes the nearest unused control (the
    earlier one on a tie) if it lies within the relative caliper; else the control stays free.

    Controls are queues by distinct length; two union-find arrays lead past exhausted ones, so the work is near linear.
    """
    values, inverse = np.unique(controls, return_inverse=True)
    queues: list[list[int]] = [[] for _ in values]
    for i, v in enumerate(inverse.tolist()):
        queues[v].append(i)
    used = [0] * len(values)
    left, right = list(range(len(values) + 1)), list(range(len(values) + 1))  # shifted by one to the left; the end to the right

    def find(jump: list[int], x: int) -> int:
        while jump[x] != x:
            jump[x] = x = jump[jump[x]]
        return x

    pairs = []
    for t, x in enumerate(treated.tolist()):
        at = int(np.searchsorted(values, x, side="right"))
        lo, hi = find(left, at) - 1, find(right, at)
        near = []
        if lo >= 0:
            near.append((abs(x - values[lo]), queues[lo][used[lo]], lo))
        if hi < len(values):
            near.append((abs(values[hi] - x), queues[hi][used[hi]], hi))
        if not near:
            break
        gap, control, v = min(near)
        if gap > caliper * max(x, 1):
            continue
        pairs.append((t, control))
        used[v] += 1
        if used[v] == len(queues[v]):
            left[v + 1] = v
            right[v] = v + 1
    return pairs


def match_counts(lengths: np.ndarray, treated: np.ndarray, controls: np.ndarray, caliper: float) -> list[tuple[int, int, int, int, int]]:
    """match_lengths for sorted controls, on counts by ascending distinct length: (i, j, n, a, b) says that the treated of
    length i, from their a-th on, take n controls of length j, from their b-th on. The work grows with the lengths, not with the rows."""
    left, right = list(range(len(lengths) + 1)), list(range(len(lengths) + 1))  # past exhausted lengths; shifted by one to the left
    free = controls.tolist()
    taken = [0] * len(lengths)

    def find(jump: list[int], x: int) -> int:
        while jump[x] != x:
            jump[x] = x = jump[jump[x]]
        return x

    def leave(v: int) -> None:
        left[v + 1], right[v] = v, v + 1

    for v, n in enumerate(free):
        if not n:
            leave(v)
    out = []
    for i in np.flatnonzero(treated).tolist():
        x, n, done = float(lengths[i]), int(treated[i]), 0
        while done < n:
            lo, hi = find(left, i + 1) - 1, find(right, i + 1)
            below = x - lengths[lo] if lo >= 0 else np.inf
            above = lengths[hi] - x if hi < len(lengths) else np.inf
            j, gap = (lo, below) if below <= above else (hi, above)
            if not gap <= caliper * max(x, 1):
                break
            some = min(n - done, free[j])
            out.append((i, j, some, done, taken[j]))
            done += some
            taken[j] += some
            free[j] -= some
            if not free[j]:
                leave(j)
    return out


def length_pieces(counts: DataFrame, caliper: float) -> DataFrame:
    """counts (g, l, ...) with `piece`: lengths of a group between which no pair can be are in different pieces, numbered in
    order. A pair can't bridge a gap wider than the caliper of the length behind it. The gap before a range of lengths shows
    from the last length of the ranges before, and pieces are numbered by the ranges' counts of such gaps."""
    placed = sampling.ranges(counts, ["g", "l"])
    edge = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ends = placed.groupBy("_range").agg(F.max(F.struct("g", "l")).alias("_e")).withColumn("_e", F.max("_e").over(edge))
    inside = Window.partitionBy("_range").orderBy("_at")
    before = F.coalesce(F.lag(F.struct("g", "l")).over(inside), F.col("_e"))
    # a caliper of 1 or more may reach from a long length over any gap
    wide = F.col("l") - before["l"] > caliper * F.greatest(F.col("l"), F.lit(1.0)) if caliper < 1 else F.lit(False)
    begins = before.isNull() | ~before["g"].eqNullSafe(F.col("g")) | wide
    cut = placed.join(F.broadcast(ends), "_range").withColumn("_new", begins.cast("long"))
    local = cut.withColumn("_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = local.groupBy("_range").agg(F.sum("_new").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(edge), F.lit(0))).drop("_s")
    return local.join(F.broadcast(sums), "_range").withColumn("piece", F.col("_local") + F.col("_off")).select(*counts.columns, "piece")


#: Pairs of one flow that one row is spread into, at most.
SPREAD = 10_000


def matched_pairs(df: DataFrame, key: str, flag: str, length: str, value: str, caliper: float = 0.05, by: str | None = None) -> DataFrame:
    """The pairs, inside groups of `by` or pooled: treated rows (a true flag) by length, then key, take the nearest free
    control, on a tie the shorter one, of equal lengths that with the least key; rows with a null flag or length take no part.

    The rule is sequential, but it runs on the numbers of rows of each length: these are counted by the cluster, cut into pieces
    that no pair can connect, and each piece is one task's work (of lengths, not rows). Rows come back in by their place
    among those of their length and class: a third of all rows may have one length.
    """
    named = df.select(F.col(by).cast("string").alias("g") if by else F.lit("all").alias("g"), F.col(key).cast("long").alias("k"), F.col(flag).alias("f"), F.col(length).cast("double").alias("l"), F.col(value).cast("double").alias("v"))
    rows = sampling.numbered(named.filter("f IS NOT NULL AND l IS NOT NULL AND NOT isnan(l)"), ["g", "f", "l"], ["k"], "place")
    counts = rows.groupBy("g", "l").agg(F.count_if("f").alias("t"), F.count_if(~F.col("f")).alias("c"))

    def one(piece, frame):
        frame = frame.sort_values("l")
        lengths = frame["l"].to_numpy()
        found = match_counts(lengths, frame["t"].to_numpy(), frame["c"].to_numpy(), caliper)
        i, j, n, a, b = np.array(found, dtype=np.int64).reshape(-1, 5).T
        return pd.DataFrame({"g": frame["g"].iloc[0], "x": lengths[i], "y": lengths[j], "n": n, "a": a, "b": b})

    flows = length_pieces(counts, caliper).groupBy("piece").applyInPandas(one, "g string, x double, y double, n long, a long, b long")
    # a flow of many pairs is spread in two steps, so that no task makes them all
    steps = flows.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPREAD}")))).repartition("g", "x", "a", "_s")
    pairs = steps.withColumn("_p", F.explode(F.sequence(F.col("_s") * SPREAD, F.least((F.col("_s") + 1) * SPREAD, "n") - 1)))
    pairs = pairs.select(F.col("g").alias("pg"), "x", "y", (F.col("a") + F.col("_p")).alias("pa"), (F.col("b") + F.col("_p")).alias("pb"))
    side = lambda f, name: rows.filter(F.col("f") == f).select(*[F.col(c).alias(f"{name}{c}") for c in ("g", "k", "l", "v", "place")])
    met = side(True, "t").join(pairs, F.col("tg").eqNullSafe(F.col("pg")) & (F.col("tl") == F.col("x")) & (F.col("tplace") == F.col("pa")))
    both = met.join(side(False, "c"), F.col("pg").eqNullSafe(F.col("cg")) & (F.col("y") == F.col("cl")) & (F.col("pb") == F.col("cplace")))
    return both.select(
        F.col("pg").alias(by or "scope"), F.col("tk").alias("treated_id"), F.col("ck").alias("control_id"), F.col("tl").alias("treated_length"), F.col("cl").alias("control_length"),
        F.col("tv").alias("treated_value"), F.col("cv").alias("control_value"),
    )


def matched_estimate(pairs: DataFrame, by: str, least: int = 30) -> DataFrame:
    """A7 over pairs; fewer than `least` give no estimate. The relative gap is over the treated mean length (and so can
    exceed the caliper); the largest gap of a pair is there too."""
    d = F.col("treated_value") - F.col("control_value")
    gap = F.abs(F.col("treated_length") - F.col("control_length"))
    out = pairs.groupBy(by).agg(
        F.count("*").alias("n_pairs"), F.avg(d).alias("_d"), (Z * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("_h"),
        F.avg("treated_length").alias("mean_words_treated"), F.avg("control_length").alias("mean_words_control"),
        (F.max(gap) / F.greatest(F.avg("treated_length"), F.lit(1.0))).alias("max_relative_length_gap"),
        F.max(gap / F.greatest(F.col("treated_length"), F.lit(1.0))).alias("max_pair_gap"),
    )
    enough = F.col("n_pairs") >= least
    return out.select(
        by, "n_pairs", F.when(enough, F.col("_d")).alias("difference"), F.when(enough, F.col("_d") - F.col("_h")).alias("ci95_low"), F.when(enough, F.col("_d") + F.col("_h")).alias("ci95_high"),
        "mean_words_treated", "mean_words_control", "max_relative_length_gap", "max_pair_gap", F.when(~enough, F.lit("too few pairs")).alias("note"),
    )


def dose_vs_baseline(traces: DataFrame, key: str, alpha: str, length: str, value: str, dose: float, caliper: float = 0.10) -> DataFrame:
    """Traces at a dose against undosed ones, matched on length."""
    two = traces.filter((F.col(alpha) == 0) | (F.col(alpha) == dose)).withColumn("_base", F.col(alpha) == 0)
    return matched_pairs(two, key, "_base", length, value, caliper)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    """0 for empty, unequal or zero vectors."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0), dot(a, b) / F.when(size > 0, size)).otherwise(0.0)


def cosine_to_anchor(features: DataFrame, key: str, vector: str, anchor) -> DataFrame:
    """Every feature's similarity to one (the anchor is one row)."""
    one = features.filter(F.col(key) == anchor).select(F.col(vector).alias("_anchor")).limit(1)
    return features.crossJoin(F.broadcast(one)).select(features["*"], cosine(F.col(vector), F.col("_anchor")).alias("score"))


def ranked_features(scored: DataFrame, key: str, anchor) -> DataFrame:
    """`place` by falling score, whether in the lower half, and whether matched to the anchor in firing
    rate and size. scored: description, max_act, frac_nonzero, score."""
    usable = scored.filter((F.length("description") > 0) & (F.col("max_act") >= 1) & (F.col("frac_nonzero") > 0))
    a = F.broadcast(usable.filter(F.col(key) == anchor).select(F.col("max_act").alias("_act"), F.col("frac_nonzero").alias("_frac")).limit(1))
    n = F.broadcast(usable.agg(F.count("*").alias("_n")))
    placed = positions(usable.withColumn("_fall", -F.col("score")), "_fall", "place", ties=(key,)).withColumn("place", (F.col("place") + 1).cast("int")).drop("_fall")
    ratio = F.col("max_act") / F.col("_act")
    matched = (F.abs(F.log10("frac_nonzero") - F.log10("_frac")) < 0.5) & (ratio >= 0.6) & (ratio <= 1.7)
    return placed.crossJoin(a).crossJoin(n).withColumn("lower_half", F.col("place") > F.expr("_n div 2")).withColumn("matched", matched).drop("_act", "_frac", "_n")
