"""Bootstrap of units (A15-A19). The index of slot i in replicate b is eight hex digits of md5(seed | b | i) modulo n, so
any engine draws the same.

The units' values are held in arrays of HELD at most (a table of more is cut into as many), in key order. Draws are numbers of
a range, in blocks; a task hashes a block's draws in numpy, looks values up in the broadcast arrays and gives one partial sum a replicate and class: no
draw is a row. More than HELD units take one pass over the draws for every array."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import sampling

#: Units whose values are broadcast in one array.
HELD = 2_000_000
#: Draws of a block, and of those that are hashed at once.
BLOCK, STEP = 1 << 20, 1 << 15

# md5's constants (RFC 1321)
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_PLACES = [p for f in (lambda k: k, lambda k: 5 * k + 1, lambda k: 3 * k + 5, lambda k: 7 * k) for p in (f(k) % 16 for k in range(16))]


def _hash_words(words: np.ndarray) -> np.ndarray:
    """The first four digest bytes, as a number, of md5 over one padded 64-byte message a column (words: 16 rows)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    used = [bool(w.any()) for w in words]
    # a after 64 steps is what step 61 gives
    for k in range(61):
        if k < 16:
            f = ((c ^ d) & b) ^ d
        elif k < 32:
            f = ((b ^ c) & d) ^ c
        elif k < 48:
            f = b ^ c ^ d
        else:
            f = (~d | b) ^ c
        f += a
        f += _SINES[k]
        if used[_PLACES[k]]:
            f += words[_PLACES[k]]
        turned = f << np.uint32(_TURNS[k])
        f >>= np.uint32(32 - _TURNS[k])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def slot_numbers(seed, b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The first eight hex digits of md5(seed | b | i), as numbers, for every pair of b and i."""
    head = f"{seed}|".encode()
    out = np.empty(len(b), np.int64)
    shape = _widths(b) * 32 + _widths(i)
    for s in np.unique(shape):
        at, wb, wi = np.flatnonzero(shape == s), int(s) // 32, int(s) % 32
        size = len(head) + wb + 1 + wi
        if size > 55:  # more than one 64-byte block
            out[at] = [int(hashlib.md5(head + b"%d|%d" % p).hexdigest()[:8], 16) for p in zip(b[at].tolist(), i[at].tolist(), strict=True)]
            continue
        fixed = np.frombuffer((head + bytes(wb) + b"|" + bytes(wi) + b"\x80").ljust(56, b"\0") + (size * 8).to_bytes(8, "little"), "<u4")
        words = np.repeat(fixed[:, None], len(at), 1)
        for x, w, end in ((b[at], wb, len(head) + wb), (i[at], wi, size)):
            x = x.astype(np.uint32 if w < 10 else np.uint64)
            for place in range(end - 1, end - 1 - w, -1):
                more = x // 10
                words[place // 4] |= (x - more * 10 + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
                x = more
        out[at] = _hash_words(words)
    return out


def _widths(x: np.ndarray) -> np.ndarray:
    """The numbers of decimal digits."""
    least, most = (len(str(int(f(x)))) for f in (np.min, np.max))
    return least + sum(((x >= 10**k).astype(np.int64) for k in range(least, most)), np.zeros(len(x), np.int64))


def _held(units: DataFrame, key: str, n: int, held: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, classes, values) for each run of `held` units in key order; units: key, g, v."""
    if n <= held:
        runs = [(0, units.orderBy(key, "g", "v"))]
    else:
        placed = scratch.stage(sampling.positions(units, key).select("pos", "g", "v"), "units")
        runs = [(s, placed.filter((F.col("pos") >= s) & (F.col("pos") < s + held)).orderBy("pos")) for s in range(0, n, held)]
    for start, run in runs:
        # a bounded number of rows, two numbers each
        got = run.select("g", "v").toArrow()
        yield start, got["g"].to_numpy(), got["v"].to_numpy()


def _drawn(spark: SparkSession, units: DataFrame, key: str, reps: int, seed, n: int, held: int) -> DataFrame:
    """b, g, s, c: sum and number of the values that each replicate draws of each class. units: key, g (class 0, 1, ...), v; null ones aren't counted."""
    schema, total = "b bigint, g int, s double, c bigint", reps * n
    known = F.col("g").isNotNull() & F.col("v").isNotNull()
    units = units.select(key, F.when(known, F.col("g")).otherwise(-1).cast("int").alias("g"), F.when(known, F.col("v")).otherwise(0.0).alias("v"))
    blocks = -(-total // BLOCK)
    out = spark.createDataFrame([], schema)
    for start, classes, values in _held(units, key, n, held) if total else ():
        kept, k = spark.sparkContext.broadcast((classes, values)), max(1, int(classes.max()) + 1)

        def sums(batches: Iterator[pa.RecordBatch], start=start, kept=kept, k=k) -> Iterator[pa.RecordBatch]:
            classes, values = kept.value
            for block in (x for batch in batches for x in batch.column(0).to_pylist()):
                low, high = block * BLOCK, min((block + 1) * BLOCK, total)
                first = low // n
                s, c = (np.zeros(((high - 1) // n - first + 1) * k) for _ in range(2))
                for at in range(low, high, STEP):
                    draw = np.arange(at, min(at + STEP, high))
                    b = draw // n
                    pos = slot_numbers(seed, b, draw - b * n) % n - start
                    here = (pos >= 0) & (pos < len(values))
                    pos, b = pos[here], b[here]
                    g = classes[pos]
                    some = g >= 0
                    cell = ((b - first) * k + g)[some]
                    s += np.bincount(cell, values[pos[some]], len(s))
                    c += np.bincount(cell, minlength=len(c))
                cells = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(cells // k + first), pa.array((cells % k).astype(np.int32)), pa.array(s[cells]), pa.array(c[cells].astype(np.int64))], names=["b", "g", "s", "c"])

        out = out.unionByName(spark.range(0, blocks, 1, min(blocks, 1000)).mapInArrow(sums, schema))
    return out


def _replicates(units: DataFrame, value: str, key: str, reps: int, seed, held: int = HELD) -> DataFrame:
    """b, mean: the means of `reps` resamples of the units (null values leave the means)."""
    rows = scratch.stage(units.select(key, F.lit(0).alias("g"), F.col(value).cast("double").alias("v")), "rows")
    n = rows.count()
    means = _drawn(rows.sparkSession, rows, key, reps, seed, n, held).groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    return rows.sparkSession.range(reps if n else 0).select(F.col("id").alias("b")).join(means, "b", "left")


def _interval(replicates: DataFrame) -> DataFrame:
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.agg(p[0].alias("ci95_low"), p[1].alias("ci95_high"))


def bootstrap_ci(units: DataFrame, value: str, key: str, reps: int = 200, seed=0) -> DataFrame:
    """Mean over units and its percentile interval."""
    mean = units.agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("units"))
    return mean.crossJoin(_interval(_replicates(units, value, key, reps, seed)))


def paired_bootstrap(left: DataFrame, right: DataFrame, key: str, value: str, reps: int = 200, seed=0) -> DataFrame:
    """Bootstrap of the differences of units that both sides have."""
    both = left.select(key, F.col(value).alias("_l")).join(right.select(key, F.col(value).alias("_r")), key)
    return bootstrap_ci(both.select(key, (F.col("_l") - F.col("_r")).alias("_d")), "_d", key, reps, seed)


def difference_bootstrap(left: DataFrame, right: DataFrame, value: str, key: str, reps: int = 200, seed=0) -> DataFrame:
    """Difference of two means, each side resampled on its own."""
    l, r = (_replicates(x, value, key, reps, f"{seed}{side}") for x, side in ((left, "l"), (right, "r")))
    gaps = l.select("b", F.col("mean").alias("_l")).join(r.select("b", F.col("mean").alias("_r")), "b").select((F.col("_l") - F.col("_r")).alias("mean"))
    mean = lambda x, name: x.agg(F.avg(F.col(value).cast("double")).alias(name))
    point = mean(left, "_l").crossJoin(mean(right, "_r")).select((F.col("_l") - F.col("_r")).alias("difference"))
    return point.crossJoin(_interval(gaps))


def did_over_features(cells: DataFrame, reps: int = 200, seed=0) -> DataFrame:
    """Mean effect of candidates (the anchor among them) less that of controls, over cells with a dose. The
    features are resampled, not the problems. cells: feature, role, alpha, delta."""
    dosed = cells.filter(F.coalesce(F.col("alpha"), F.lit(0.0)) > 0)
    out = difference_bootstrap(dosed.filter(F.col("role").isin("anchor", "candidate")), dosed.filter(F.col("role").startswith("control")), "delta", "feature", reps, seed)
    return out.withColumn("verdict", F.when(F.col("ci95_low") > 0, "specific").when(F.col("ci95_high") < 0, "reversed").otherwise("not separated"))


def mediation_bootstrap(rows: DataFrame, flag: str, value: str, key: str, reps: int = 4000, least: int = 30, seed=0, held: int = HELD) -> DataFrame:
    """Difference of value between the classes with rows resampled; replicates of one class are left out. Null for
    fewer than `least` rows or one class."""
    named = scratch.stage(rows.select(key, F.col(flag).alias("f"), F.col(value).cast("double").alias("v")), "rows")
    have = named.agg(F.count("*").alias("n"), F.countDistinct("f").alias("classes")).first()
    n = have["n"] if have["n"] >= least and have["classes"] == 2 else 0
    parts = _drawn(rows.sparkSession, named.select(key, F.col("f").cast("int").alias("g"), "v"), key, reps, seed, n, held)
    mean = lambda g: F.try_divide(F.sum(F.when(F.col("g") == g, F.col("s"))), F.sum(F.when(F.col("g") == g, F.col("c"))))
    reps_ = parts.groupBy("b").agg((mean(1) - mean(0)).alias("mean")).filter("mean IS NOT NULL")
    enough = (F.count("*") >= least) & (F.countDistinct("f") == 2)
    point = named.agg(F.when(enough, F.avg(F.when(F.col("f"), F.col("v"))) - F.avg(F.when(~F.col("f"), F.col("v")))).alias("difference"))
    return point.crossJoin(_interval(reps_))
