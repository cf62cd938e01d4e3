"""Hierarchic social entropy of a trace's segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import sampling

LEAST = 3


def _tree_edges(points: np.ndarray) -> np.ndarray:
    """Edges (height, i, j) of a minimum spanning tree under cosine distance, by Prim: distances are made a row at a time,
    so the memory is linear in the segments."""
    n = len(points)
    best, link = np.full(n, np.inf), np.zeros(n, dtype=int)
    out, at = [], 0
    done = np.zeros(n, dtype=bool)
    for _ in range(n - 1):
        done[at] = True
        gap = np.maximum(1.0 - points @ points[at], 0.0)
        nearer = (gap < best) & ~done
        best[nearer], link[nearer] = gap[nearer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out.append((best[at], link[at], at))
    return np.array(sorted(out))


def entropy_integral(edges, n: int) -> float:
    """The integral over all heights of the clusters' entropy (bits); merges change the sum p log p by their own terms."""
    size, parent = np.ones(n), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    term = lambda s: s / n * np.log2(s / n)
    entropy, last, total = float(np.log2(n)), 0.0, 0.0
    for height, i, j in edges:
        total += entropy * (height - last)
        last = height
        a, b = root(int(i)), root(int(j))
        entropy += term(size[a]) + term(size[b]) - term(size[a] + size[b])
        size[a] += size[b]
        parent[b] = a
    return float(total)


def diversity(points: np.ndarray) -> tuple[float, float, float] | None:
    """Entropy, entropy over log2 n and mean pairwise distance of unit vectors; None below three."""
    n = len(points)
    if n < LEAST:
        return None
    whole = float(np.sum(np.sum(points, axis=0) ** 2))  # the sum of all products
    own = float(np.sum(points * points))
    mean = 1.0 - (whole - own) / (n * (n - 1))
    hse = entropy_integral(_tree_edges(points), n)
    return hse, hse / np.log2(n), max(mean, 0.0)


#: Segments up to which a trace is one task's work; beyond, of a tile of the trace.
LONG, TILE = 4096, 2048


def _tile_edges(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges (height, i, j) of a minimum spanning tree of the distances between two tiles, by Prim; j counts on behind the left."""
    n, m = len(left), len(left) + len(right)
    best, link = np.full(m, np.inf), np.zeros(m, dtype=int)
    out, at, done = [], 0, np.zeros(m, dtype=bool)
    for _ in range(m - 1):
        done[at] = True
        side = slice(n, m) if at < n else slice(0, n)
        gap = np.maximum(1.0 - (right @ left[at] if at < n else left @ right[at - n]), 0.0)
        nearer = (gap < best[side]) & ~done[side]
        best[side][nearer], link[side][nearer] = gap[nearer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out.append((best[at], link[at], at))
    return np.array(out).reshape(-1, 3)


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges (h, i, j) that join two parts, in the order of h."""
    edges = edges.sort_values(["h", "i", "j"])
    nodes, places = np.unique(edges[["i", "j"]].to_numpy(), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = np.zeros(len(edges), dtype=bool)
    for k, (i, j) in enumerate(places.reshape(-1, 2).tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[b], keep[k] = a, True
    return edges[keep]


def _spanning_trees(rows: DataFrame, kind: str, tile: int = TILE) -> DataFrame:
    """_t, h, i, j: edges of a minimum spanning tree of each trace of rows (_t, _v), whose vectors are unit vectors.

    A trace is cut into tiles; a task has one tile's distances, or those between two, and hands on their spanning tree alone: an edge
    that isn't in it isn't in the trace's either. These forests are then merged, four neighbouring pairs of tiles into
    one each round, so a round halves the edges, and what one task holds is linear in the segments under it.
    """
    packed = sampling.numbered(rows.select("_t", "_v", F.monotonically_increasing_id().alias("_o")), ["_t"], ["_o"], "_i").withColumn("_b", F.expr(f"_i div {tile}"))
    blocks = packed.groupBy("_t", "_b").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s"))  # a tile's rows
    many = packed.groupBy("_t").agg(F.max("_b").alias("_m"))
    every = F.sequence(F.lit(0).cast("long"), "_m")
    met = blocks.join(many, "_t").withColumn("_o", F.explode(every)).select("_t", F.least("_b", "_o").alias("a"), F.greatest("_b", "_o").alias("b"), "_b", "_s")

    def one(key, frame):
        frame = frame.sort_values("_b")
        sides = [np.array([np.asarray(x["_v"], dtype=np.float64) for x in s]) for s in frame["_s"]]
        h, i, j = (_tree_edges(sides[0]) if len(sides) == 1 else _tile_edges(*sides)).reshape(-1, 3).T
        first = len(sides[0])
        start = lambda k: np.where(k < first, key[1] * tile + k, key[2] * tile + k - first)
        return pd.DataFrame({"_t": key[0], "a": key[1], "b": key[2], "h": h, "i": start(i).astype(np.int64), "j": start(j).astype(np.int64)})

    schema = f"_t {kind}, a long, b long, h double, i long, j long"
    edges = scratch.stage(met.groupBy("_t", "a", "b").applyInPandas(one, schema), "tile-trees")
    most = many.agg(F.max("_m")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        halved = edges.withColumns({"a": F.expr("a div 2"), "b": F.expr("b div 2")})
        edges = scratch.stage(halved.groupBy("_t", "a", "b").applyInPandas(lambda frame: _forest(frame), schema), "tile-trees")
    return edges.select("_t", "h", "i", "j")


def hse_by_trace(segments: DataFrame, trace: str, vector: str, single: str = "zero", long: int = LONG, tile: int = TILE) -> DataFrame:
    """n_segments, hse, hse_norm, mean_dist of each trace. A trace with fewer than three segments is a single voice: its
    measures are 0, or it is left out (single="drop"), which can turn a comparison's sign.

    A trace of up to `long` segments is one task's work. The spanning tree of a longer one is put together from tiles; what is left
    to one task is the walk over its edges, linear in its segments."""

    def one(key, frame):
        points = np.stack([np.asarray(v, dtype=np.float64) for v in frame["_v"]])
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        found = diversity(points / np.where(norms > 0, norms, 1.0))
        if found is None and single == "drop":
            return pd.DataFrame(columns=["_t", "n_segments", "hse", "hse_norm", "mean_dist", "single_voice"])
        return pd.DataFrame([(key[0], len(points), *(found or (0.0, 0.0, 0.0)), found is None)], columns=["_t", "n_segments", "hse", "hse_norm", "mean_dist", "single_voice"])

    kind = segments.schema[trace].dataType.simpleString()
    schema = f"_t {kind}, n_segments long, hse double, hse_norm double, mean_dist double, single_voice boolean"
    rows = segments.select(F.col(trace).alias("_t"), F.col(vector).alias("_v")).filter("_v IS NOT NULL")
    lengthy = rows.groupBy("_t").agg(F.count("*").alias("_n")).filter(F.col("_n") > long).select(F.col("_t").alias("_l"))
    if lengthy.isEmpty():
        return rows.groupBy("_t").applyInPandas(one, schema).withColumnRenamed("_t", trace)
    same = F.col("_t").eqNullSafe(F.col("_l"))
    short = rows.join(lengthy, same, "left_anti").groupBy("_t").applyInPandas(one, schema)
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.join(lengthy, same, "left_semi").withColumn("_z", size).select("_t", F.transform("_v", lambda x: x.cast("double") / F.when(F.col("_z") > 0, F.col("_z")).otherwise(1.0)).alias("_v"))

    def walk(key, frame):
        frame = frame.sort_values(["h", "i", "j"])
        n = len(frame) + 1
        hse = entropy_integral(frame[["h", "i", "j"]].to_numpy(), n)
        return pd.DataFrame({"_t": [key[0]], "hse": [hse], "hse_norm": [hse / np.log2(n)]})

    trees = _spanning_trees(unit, kind, tile).groupBy("_t").applyInPandas(walk, f"_t {kind}, hse double, hse_norm double")
    means = mean_pairwise_distance(unit, "_t", "_v").withColumnRenamed("_t", "_l")
    rest = trees.join(means, same).select("_t", "n_segments", "hse", "hse_norm", F.greatest("mean_dist", F.lit(0.0)).alias("mean_dist"), F.lit(False).alias("single_voice"))
    return short.unionByName(rest).withColumnRenamed("_t", trace)


def mean_pairwise_distance(segments: DataFrame, trace: str, vector: str) -> DataFrame:
    """F34, J13 without the pairs: of unit vectors, the sum of all products is the squared length of their sum. One row a
    (trace, dimension) is shuffled."""
    parts = segments.select(trace, F.posexplode(vector).alias("d", "x"))
    sums = parts.groupBy(trace, "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    total = sums.groupBy(trace).agg(F.sum(F.col("s") * F.col("s")).alias("_all"), F.sum("q").alias("_own"), F.max("n").alias("n_segments"))
    pairs = F.col("n_segments") * (F.col("n_segments") - 1)
    return total.filter("n_segments > 1").select(trace, "n_segments", (1 - (F.col("_all") - F.col("_own")) / pairs).alias("mean_dist"))
