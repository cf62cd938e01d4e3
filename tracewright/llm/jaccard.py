"""Jaccard join of texts on their sets of word shingles, by size-banded tiles with bitmap signatures.

Equal sets are one node. A node's signature is a bitmap of half a bit to one bit a shingle, whose bits are the parity of
the shingles hashed to them: two bitmaps (the longer folded to the shorter) differ in no more bits than their sets
in shingles, so counting bits bounds the intersection from above, without false negatives. Nodes are dealt into tiles
by size; only tiles whose sizes permit a link meet. Two passes go over the pairs of tiles:

1. bitmaps alone are compared in numpy; what leaves a task are the nodes that have a candidate there, not the pairs;
2. the sets of these nodes (sorted hashes of their shingles) go to the pair of tiles, where candidates are found again
   and intersected exactly. What leaves a task are a spanning forest of its links and each node's number of links.

So a group of n texts that are all linked gives some n rows a pair of tiles, though each of its links is verified and
counted. A tile holds TILE nodes and TILE_SHINGLES shingles at most (or one larger set), which bounds what a task holds and does. The
comparison is quadratic in the nodes of like size by the method: up to TILES full tiles the rows exchanged grow with the table,
beyond that with its square; the table of tiles that is broadcast has a row for every tile. Classes are connected
components, found in rounds on the cluster. Shingles are told apart by their 64-bit hashes, sets by 128-bit checksums.

Cases. Null text is empty; a text without words has no shingle and is linked with nothing, a copy of itself neither; rows
with a null id belong to classes but never name them (a class without ids has a null name); repeated rows are linked
with each other; an empty table gives no rows; texts of any length count whole; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record_batch, slices
from .common import stage, unstage
from .simhash import components, forest, shingle_set
from .token_records import spread

#: Words of a shingle; sets are linked from an intersection of NEAR / OF of the union.
SHINGLE, NEAR, OF = 4, 85, 100
TILES, TILE, TILE_SHINGLES = 24, 20_000, 2_500_000
#: Tasks over which the rows of one set are dealt; slots of the table that sifts texts; shingles gathered at once.
SALTS, SLOTS, GATHER = 16, 1 << 24, 2_000_000


def bitmap_words(n: int) -> int:
    """64-bit words of a bitmap: the least power of two with half a bit a shingle."""
    return 1 << max(0, (n - 1).bit_length() - 7)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = 64 * bitmap_words(len(hashes))
    parity = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64)


def text_keys(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(7), "text").alias("t1"), "text")


def _distinct(part: pa.RecordBatch):
    """The rows' place among the distinct texts of the batch, and these texts."""
    texts = part.column(part.num_columns - 1).dictionary_encode("encode")
    return texts.indices.to_numpy(zero_copy_only=False), texts.dictionary.to_pylist()


def sketches(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each row its id, the keys of its text (t0, t1), the set's size n, checksum (sum0, sum1) and bitmap."""
    names = ["doc_id", "t0", "t1", "n", "sum0", "sum1"]
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("bits", pa.binary())])

    def sketch(text):
        found = shingle_set(text, size)
        digest = xxhash.xxh3_128_intdigest(found.tobytes())
        return len(found), *np.array([digest >> 64, digest & (1 << 64) - 1], dtype=np.uint64).view(np.int64).tolist(), bitmap(found).tobytes() if len(found) else b""

    def build(batches):
        for batch in batches:
            for part in slices(batch, 3):
                at, texts = _distinct(part)
                made = [sketch(t) for t in texts]
                yield record_batch(schema, *part.columns[:3], *zip(*[made[i] for i in at], strict=True))

    return text_keys(documents).mapInArrow(build, ", ".join(f"{c} long" for c in names) + ", bits binary")


def cell_of(n):
    """Cells of like size: each size below 64, then steps of a hundredth."""
    return F.when(n < 64, n).otherwise(64 + F.floor(F.log(n.cast("double") / 64) * 100)).cast("int")


def plan_tiles(cells: list[tuple[int, int, int, int, int]], near: int = NEAR, of: int = OF, tiles: int = TILES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(cell, first tile, tiles), and (tile, first, last): the earlier and later tiles whose sizes permit a link with it.

    cells: (cell, nodes, shingles, least size, greatest size). Tiles are numbered by size, so those that a tile meets are neighbours.
    """
    nodes = min(TILE, max(1, -(-sum(c[1] for c in cells) // tiles)))
    shingles = min(TILE_SHINGLES, max(1, -(-sum(c[2] for c in cells) // tiles)))
    plan, low, top, held = [], [], [], (nodes, shingles)
    for cell, n, total, least, most in sorted(cells):
        if held[0] + n <= nodes and held[1] + total <= shingles:
            held = held[0] + n, held[1] + total
            top[-1] = most
            plan.append((cell, len(low) - 1, 1))
            continue
        cut = min(n, max(-(-n // nodes), -(-total // shingles)))
        plan.append((cell, len(low), cut))
        low += [least] * cut
        top += [most] * cut
        held = (n, total) if cut == 1 else (nodes, shingles)
    first = [bisect_left(top, -(-near * x // of)) for x in low]
    last = [bisect_right(low, of * x // near) - 1 for x in top]
    return plan, [(i, min(i, first[i]), max(i, last[i])) for i in range(len(low))]


def by_tile_pair(nodes: DataFrame, tiles: DataFrame, reach: DataFrame) -> DataFrame:
    """The nodes (node, n and what else they carry) at every pair of tiles (a, b) that theirs is in: side 0 as a, side 1 as b."""
    own = [c for c in nodes.columns]
    dealt = nodes.withColumn("_cell", cell_of(F.col("n"))).join(F.broadcast(tiles), F.col("_cell") == F.col("cell"))
    dealt = dealt.withColumn("tile", F.col("first_tile") + F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")).join(F.broadcast(reach), "tile")
    heads = dealt.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", "last")).alias("b"), F.lit(0).alias("side"), *own)
    tails = dealt.filter("first < tile").select(F.explode(F.sequence("first", F.col("tile") - 1)).alias("a"), F.col("tile").alias("b"), F.lit(1).alias("side"), *own)
    return heads.unionByName(tails)


def candidates(n: np.ndarray, maps: list[bytes], side: np.ndarray | None, near: int = NEAR, of: int = OF, rows: int = 128, columns: int = 4096):
    """Arrays (p, q) of indexes of pairs that sizes and bitmaps don't rule out: of all with each other, or across the sides."""
    order = np.argsort(n, kind="stable")
    size, every = n[order].astype(np.int64), np.arange(len(n))
    kind = np.array([bitmap_words(int(x)) for x in size.tolist()], dtype=np.int64)
    runs = [(every, every)] if side is None else [(every[side[order] == s], every[side[order] != s]) for s in (0, 1)]
    held = {}

    def whole(w: int) -> np.ndarray:
        a, b = np.searchsorted(kind, w), np.searchsorted(kind, w, side="right")
        return np.frombuffer(b"".join([maps[i] for i in order[a:b].tolist()]), dtype=np.uint64).reshape(b - a, w)

    for w in np.unique(kind).tolist():
        start, stop = np.searchsorted(kind, w), np.searchsorted(kind, w, side="right")
        own = held.pop(w, None)
        own = whole(w) if own is None else own
        # a size that may be linked is less than twice as large, so at most the next kind is met, folded
        held = {2 * w: whole(2 * w)}
        cells = np.ascontiguousarray(np.concatenate([own, held[2 * w][:, :w] ^ held[2 * w][:, w:]]).T)
        counts = np.uint16 if 64 * w < 1 << 16 else np.uint32
        for left, right in runs:
            mine = left[np.searchsorted(left, start) : np.searchsorted(left, stop)]
            for a in range(0, len(mine), rows):
                p = mine[a : a + rows]
                end = np.searchsorted(size, of * size[p[-1]] // near, side="right")
                met = right[np.searchsorted(right, p[0] + 1) : np.searchsorted(right, end)]
                x = cells[:, p - start]
                for b in range(0, len(met), columns):
                    q = met[b : b + columns]
                    y = cells[:, q - start]
                    apart = np.bitwise_count(x[0][:, None] ^ y[0]).astype(counts)
                    for k in range(1, w):
                        apart += np.bitwise_count(x[k][:, None] ^ y[k])
                    i, j = np.nonzero(apart <= (of - near) * (size[p[-1]] + size[q]) // (of + near))
                    far, i, j = apart[i, j].astype(np.int64), p[i], q[j]
                    fits = (i < j) & (near * size[j] <= of * size[i]) & (far * (of + near) <= (of - near) * (size[i] + size[j]))
                    if fits.any():
                        yield order[i[fits]], order[j[fits]]


def with_candidates(paired: DataFrame, near: int = NEAR, of: int = OF) -> DataFrame:
    """a, b, side and node of the nodes that have a candidate at the pair of tiles."""

    def match(key, group):
        side = group["side"].to_numpy()
        marked = np.zeros(len(group), dtype=bool)
        for p, q in candidates(group["n"].to_numpy(), group["bits"].tolist(), None if key[0] == key[1] else side, near, of):
            marked[p] = marked[q] = True
        return group.loc[marked, ["a", "b", "side", "node"]]

    return paired.groupBy("a", "b").applyInPandas(match, "a int, b int, side int, node long")


def sets_of(documents: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node and its sorted hashes (held), for wanted (node, t0, t1). Texts are sifted by a table of SLOTS bits first; what passes
    it by chance is dropped by the join."""
    slot = F.pmod("t0", F.lit(SLOTS))
    bits = wanted.withColumn("_slot", slot).groupBy(F.expr("_slot DIV 64").alias("_at")).agg(F.expr("bit_or(shiftleft(1L, CAST(_slot % 64 AS INT)))").alias("_bits"))
    keyed = text_keys(documents).drop("doc_id").withColumn("_slot", slot).withColumn("_at", F.expr("_slot DIV 64"))
    # broadcast: SLOTS / 64 rows at most
    sifted = keyed.join(F.broadcast(bits), "_at").filter("shiftright(_bits, CAST(_slot % 64 AS INT)) % 2 <> 0").select("t0", "t1", "text")
    schema = pa.schema([("t0", pa.int64()), ("t1", pa.int64()), ("held", pa.binary())])

    def pack(batches):
        for batch in batches:
            for part in slices(batch, 2):
                at, texts = _distinct(part)
                _, first = np.unique(at, return_index=True)
                rows = part.take(pa.array(first))
                yield record_batch(schema, rows.column(0), rows.column(1), [shingle_set(texts[at[i]], size).tobytes() for i in first])

    once = sifted.mapInArrow(pack, "t0 long, t1 long, held binary").groupBy("t0", "t1").agg(F.any_value("held").alias("held"))
    return once.join(wanted, ["t0", "t1"]).select("node", "held")


def verified(n: np.ndarray, held: list[np.ndarray], p: np.ndarray, q: np.ndarray, ranks: np.ndarray, starts: np.ndarray, mark: np.ndarray, near: int, of: int):
    """(i, those j) of the pairs (p, q) with an intersection that suffices, a p at a time."""
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    for a, b in zip(heads, np.append(heads[1:], len(p)), strict=True):
        i, js = int(p[a]), q[a:b]
        own = ranks[starts[i] : starts[i] + n[i]]
        mark[own] = True
        room = np.cumsum(n[js])
        cuts = np.unique(np.r_[0, np.searchsorted(room, np.arange(GATHER, room[-1] + GATHER, GATHER), side="right"), len(js)])
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            some = js[c:d]
            both = np.add.reduceat(mark[ranks[spread(starts[some], n[some])]], np.cumsum(n[some]) - n[some], dtype=np.int64)
            some = some[both * of >= (n[i] + n[some] - both) * near]
            if len(some):
                yield i, some
        mark[own] = False


def exact_links(paired: DataFrame, near: int = NEAR, of: int = OF) -> DataFrame:
    """Of every pair of tiles: rows (a, b, 0) of a spanning forest of its links, and (node, -1, the rows it is linked with)."""

    def match(key, group):
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        held = [np.frombuffer(x, dtype=np.uint64) for x in group["held"]]
        n = np.array([len(x) for x in held], dtype=np.int64)
        starts = np.cumsum(n) - n
        distinct, ranks = np.unique(np.concatenate(held), return_inverse=True)
        ranks, mark = ranks.astype(np.int32), np.zeros(len(distinct), dtype=np.uint8)
        del distinct
        counts, labels, tree = np.zeros(len(n), dtype=np.int64), np.arange(len(n)), []
        side = None if key[0] == key[1] else group["side"].to_numpy()
        for p, q in candidates(n, [bitmap(x).tobytes() for x in held], side, near, of):
            for i, js in verified(n, held, p, q, ranks, starts, mark, near, of):
                counts[i] += copies[js].sum()
                counts[js] += copies[i]
                tree += forest(labels, np.full(len(js), i), js)
        some = np.flatnonzero(counts)
        left, right = node[[i for i, _ in tree]], node[[j for _, j in tree]]
        return pd.DataFrame({"a": np.r_[left, node[some]], "b": np.r_[right, np.full(len(some), -1)], "n": np.r_[np.zeros(len(left), dtype=np.int64), counts[some]]}, dtype="int64")

    return paired.groupBy("a", "b").applyInPandas(match, "a long, b long, n long")


def jaccard_classes(documents: DataFrame, size: int = SHINGLE, near: int = NEAR, of: int = OF, tiles: int = TILES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and n_links (rows that the row is linked with)."""
    spark = documents.sparkSession
    found = stage(sketches(documents, size), "jaccard-sketches")
    distinct = found.filter("n > 0").groupBy("sum0", "sum1").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("t0", "t1")).alias("t"), F.max("n").alias("n"), F.any_value("bits").alias("bits")
    )
    nodes = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    cells = nodes.groupBy(cell_of(F.col("n")).alias("cell")).agg(F.count("*"), F.sum("n"), F.min("n"), F.max("n")).collect()  # by size: 64 rows, and 70 more as it doubles
    plan, spans = plan_tiles([tuple(r) for r in cells], near, of, tiles)
    planned = spark.createDataFrame(plan or [(0, 0, 1)], "cell int, first_tile int, cut int")
    reach = spark.createDataFrame(spans or [(0, 0, 0)], "tile int, first int, last int")
    met = stage(with_candidates(by_tile_pair(nodes.select("node", "n", "bits"), planned, reach), near, of), "jaccard-met")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "copies", "t.t0", "t.t1")
    sets = stage(sets_of(documents, wanted.drop("copies"), size).join(wanted.select("node", "copies"), "node"), "jaccard-sets", codec="none")
    links = stage(exact_links(met.join(sets, "node"), near, of), "jaccard-links")
    roots = components(links.filter("b >= 0").select("a", "b"), "jaccard-roots").withColumnRenamed("node", "_node")
    linked = links.filter("b < 0").groupBy(F.col("a").alias("_of")).agg(F.sum("n").alias("_links"))
    joined = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "sum0", "sum1", "least", "copies", F.coalesce("root", "node").alias("root"))
    names = joined.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("name"))
    named = joined.join(names, "root", "left").join(linked, F.col("node") == F.col("_of"), "left").select(
        "sum0", "sum1", F.when(F.col("name").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("component_id"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    # a frequent set is dealt out over SALTS tasks
    dealt = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.select("doc_id", "n", "sum0", "sum1", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("_salt"))
    full = rows.join(dealt, ["sum0", "sum1", "_salt"], "left")
    out = full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    unstage(met, sets)
    return out


def op11_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
