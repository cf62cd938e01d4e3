"""SimHash near-duplicate classes by tiled exact comparison.

Every text gets a 64-bit fingerprint (a majority vote over the XXH64 of its word shingles).
Distinct fingerprints are dealt into tiles of near population count; a task takes one pair of
tiles, compares all their fingerprints by exclusive-or and bit counts in numpy, and returns a
spanning forest of the links it found, so a group of n near copies gives n - 1 links per tile pair
and not n^2. Tile pairs whose population counts differ by more than the radius are not made. The
classes are the connected components of the links, found in rounds on the cluster.

The comparison is exact and so quadratic in the number of distinct fingerprints. A tile holds at most TILE of
them, so a task compares at most TILE^2 pairs; a table is cut into about TILES tiles until these are full. Up to
TILES * TILE distinct fingerprints the rows shuffled grow with the table, beyond that with its square, as the
comparisons do throughout.

The pipeline's copies (one_of_each) are texts whose sets of five words have a Jaccard similarity of 0.8 or more.
Candidates are found by the same comparison, over fingerprints of 256 bits within a radius that pairs at 0.8 hardly
ever pass (unequal sets of fewer than four shingles can't be similar enough, and sizes must be). What leaves a pair of tiles
are the nodes that have a candidate in it, not the pairs; the sets of these (as sorted 64-bit hashes) are sent to the pair of tiles, where candidates are found
again and intersected exactly, as far as no link found before connects them; a spanning forest of the links leaves
it. So rows grow with the nodes, however large a group of similar texts is. A tile of large sets holds fewer of
them, so that a task holds TILE_SHINGLES a side at most (or one larger set).

Cases. Null text is empty: fingerprint zero, linked like any other; rows with a null id belong to
classes but never name them (a class without ids has a null name); repeated rows share their class;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import free_name, record_batch, slices
from .common import stage, unstage

SHINGLE = 4
SEED = 42
RADIUS = 4
TILES, TILE = 24, 44_000


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of lower-cased words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]


#: Odd factors that make further independent words of a fingerprint from one hash.
_FACTORS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def majority(hashes: np.ndarray, parts: int = 1) -> list[int]:
    """The bits set in over half the hashes; words after the first mix the hashes anew."""
    if not len(hashes):
        return [0] * parts
    out = []
    for k in range(parts):
        mixed = hashes
        if k:
            mixed = hashes * np.uint64(_FACTORS[k])
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_FACTORS[1])
            mixed = mixed ^ (mixed >> np.uint64(29))
        cells = mixed.astype(">u8").view(np.uint8).reshape(-1, 8)
        votes = np.zeros(64, dtype=np.int64)
        for a in range(0, len(cells), 4096):
            votes += np.unpackbits(cells[a : a + 4096], axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed integer, print0."""
    schema = pa.schema([("doc_id", pa.int64()), ("print0", pa.int64())])

    def build(batches):
        for batch in batches:
            for part in slices(batch, 1):
                prints = [majority(np.array(shingle_hashes(t, size), dtype=np.uint64))[0] for t in part.column(1).to_pylist()]
                yield record_batch(schema, part.column(0), np.array(prints, dtype=np.uint64).view(np.int64))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(build, "doc_id long, print0 long")


def tiles_for(counts: dict[tuple[int, int], int], radius: int, tiles: int = TILES, most=None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(band, population count, first tile, tiles) of a plan, and the spans (tile, low, high) of tiles that each meets.

    counts: fingerprints by (band, population count). Tiles are numbered by band, then by population count, so those
    within reach of one (itself and later ones of its band, and some of the next band) are neighbours by number.
    most: how many a tile of a band may hold, if less than that.
    """
    whole = min(TILE, max(1, -(-sum(counts.values()) // tiles)))
    plan: list[tuple[int, int, int, int]] = []
    bands: dict[int, tuple[int, list[int], list[int]]] = {}  # band: its first tile, the least and the greatest count of each
    number, room = -1, 0
    for band, bits in sorted(counts):
        n = counts[band, bits]
        size = whole if most is None else max(1, min(whole, most(band)))
        if band not in bands:
            bands[band], room = (number + 1, [], []), 0
        _, low, top = bands[band]
        if n <= room:
            plan.append((band, bits, number, 1))
            room -= n
            top[-1] = bits
            continue
        cut = -(-n // size)
        plan.append((band, bits, number + 1, cut))
        low += [bits] * cut
        top += [bits] * cut
        number += cut
        room = size - n if cut == 1 else 0
    spans = []
    for band, (first, low, top) in bands.items():
        for i in range(len(low)):
            spans.append((first + i, first + i, first + bisect_right(low, top[i] + radius) - 1))
            if band + 1 in bands:
                start, lows, tops = bands[band + 1]
                a, b = bisect_left(tops, low[i] - radius), bisect_right(lows, top[i] + radius) - 1
                if a <= b:
                    spans.append((first + i, start + a, start + b))
    return plan, spans


def forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Joins the classes of the pairs in labels (changed in place, each class by its least member)
    and returns the pairs that joined two classes."""
    apart = labels[left] != labels[right]
    left, right = left[apart], right[apart]
    if not len(left):
        return []
    keys = labels[left].astype(np.int64) * len(labels) + labels[right]
    _, first = np.unique(keys, return_index=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    for i, j in zip(left[first].tolist(), right[first].tolist(), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))
    moved = np.arange(len(labels))
    for x in parent:
        moved[x] = root(x)
    labels[:] = moved[labels]
    return links


def near_pairs(prints: np.ndarray, second: np.ndarray | None, radius: int, first_radius: int, keep=None, rows: int = 128, columns: int = 4096):
    """Arrays (i, j, distance) of pairs within the radius: of prints with themselves or, behind them, with second.

    prints: (n, words). Only pairs within first_radius by the first word, that keep(i, j) lets pass, are compared whole.
    """
    own = second is None
    every = prints if own else np.concatenate([prints, second])
    head = np.ascontiguousarray(every[:, 0])
    bits = np.bitwise_count(head).astype(np.int16)
    first = np.argsort(bits[: len(prints)], kind="stable")
    other = first if own else len(prints) + np.argsort(bits[len(prints) :], kind="stable")
    for a in range(0, len(first), rows):
        i = first[a : a + rows]
        x = head[i][:, None]
        for b in range(a // columns * columns if own else 0, len(other), columns):
            j = other[b : b + columns]
            if bits[j[0]] > bits[i[-1]] + first_radius or bits[j[-1]] < bits[i[0]] - first_radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x ^ head[j]) <= first_radius)
            if own:  # each pair once
                later = a + p < b + q
                p, q = p[later], q[later]
            p, q = i[p], j[q]
            if keep is not None and len(p):
                some = keep(p, q)
                p, q = p[some], q[some]
            if not len(p):
                continue
            far = np.bitwise_count(every[p] ^ every[q]).sum(axis=1, dtype=np.int32)
            near = far <= radius
            if near.any():
                yield p[near], q[near], far[near]


def compare(prints: np.ndarray, second: np.ndarray | None, radius: int, first_radius: int, **how) -> list[tuple[int, int]]:
    """Links (indexes into prints, then into second behind them) that span what the tiles' matches connect."""
    labels, found = np.arange(len(prints) + (0 if second is None else len(second))), []
    for p, q, _ in near_pairs(prints, second, radius, first_radius, lambda p, q: labels[p] != labels[q], **how):
        found += forest(labels, p, q)
    return found


def similar_sizes(n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (n[p] * OF >= n[q] * NEAR) & (n[q] * OF >= n[p] * NEAR)


def tiled(prints: DataFrame, radius: int, work, ddl: str, carried: tuple[str, ...] = (), tiles: int = TILES, banded: bool = False) -> DataFrame:
    """What work() makes of every pair of tiles that may hold fingerprints within the radius by their first words.

    prints: distinct fingerprints print0, ..., a number `node`, and what is carried; banded: only those whose sizes n
    may make a similarity of NEAR / OF meet. work(cells, second, columns, key) gets the fingerprints of one tile and
    of the other (None: one tile with itself), arrays of both and the tiles' numbers.
    """
    return at_tile_pairs(by_tile_pair(prints, radius, carried, tiles, banded), carried, work, ddl)


def by_tile_pair(prints: DataFrame, radius: int, carried: tuple[str, ...] = (), tiles: int = TILES, banded: bool = False) -> DataFrame:
    """The fingerprints at every pair of tiles (a, b) that theirs is in: side 0 as a, side 1 as b."""
    spark = prints.sparkSession
    words = [c for c in prints.columns if c.startswith("print")]
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / NEAR))).cast("int") if banded else F.lit(0)
    prints = prints.withColumn("band", band).withColumn("bits", F.bit_count("print0"))
    counted = prints.groupBy("band", "bits").count().collect()  # 65 rows a band at most, and 4 bands as a size doubles
    most = (lambda k: int(TILE_SHINGLES / (OF / NEAR) ** (k + 1))) if banded else None
    plan, spans = tiles_for({(r["band"], r["bits"]): r["count"] for r in counted}, radius, tiles, most)
    table = spark.createDataFrame(plan or [(0, 0, 0, 1)], "band int, bits int, first int, cut int")
    reach = spark.createDataFrame(spans or [(0, 0, 0)], "tile int, low int, high int")
    dealt = prints.join(F.broadcast(table), ["band", "bits"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64(*words), F.col("cut")).cast("int"))
    own = ["node", *words, *carried]
    # a tile meets itself and the later ones in its spans; each later one is met by all in whose spans it is
    heads = dealt.join(F.broadcast(reach), "tile").select(F.col("tile").alias("a"), F.explode(F.sequence("low", "high")).alias("b"), *own, F.lit(0).alias("side"))
    every = reach.groupBy().agg(F.collect_list(F.struct("tile", "low", "high")).alias("spans"))
    met = F.filter("spans", lambda s: (s["tile"] != F.col("tile")) & (s["low"] <= F.col("tile")) & (s["high"] >= F.col("tile")))["tile"]
    tails = dealt.crossJoin(F.broadcast(every)).select(F.explode(met).alias("a"), F.col("tile").alias("b"), *own, F.lit(1).alias("side"))

    return heads.unionByName(tails)


def at_tile_pairs(paired: DataFrame, carried: tuple[str, ...], work, ddl: str) -> DataFrame:
    """What work() makes of each pair of tiles."""
    words = [c for c in paired.columns if c.startswith("print")]

    def match(key, group):
        side = group["side"].to_numpy()
        order = np.concatenate([np.flatnonzero(side == 0), np.flatnonzero(side == 1)])
        columns = {c: group[c].to_numpy()[order] for c in ("node", *carried)}
        cells = np.ascontiguousarray(group[words].to_numpy()[order]).view(np.uint64)
        n, alone = int((side == 0).sum()), key[0] == key[1]
        if not n or not (alone or n < len(cells)):
            return work(cells[:0], None, {c: v[:0] for c, v in columns.items()}, key)
        return work(cells[:n], None if alone else cells[n:], columns, key)

    return paired.groupBy("a", "b").applyInPandas(match, ddl)


def links(prints: DataFrame, radius: int = RADIUS, tiles: int = TILES) -> DataFrame:
    """Pairs of nodes (a, b) within the radius whose components are those of all such pairs. prints: distinct, with a number `node`."""

    def work(cells, second, columns, key):
        found, node = compare(cells, second, radius, radius), columns["node"]
        return pd.DataFrame({"a": node[[i for i, _ in found]], "b": node[[j for _, j in found]]}, dtype="int64")

    return tiled(prints, radius, work, "a long, b long", tiles=tiles)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node and root (the least node that it reaches) for the nodes of edges (a, b), in the shared folder.

    Rounds of two star contractions: every node's larger neighbours, then its smaller ones, are
    linked to the least node around it. Each round is written to the shared folder.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stage(small, name)
        unstage(before)
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    roots = stage(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    unstage(now)
    return roots


def near_duplicates(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS, tiles: int = TILES) -> DataFrame:
    """doc_id, the fingerprint print0 (signed) and component_id: the least doc_id that the document reaches."""
    prints = stage(fingerprints(documents, size), "prints")
    distinct = prints.groupBy("print0").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = stage(distinct, "prints-distinct")
    roots = components(links(distinct.drop("least"), radius, tiles), "print-links").withColumnRenamed("node", "_node")
    joined = distinct.join(roots, F.col("node") == F.col("_node")).select("node", "least", "root")
    names = joined.groupBy("root").agg(F.min("least").alias("name"))
    named = distinct.join(joined.join(names, "root").select("node", "name"), "node", "left").select("print0", F.coalesce("name", "least").alias("component_id"))
    # a frequent fingerprint (that of empty texts, say) is dealt out over SALTS tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    dealt = named.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return prints.withColumn("_salt", salt).join(dealt, ["print0", "_salt"]).select("doc_id", "print0", "component_id")


#: Copies are texts whose sets of five words have a Jaccard similarity of NEAR / OF or more.
COPY, NEAR, OF = 5, 4, 5
#: Sets with fewer shingles are similar enough to equal ones alone.
LEAST = NEAR
#: Words of 64 bits in a fingerprint. At a similarity of 0.8 fingerprints differ in some 39 of 256
#: bits (standard deviation 6), in 48 at worst (four shingles of five); the first words in 10 to 12 of 64.
PARTS = 4
WIDE, WIDE_FIRST = 72, 22
SLOTS = 1 << 24
#: Shingles of the sets of a tile; members of sets that are looked up at once.
TILE_SHINGLES, GATHER = 2_500_000, 2_000_000
#: Tasks over which rows with one fingerprint are dealt.
SALTS = 8


def shingle_set(text: str | None, size: int = COPY) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def sketches(rows: DataFrame, size: int = COPY) -> DataFrame:
    """For each row its set's 128-bit checksum (sum0, sum1), its size n and its fingerprint."""
    names = ["sum0", "sum1", "n", *[f"print{k}" for k in range(PARTS)]]
    schema = pa.schema([("row", pa.int64()), *[(c, pa.int64()) for c in names]])

    def sketch(text):
        found = shingle_set(text, size)
        digest = xxhash.xxh3_128_intdigest(found.tobytes())
        return np.array([digest >> 64, digest & (1 << 64) - 1, len(found), *majority(found, PARTS)], dtype=np.uint64).view(np.int64)

    def build(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield record_batch(schema, part.column(0), *np.array([sketch(t) for t in part.column(1).to_pylist()]).T)

    return rows.select("row", "text").mapInArrow(build, "row long, " + ", ".join(f"{c} long" for c in names))


def with_candidates(nodes: DataFrame) -> DataFrame:
    """Of the nodes at every pair of tiles those that have a candidate there, with their fingerprints."""
    words = [f"print{k}" for k in range(PARTS)]

    def work(cells, second, columns, key):
        marked = np.zeros(len(columns["node"]), dtype=bool)
        for p, q, _ in near_pairs(cells, second, WIDE, WIDE_FIRST, lambda p, q: similar_sizes(columns["n"], p, q)):
            marked[p] = marked[q] = True
        every = cells if second is None else np.concatenate([cells, second])
        prints = every.view(np.int64)[marked]
        side = (np.arange(len(every)) >= len(cells))[marked].astype(np.int32)
        out = {"a": key[0], "b": key[1], "side": side, "node": columns["node"][marked], "n": columns["n"][marked]}
        return pd.DataFrame(out | {c: prints[:, k] for k, c in enumerate(words)})

    narrow = nodes.select("node", "n", *words)
    return tiled(narrow, WIDE_FIRST, work, "a int, b int, side int, node long, n long, " + ", ".join(f"{c} long" for c in words), ("n",), banded=True)


class Overlaps:
    """Sizes of the intersections of one set with others, from the ranks of all their members."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        self.starts = np.cumsum(self.n) - self.n
        distinct, ranks = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_inverse=True)
        self.ranks, self.mark = ranks.astype(np.int32), np.zeros(len(distinct), dtype=np.uint8)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are similar enough to set i; GATHER members are looked up at once."""
        own = self.ranks[self.starts[i] : self.starts[i] + self.n[i]]
        self.mark[own] = 1
        found, room = [], np.cumsum(self.n[others])
        cuts = np.unique(np.r_[0, np.searchsorted(room, np.arange(GATHER, room[-1] + GATHER, GATHER), side="right"), len(others)])
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            some = others[c:d]
            ends = np.cumsum(self.n[some])
            at = np.repeat(self.starts[some] - ends + self.n[some], self.n[some]) + np.arange(ends[-1])
            both = np.add.reduceat(self.mark[self.ranks[at]], ends - self.n[some], dtype=np.int64)
            found.append(some[both * OF >= (self.n[i] + self.n[some] - both) * NEAR])
        self.mark[own] = 0
        return np.concatenate(found)


def verified_links(met: DataFrame) -> DataFrame:
    """Links (a, b) that span what the candidates at each pair of tiles connect whose sets (held) are similar enough."""

    def work(cells, second, columns, key):
        node, out = columns["node"], []
        sets = Overlaps([np.frombuffer(x, dtype=np.uint64) for x in columns["held"]])
        labels = np.arange(len(node))
        apart = lambda p, q: (labels[p] != labels[q]) & similar_sizes(columns["n"], p, q)
        for p, q, _ in near_pairs(cells, second, WIDE, WIDE_FIRST, apart):
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            for a, b in zip(heads, np.append(heads[1:], len(p)), strict=True):
                i, others = int(p[a]), q[a:b]
                others = others[labels[others] != labels[i]]  # links of this block may connect them by now
                if len(others):
                    near = sets.similar(i, others)
                    out += forest(labels, np.full(len(near), i), near)
        return pd.DataFrame({"a": node[[i for i, _ in out]], "b": node[[j for _, j in out]]}, dtype="int64")

    return at_tile_pairs(met, ("n", "held"), work, "a long, b long")


def sifted(rows: DataFrame, key: str, named: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the keys `of` in named, and those whose key surely isn't, by a table of SLOTS bits that is broadcast."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bits = named.withColumn("_slot", slot(of)).groupBy(F.expr("_slot DIV 64").alias("_at")).agg(F.expr("bit_or(shiftleft(1L, CAST(_slot % 64 AS INT)))").alias("_bits"))
    met = rows.withColumn("_slot", slot(key)).withColumn("_at", F.expr("_slot DIV 64")).join(F.broadcast(bits), "_at", "left")
    hit = F.coalesce(F.expr("shiftright(_bits, CAST(_slot % 64 AS INT)) % 2 <> 0"), F.lit(False))
    return met.filter(hit).select(*rows.columns), met.filter(~hit).select(*rows.columns)


def named_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose number `row` is in named, exchanging hardly more than these."""
    some, _ = sifted(rows, "row", named, "row")
    return some.join(named, "row", "left_semi")


def sets_of(rows: DataFrame, used: DataFrame, size: int = COPY) -> DataFrame:
    """row and its set (held, sorted hashes) for the rows in used, in the shared folder."""

    def pack(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, size).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["row", "held"])

    return stage(named_rows(rows.select("row", "text"), used).mapInArrow(pack, "row long, held binary"), "copy-sets", codec="none")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, for pairs that a caller names (each brings both its sets along)."""

    def check(batches):
        for batch in batches:
            near = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(both * OF >= (len(p) + len(q) - both) * NEAR)
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    # only sets that the pairs need are exchanged
    left = sets.select(F.col("row").alias("a"), F.col("held").alias("p")).join(pairs.select("a").distinct(), "a", "left_semi")
    right = sets.select(F.col("row").alias("b"), F.col("held").alias("q")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = pairs.join(left, "a").join(right, "b")
    return stage(both.select("a", "b", "p", "q").mapInArrow(check, "a long, b long"), "copy-pairs")


def copies(rows: DataFrame, size: int = COPY) -> DataFrame:
    """row and class, the same for rows that verified pairs connect; in the shared folder.

    rows: texts with a number `row` of their own. Equal sets are one node (the least row), so only different sets are paired.
    """
    found = stage(sketches(rows, size), "copy-sketches")
    equal = stage(found.groupBy("sum0", "sum1").agg(F.min("row").alias("node")), "copy-nodes")
    nodes = found.filter(F.col("n") >= LEAST).drop("sum0", "sum1").join(equal.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    met = stage(with_candidates(nodes), "copy-candidates")
    sets = sets_of(rows, met.select(F.col("node").alias("row")).distinct(), size)
    links = stage(verified_links(met.join(sets.withColumnRenamed("row", "node"), "node")), "copy-links")
    unstage(met, sets)
    roots = components(links, "copy-roots")
    classes = equal.join(roots, "node", "left").select("sum0", "sum1", F.coalesce("root", "node").alias("class"))
    done = stage(found.select("row", "sum0", "sum1").join(classes, ["sum0", "sum1"]).select("row", "class"), "copy-classes")
    unstage(found, equal, links, roots)
    return done


def one_of_each(documents: DataFrame, size: int = COPY) -> DataFrame:
    """documents without near copies: of each class one row stays, that with the least doc_id (a null one comes last)."""
    number = free_name(documents, "row")
    rows = stage(documents.withColumn(number, F.monotonically_increasing_id()), "copy-rows")
    plain = rows.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = copies(plain, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = classes.join(plain.select("row", "doc_id"), "row").groupBy("class").agg(first.alias("row"))
    gone = stage(classes.join(kept, "row", "left_anti").select(F.col("row").alias("_gone")), "copy-gone")
    unstage(classes)
    # texts that surely stay are not exchanged
    some, rest = sifted(rows, number, gone, "_gone")
    return rest.unionByName(some.join(gone, F.col(number) == F.col("_gone"), "left_anti")).select(*documents.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("print0")), 16, "0").alias("fingerprint"), "component_id")
