"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the DEPTH bytes before it. A
node's estimate is Krichevsky-Trofimov's; a node's weighted probability is half its own estimate and half
the product of its children's, so all depths are mixed. The tree is learned from the counts of the
training texts' (DEPTH + 1)-byte strings and then stands still: the probability of a byte is a
function of those bytes, evaluated once for every distinct string in the table.

Strings are grouped by (hashes of) the three bytes before the predicted one. A group computes its part of the tree
from depth five to three; nodes of depth three are summed to depth two on the cluster, and these to depth
one; depths one and zero (256 contexts and the root) meet on the driver. A second look at the groups, each
beside the depth-two nodes of its strings, gives the strings' probabilities. Scoring looks strings and words up in tables of bounded size,
broadcast, that hold the frequent ones; the rest are joined on the cluster.

The text that is scored is the tokens of the base score: words in lower case (A-Z), a blank between
them, and one end mark. Its code length is given in bits (code_bits) and per byte of it (bits_per_byte).

Cases. Null and empty texts are one end token; null ids count as the empty text in the split; repeated
rows count and score each; without training rows every bit costs one bit; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record_batch, slices
from .common import stage
from .learning import held_out

DEPTH = 5
END = b"\n"
#: Rows of the broadcast tables, at most: byte strings and words.
STRINGS, WORDS = 2 << 20, 1 << 18
#: Distinct strings or words that a counting task holds before it hands them on.
HELD = 2_000_000
MODULUS = 7
#: Strings that a group of the tree has, about; all with the same TOP last bytes, 2^24 at most, are in one.
GROUP = 40_000
TOP = 3


# --- texts and byte strings ----------------------------------------------------------------


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def strings_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH + 1)-byte string at every byte of the texts, and the bytes of each text.

    A string is an integer: the latest context byte on top, the oldest above the predicted byte.
    """
    bodies = [b" ".join(w) + END for w in docs]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    pad = END * DEPTH
    a = np.frombuffer(b"".join([x for b in bodies for x in (pad, b)]), dtype=np.uint8)
    out = a[DEPTH:].astype(np.int64)
    for d in range(1, DEPTH + 1):
        out |= a[DEPTH - d : len(a) - d].astype(np.int64) << (8 * (DEPTH + 1 - d))
    keep = np.ones(len(out), dtype=bool)
    stops = np.cumsum(sizes + DEPTH) - DEPTH  # in out, texts are a pad apart
    for k in range(DEPTH):
        keep[(stops + k)[:-1]] = False
    return out[keep], sizes


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts' sums."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


COUNTS = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def corpus_counts(documents: DataFrame) -> DataFrame:
    """gram or word, and n: how often the training rows have it. Strings of other rows are there with 0."""

    def count(batches):
        words: Counter = Counter()
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def grams():
            keys, n = tally(np.concatenate([k for k, _ in pending]), np.concatenate([c for _, c in pending]))
            pending[:] = [(keys, n)]
            return keys, n

        def emit_words():
            if words:
                yield record_batch(COUNTS, pa.nulls(len(words), pa.int64()), list(words), list(words.values()))
                words.clear()

        def emit_grams():
            if pending:
                keys, n = grams()
                pending.clear()
                yield record_batch(COUNTS, keys, pa.nulls(len(keys), pa.binary()), n)

        for batch in batches:
            for part in slices(batch, 1, limit=2 << 20):
                docs = [tokens(t) for t in part.column(1).to_pylist()]
                train = ~np.array(part.column(0).to_pylist(), dtype=bool)
                for w, t in zip(docs, train, strict=True):
                    if t:
                        words.update(w)
                        words[END] += 1
                every, sizes = strings_of(docs)
                mine = np.repeat(train, sizes)
                pending.append(tally(every[mine]))
                keys = tally(every[~mine])[0]
                pending.append((keys, np.zeros(len(keys), dtype=np.int64)))
                if sum(len(k) for k, _ in pending) > HELD and len(grams()[0]) > HELD // 2:
                    yield from emit_grams()
                if len(words) > HELD // 4:
                    yield from emit_words()
        yield from emit_grams()
        yield from emit_words()

    texts = documents.select(held_out(F.col("doc_id"), MODULUS).alias("held"), "text")
    return texts.mapInArrow(count, "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


# --- the tree ------------------------------------------------------------------------------


_SMALL = 4096
_HALVES = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(counts: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(counts + shift): from the table, or Stirling's series for large counts."""
    out = table[np.minimum(counts, _SMALL - 1).astype(np.int64)]
    large = counts >= _SMALL
    if large.any():
        y = counts[large] + shift
        out[large] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability (log) of a sequence with so many zeros and ones."""
    return _log_gamma(zeros, _HALVES, 0.5) + _log_gamma(ones, _HALVES, 0.5) - np.log(np.pi) - _log_gamma(zeros + ones, _WHOLES, 1.0)


def half_half(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - np.log(2)


class Level:
    """Nodes of one depth for one bit: sorted keys, counts, estimates and weighted probabilities (log)."""

    def __init__(self, keys, zeros, ones, below=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_estimate(zeros, ones)
        self.weighted = own if below is None else half_half(own, below)
        #: The share of the node's own estimate in its mixture.
        self.share = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.weighted)

    def mixed(self, keys: np.ndarray, bit: np.ndarray, below: np.ndarray | None) -> np.ndarray:
        """P(bit) at the nodes with these keys; below: what deeper contexts say."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        if below is None:
            below = np.full(len(keys), 0.5)
        if not seen.any():
            return np.where(seen, 0.0, 0.25 + 0.5 * below)
        ones = (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        own = np.where(bit == 1, ones, 1 - ones)
        return np.where(seen, self.share[at] * own + (1 - self.share[at]) * below, 0.25 + 0.5 * below)


def levels(grams: np.ndarray, counts: np.ndarray, bit: int, top: int = TOP) -> dict[int, Level]:
    """The nodes of depths top..DEPTH that decide the given bit (0: the highest)."""
    byte = grams & 255
    node = (1 << bit) | (byte >> (8 - bit))
    one = (byte >> (7 - bit)) & 1
    keys = (grams >> 8 << 8) | node
    order = np.argsort(keys, kind="stable")
    keys, n, one = keys[order], counts[order].astype(np.float64), one[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    add = lambda x, at: np.add.reduceat(x, at) if len(at) else x[:0]
    out = {DEPTH: Level(keys[first], add(n * (1 - one), first), add(n * one, first))}
    for depth in range(DEPTH - 1, top - 1, -1):
        last = out[depth + 1]
        up = (last.keys >> 16 << 8) | (last.keys & 255)  # without the oldest byte
        order = np.argsort(up, kind="stable")
        up = up[order]
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]]) if len(up) else np.zeros(0, dtype=np.int64)
        out[depth] = Level(up[first], add(last.zeros[order], first), add(last.ones[order], first), add(last.weighted[order], first))
    return out


def group_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of depth TOP of a group, those of strings without a count too: they have counts of 0 and weigh nothing."""
    grams, counts = frame["gram"].to_numpy(), frame["n"].to_numpy()
    tops = [levels(grams, counts, bit)[TOP] for bit in range(8)]
    return pd.DataFrame({"key": np.concatenate([t.keys for t in tops]), **{k: np.concatenate([getattr(t, k) for t in tops]) for k in ("zeros", "ones", "weighted")}})


def weigh(frames):
    """The sums of depth-three nodes, as nodes of depth two."""
    for frame in frames:
        level = Level(*[frame[k].to_numpy() for k in ("pair", "zeros", "ones", "below")])
        yield pd.DataFrame({"pair": level.keys, "zeros": level.zeros, "ones": level.ones, "weighted": level.weighted, "share": level.share})


class Crown:
    """Depths 0 and 1 of all eight trees, in arrays of 256 x 256 (last byte, node)."""

    def __init__(self, rows):
        self.zeros, self.ones = np.zeros((257, 256)), np.zeros((257, 256))
        below = np.zeros((257, 256))
        for r in rows:
            self.zeros[r["c"], r["node"]], self.ones[r["c"], r["node"]], below[r["c"], r["node"]] = r["zeros"], r["ones"], r["weighted"]
        root = 256
        self.zeros[root], self.ones[root] = self.zeros[:256].sum(axis=0), self.ones[:256].sum(axis=0)
        own = log_estimate(self.zeros, self.ones)
        weighted = half_half(own, below)
        below[root] = weighted[:256].sum(axis=0)
        weighted[root] = half_half(own[root], below[root])
        self.share = np.exp(own - np.log(2) - weighted)

    def mixed(self, context: np.ndarray | int, node: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
        ones = (self.ones[context, node] + 0.5) / (self.zeros[context, node] + self.ones[context, node] + 1)
        share = self.share[context, node]
        return share * np.where(bit == 1, ones, 1 - ones) + (1 - share) * below


def probabilities(grams: np.ndarray, counts: np.ndarray, parents: pd.DataFrame, crown: Crown) -> np.ndarray:
    """log10 P(byte | context) of the strings of one group; parents: for each of its nodes of depth TOP the one above."""
    out = np.zeros(len(grams))
    byte, last = grams & 255, grams >> (8 * DEPTH)
    parents = parents.sort_values("key")
    keys, zeros, ones, share = (parents[k].to_numpy() for k in ("key", "zeros", "ones", "share"))
    for bit in range(8):
        tree = levels(grams, counts, bit)
        node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
        p = None
        for depth in range(DEPTH, TOP - 1, -1):
            at = (grams >> (8 * (DEPTH - depth + 1)) << 8) | node
            p = tree[depth].mixed(at, one, p)
        up = np.searchsorted(keys, at)
        own = (ones[up] + 0.5) / (zeros[up] + ones[up] + 1)
        p = share[up] * np.where(one == 1, own, 1 - own) + (1 - share[up]) * p
        p = crown.mixed(last, node, one, p)
        out += np.log10(crown.mixed(256, node, one, p))
    return out


_NODE = "zeros double, ones double, weighted double"


def string_probabilities(counts: DataFrame, size: int = GROUP) -> DataFrame:
    """gram, n and the log10 probability (double) of its last byte after the others; groups hold about `size` strings."""
    grams = counts.filter("gram IS NOT NULL").select("gram", "n")
    groups = min(1 << 20, 1 + grams.count() // size)
    group_of = lambda key: F.pmod(F.xxhash64(key), F.lit(groups))
    grams = grams.withColumn("group", group_of(F.shiftright("gram", 8 * (DEPTH + 1 - TOP))))
    spark = counts.sparkSession
    # without the oldest byte of context; the low byte is the node
    pair = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    nodes = stage(grams.groupBy("group").applyInPandas(lambda key, frame: group_nodes(frame), f"key long, {_NODE}").withColumn("pair", pair), "lm-nodes")
    sums = nodes.groupBy("pair").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    twos = stage(sums.mapInPandas(weigh, f"pair long, {_NODE}, share double"), "lm-twos")
    last, node = F.shiftright("pair", 16).cast("int"), F.col("pair").bitwiseAND(F.lit(255)).cast("int")
    rows = twos.groupBy(last.alias("c"), node.alias("node")).agg(*[F.sum(k).alias(k) for k in ("zeros", "ones", "weighted")]).collect()  # 256 x 255 at most
    crown = spark.sparkContext.broadcast(Crown(rows))
    parents = nodes.select("key", "pair").join(twos.drop("weighted"), "pair").select(group_of(F.shiftright("key", 8)).alias("group"), "key", "zeros", "ones", "share")

    def evaluate(key, frame, above):
        grams, n = frame["gram"].to_numpy(), frame["n"].to_numpy()
        return pd.DataFrame({"gram": grams, "n": n, "logp": probabilities(grams, n, above, crown.value)})

    return grams.groupBy("group").cogroup(parents.groupBy("group")).applyInPandas(evaluate, "gram long, n long, logp double")


def string_table(counts: DataFrame) -> DataFrame:
    """string_probabilities in single precision."""
    return string_probabilities(counts).withColumn("logp", F.col("logp").cast("float"))


# --- scores --------------------------------------------------------------------------------


class Lookup:
    """A hash table from integers to numbers in two arrays; absent keys give NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(1.6 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, np.nan, dtype=np.float32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several, one stays
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = self.values[at].astype(np.float64)
        off = np.flatnonzero(found != keys)
        out[off] = np.nan
        off = off[found[off] != -1]
        at = at[off]
        while len(off):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[off]
            out[off[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            off, at = off[more], at[more]
        return out


_BUILT: dict[str, tuple] = {}


def _tables(shared, key: str):
    """The lookups of this worker process, built once."""
    if key not in _BUILT:
        _BUILT.clear()
        keys, values, words, logs = shared.value
        _BUILT[key] = (Lookup(keys, values), dict(zip(words.to_pylist(), logs.tolist(), strict=True)))
    return _BUILT[key]


def frequent(table: DataFrame, most: int) -> int:
    """The least n (0, 1 or a power of two) such that at most `most` rows have as much."""
    steps = [0, *(1 << j for j in range(50))]
    row = table.agg(*[F.count(F.when(F.col("n") >= s, 1)).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    return next((s for i, s in enumerate(steps) if row[i] <= most), 1 << 60)


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
     ("rare_words", pa.list_(pa.binary())), ("rare_grams", pa.list_(pa.int64()))]
)
_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, rare_words array<binary>, rare_grams array<long>"


def score(documents: DataFrame, strings: int = STRINGS, most_words: int = WORDS) -> DataFrame:
    spark = documents.sparkSession
    counts = stage(corpus_counts(documents), "lm-counts")
    words = counts.filter("word IS NOT NULL").select("word", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    table = stage(string_table(counts), "lm-strings")
    gram_least, word_least = frequent(table, strings), frequent(words, most_words)
    # Arrow all the way: rows as Python objects would take the driver ten times the memory
    top = table.filter(F.col("n") >= gram_least).select("gram", "logp").toArrow()
    common = words.filter(F.col("n") >= word_least).toArrow()
    parts = (top["gram"].to_numpy(), top["logp"].to_numpy(), common["word"].combine_chunks(), np.log10(common["n"].to_numpy() + 1.0))
    del top, common
    shared = spark.sparkContext.broadcast(parts)
    del parts
    key = uuid.uuid4().hex

    def run(batches):
        lookup, known = _tables(shared, key)
        get = known.get
        for batch in batches:
            for part in slices(batch, 2, limit=2 << 20):
                docs = [tokens(t) for t in part.column(2).to_pylist()]
                every, sizes = strings_of(docs)
                logp = lookup.get(every)
                lost = np.isnan(logp)
                starts = np.cumsum(sizes) - sizes
                sums = np.add.reduceat(np.where(lost, 0.0, logp), starts)
                missing = [every[a:b][lost[a:b]].tolist() if any_lost else [] for a, b, any_lost in zip(starts, starts + sizes, np.logical_or.reduceat(lost, starts), strict=True)]
                n, n_known, base, rare = [], [], [], []
                for w in docs:
                    w.append(END)
                    found = list(map(get, w))
                    if None in found:
                        rare.append([x for x, v in zip(w, found, strict=True) if v is None])
                        found = [v for v in found if v is not None]
                    else:
                        rare.append([])
                    n.append(len(w))
                    n_known.append(len(found))
                    base.append(sum(found))
                yield record_batch(SCORED, part.column(0), part.column(1), n, n_known, sizes, base, sums, rare, missing)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), MODULUS).alias("held_out"), "text")
    done = stage(texts.mapInArrow(run, _DDL).withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    # words without a count add nothing to either sum
    more_words = (
        done.select("uid", F.explode("rare_words").alias("word"))
        .join(words.filter(F.col("n") < word_least), "word")
        .groupBy("uid")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("more_base"), F.count("*").alias("more_known"))
    )
    more_grams = (
        done.select("uid", F.explode("rare_grams").alias("gram"))
        .join(table.filter(F.col("n") < gram_least).select("gram", "logp"), "gram")
        .groupBy("uid")
        .agg(F.sum(F.col("logp").cast("double")).alias("more_score"))
    )
    total = float(np.log10(size["n"] + size["v"] + 1))
    zero = F.lit(0.0)
    return done.join(more_words, "uid", "left").join(more_grams, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(size["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
        (-(F.col("score") + F.coalesce("more_score", zero)) * float(np.log2(10))).alias("code_bits"),
        "n_bytes",
    ).withColumn("bits_per_byte", F.col("code_bits") / F.col("n_bytes"))


def op5_context_tree(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
