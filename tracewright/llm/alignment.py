"""Alignment of two tokenizers' tokens over the same bytes, and the corpus-wide counts of aligned id pairs.

Both tokenizers' tokens tile space + text. NumPy works on a batch's tokens in one stream: cumsum gives their ends,
intersect1d the ends that both have (common cuts, texts' ends among them), searchsorted the group that a token is in,
and its overlapping tokens of the other side; repeat expands these to links. Token ids come from the batches' distinct
chunks (token_records.Encoder; PieceEncoder for sentencepiece), cut where either tokenizer surely ends a token.

A batch is a block: its table of distinct id pairs and, for every text, places in that table with counts (as bytes) are
staged, so texts are encoded once. Counts of pairs are summed over blocks in two stages, by pair and salt and then by
pair; the totals go back to the salted pairs, to the blocks and, with a block's texts, to a group of bounded size. No row
is made for a link, nor for a pair of a text. A text longer than PIECE is aligned in pieces that end where both
tokenizers surely end a token (without such a place, whole).

Cases. Texts that are null, empty or not restored by a tokenizer's tokens (U+2581 in a text, say) have no tokens: zeros,
and an empty checksum; rows with a null id, repeated rows and equal texts count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .common import stage
from .token_records import Encoder, default_tokenizer, spread

#: Text in a block and rows in it, at most; text aligned at once.
BLOCK, BLOCK_ROWS, PIECE = 3 << 20, 1 << 15, 2 << 20
#: Tasks over which the blocks' counts of one pair are dealt.
SALTS = 32
#: What stands for a space in pieces.
SPACE = "\u2581"
#: Bits of an id in a pair's key; a text's number in its block has the other 15.
ID_BITS = 24


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the
    others, in order, for 256 and up."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder(Encoder):
    """A byte-level vocabulary; strings of special tokens are plain text. tokens: the bytes of every id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model.encode_special_tokens = True
        self.special = []
        table = byte_level()
        vocabulary = self.model.get_vocab()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


class PieceEncoder(Encoder):
    """A sentencepiece vocabulary, for texts that begin with the space which it adds itself.

    If no piece has a space behind another character, nor a line end in it, tokens end before every space behind
    another character and around line ends: chunks are cut there. A chunk is encoded behind a line end, so that no space is
    added to it. Other vocabularies, and those that normalise, get texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.leads = np.array([p[0] == SPACE for p in pieces])
        self.before = self.model.encode("\n")
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and self.model.decode(self.model.encode("Åﬁ  \n x ")) == "Åﬁ  \n x "
        self.special = [SPACE]  # in a text it is a space to the model: such texts go to it whole
        self._forget()

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.splits:
            return [np.array(x[len(self.before) :], dtype=self.kind) for x in self.model.encode(["\n" + t for t in texts], num_threads=1)]
        return [np.array(x, dtype=self.kind) for x in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def _cuts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        starts = np.zeros(len(raw), dtype=bool)
        line = raw == 10
        starts[1:] = (raw[1:] == 32) & (raw[:-1] != 32) | line[1:] | line[:-1]
        starts[edges[:-1][np.diff(edges) > 0]] = True
        return np.flatnonzero(starts)


def sure_cuts(raw: bytes, size: int = PIECE) -> list[bytes]:
    """A text's bytes in pieces of some `size`, each after the first beginning with a lone space between letters or digits, where
    both tokenizers end a token."""
    out, start = [], 0
    place = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])")
    while len(raw) - start > size and (found := place.search(raw, start + size)):
        out.append(raw[start : found.start() + 1])
        start = found.start() + 1
    return [*out, raw[start:]]


class Aligner:
    """Both tokenizers of a worker, and what each id's bytes, length and decimal digits are."""

    def __init__(self, first: str, second: str):
        self.sides = ByteEncoder(first), PieceEncoder(second)
        self.bytes = [pa.array(s.tokens, pa.binary()) for s in self.sides]
        self.lengths = [np.array([len(t) for t in s.tokens], dtype=np.int32) for s in self.sides]
        #: The digits of every id with what may follow them: a comma, a bar, a semicolon.
        self.digits = pa.array([f"{i}{mark}" for i in range(max(map(len, self.lengths))) for mark in ",|;"], pa.binary())

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts and how many each has; none for texts that a side doesn't restore."""
        right = np.array([SPACE.encode() not in t for t in texts], dtype=bool)
        given = pa.array([t if ok else b"" for t, ok in zip(texts, right, strict=True)], pa.binary()).cast(pa.string())
        found = [s.encode(given) for s in self.sides]
        for (ids, sizes), spelled, length in zip(found, self.bytes, self.lengths, strict=True):
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
            right &= np.diff(ends) == [len(t) for t in texts]
            joined = spelled.take(pa.array(ids))
            held = memoryview(joined.buffers()[2] or b"").cast("B")
            right &= [held[a:b] == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
        if right.all():
            return found
        return [(ids[np.repeat(right, sizes)], np.where(right, sizes, 0)) for ids, sizes in found]

    def align(self, texts: list[bytes]) -> dict:
        """Of each text the numbers of tokens, groups and links and its groups as text; of all (text, pair, links) ascending."""
        (a, n_a), (b, n_b) = self.tokens(texts)
        end_a, end_b = np.cumsum(self.lengths[0][a], dtype=np.int32), np.cumsum(self.lengths[1][b], dtype=np.int32)
        start_a, start_b = end_a - self.lengths[0][a], end_b - self.lengths[1][b]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        of_a = np.repeat(np.arange(len(texts), dtype=np.int32), n_a)
        text_end = np.concatenate([[0], end_a])[np.cumsum(n_a)]
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(cuts, text_end, side="right")]))
        # links: the tokens b that end behind a's start and start before its end
        low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a)
        many = high - low
        link_a, link_b = np.repeat(np.arange(len(a), dtype=np.int32), many), spread(low, many)
        # text, first and second id in 63 bits: a block has less than 2^15 texts
        keys = of_a[link_a].astype(np.int64) << 2 * ID_BITS
        keys |= a[link_a].astype(np.int64) << ID_BITS
        keys |= b[link_b]
        keys.sort()
        head = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
        rows, pairs = keys[head] >> 2 * ID_BITS, keys[head] & ((1 << 2 * ID_BITS) - 1)
        # the groups as text: tokens by group, a before b, with what follows each
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        shown = np.empty(len(a) + len(b), dtype=np.int32)
        shown[place_a], shown[place_b] = a.astype(np.int32) * 3, b.astype(np.int32) * 3
        shown[place_a[np.cumsum(in_a) - 1]] += 1
        shown[place_b[np.cumsum(in_b) - 1]] += 2
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(of_a, weights=many, minlength=len(texts)).astype(np.int64),
            "groups": self._texts(shown, n_a + n_b), "rows": rows, "pairs": pairs, "times": np.diff(np.append(head, len(keys))),
        }

    def _texts(self, shown: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """Each text's groups, with the last semicolon."""
        joined = self.digits.take(pa.array(shown))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[: len(shown) + 1] if len(shown) else np.zeros(1, dtype=np.int32)
        held, cuts = memoryview(joined.buffers()[2] or b"").cast("B"), ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [held[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def block(self, texts: list[bytes]) -> dict:
        """As align, with checksums of the groups, of the distinct pairs of all texts and each text's places among them."""
        if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
            made = self._pieces(sure_cuts(texts[0]))
        else:
            made = self.align(texts)
            made["sums"] = [sha256(g[:-1]).hexdigest() if len(g) else "" for g in made.pop("groups")]
        keys = np.unique(made["pairs"])
        at = np.searchsorted(keys, made["pairs"]).astype("<u4")
        totals = np.bincount(at, weights=made["times"], minlength=len(keys)).astype(np.int64)
        bounds = np.searchsorted(made["rows"], np.arange(len(texts) + 1)).tolist()
        times = made["times"].astype("<u4")
        cut = lambda x: [x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return {**{k: made[k] for k in ("n_a", "n_b", "n_groups", "n_links", "sums")}, "at": cut(at), "times": cut(times), "keys": keys, "totals": totals}

    def _pieces(self, pieces: list[bytes]) -> dict:
        """One long text, a piece at a time; if a piece isn't restored, the text has no tokens."""
        names = ("n_a", "n_b", "n_groups", "n_links")
        sums, digest, pairs, times = dict.fromkeys(names, 0), sha256(), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for k, piece in enumerate(pieces):
            made = self.align([piece])
            if not made["n_a"][0]:
                return {**{c: np.zeros(1, dtype=np.int64) for c in names}, "sums": [""], "rows": pairs[:0], "pairs": pairs[:0], "times": times[:0]}
            for c in names:
                sums[c] += int(made[c][0])
            digest.update(b";" * (k > 0) + bytes(made["groups"][0][:-1]))
            pairs, back = np.unique(np.concatenate([pairs, made["pairs"]]), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate([times, made["times"]])).astype(np.int64)
        return {**{c: np.array([v]) for c, v in sums.items()}, "sums": [digest.hexdigest()], "rows": np.zeros(len(pairs), dtype=np.int64), "pairs": pairs, "times": times}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One for each worker process, kept from task to task."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def blocks(documents: DataFrame, first: str, second: str) -> DataFrame:
    """Staged: a row for each text (at: its places in the block's table, times: how often, as bytes), and one for each block
    with the table (keys: pairs; totals: their links)."""
    schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
        ("at", pa.binary()), ("times", pa.binary()), ("keys", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
    ])

    def run(batches):
        from pyspark import TaskContext

        number, both = TaskContext.get().partitionId() << 32, aligner(first, second)
        for batch in batches:
            for part in slices(batch, 1, BLOCK_ROWS, BLOCK):
                made = both.block([b" " + t.encode() if t else b"" for t in part.column(1).to_pylist()])
                n = part.num_rows
                columns = [np.full(n, number), part.column(0), *[made[c] for c in ("n_a", "n_b", "n_groups", "n_links", "sums", "at", "times")], [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([number, *[None] * 8, made["keys"], made["totals"]], schema, strict=True)], schema=schema)
                number += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(rows.mapInArrow(run, f"block long, {COLUMNS}, at binary, times binary, keys array<long>, totals array<long>"), "aligned")


def block_pairs(found: DataFrame) -> DataFrame:
    """block, place, pair and links, a row for each distinct pair of a block."""
    rows = found.filter("keys IS NOT NULL").select("block", F.posexplode(F.arrays_zip("keys", "totals")).alias("place", "x"))
    return rows.select("block", "place", F.col("x.keys").alias("pair"), F.col("x.totals").alias("links"))


def pair_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks' pairs summed by pair and salt (pair, salt, links), and from there by pair: a, b, links. The first is staged."""
    salted = block_pairs(found).groupBy("pair", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("links").alias("links"))
    salted = stage(salted, "aligned-salted")
    whole = salted.groupBy("pair").agg(F.sum("links").alias("links"))
    return salted, whole.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b"), "links")


def aligned_documents(documents: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, tokens of both sides, groups, links, links whose pair is the commonest of its second id, the sum of the links'
    counts, and the checksum of the groups."""
    found = blocks(documents, first, second)
    salted, counts = pair_counts(found)
    counts = stage(counts, "aligned-counts")
    best = counts.groupBy("b").agg(F.max("links").alias("most"))  # as many rows as the second vocabulary has ids
    rated = counts.join(F.broadcast(best), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    back = salted.select("pair", "salt").join(rated, "pair")
    asked = block_pairs(found).select("block", "place", "pair", F.pmod("block", F.lit(SALTS)).alias("salt"))
    told = asked.join(back, ["pair", "salt"]).select(F.col("block").alias("of_block"), "place", "links", "best")

    def sum_up(key, texts, pairs):
        pairs = pairs.sort_values("place")
        links, best = pairs["links"].to_numpy().astype(np.int64), pairs["best"].to_numpy().astype(bool)
        out = texts.drop(columns=["block", "at", "times"])
        sums, firsts = [], []
        for at, times in zip(texts["at"], texts["times"], strict=True):
            at, times = np.frombuffer(at, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
            sums.append(int(times @ links[at]))
            firsts.append(int(times[best[at]].sum()))
        out["n_best"], out["count_sum"] = firsts, sums
        return out

    texts = found.filter("keys IS NULL").drop("keys", "totals")
    return texts.groupBy("block").cogroup(told.groupBy("of_block")).applyInPandas(sum_up, f"{COLUMNS}, n_best long, count_sum long")


def op12_alignment(spark, sf_dir: str, first: str | None = None, second: str | None = None) -> DataFrame:
    found = aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), first or default_tokenizer(), second or default_pieces())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
