"""Token ids in length-delimited binary records with a separate offset index.

Texts are encoded where they are read; the ids, which are smaller, are exchanged once, by ranges of doc_id (whose
bounds come from a sample), and every task sorts its run and streams it into files of the shared folder. A record is: length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the payload. A payload is a flag byte (1: the id is null), the
doc_id (8 bytes) and the ids, two bytes each if the vocabulary allows, else four; all little-endian. Beside each
file lies `.idx`: a frame with the records' offsets (8 bytes each), for shuffled reads.

Cases. Null text is empty (its record holds the end id alone); null ids come first; rows with equal ids have a
record each, in an order that their ids alone decide (so null ids, too, are dealt to many tasks, and every
attempt writes the same bytes); an empty table writes no file and reads as no rows; texts of any length are
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .batches import slices
from .common import fresh_dir, range_bounds, shuffle_width, stage
from .files import Rolled, frame, frames, opened

END_ID = 2
ROLL_BYTES = 64 << 20
#: Text in a batch, rows in it, and bytes of known chunks that a worker keeps from batch to batch, at most.
BATCH_BYTES, BATCH_ROWS, HELD_BYTES = 8 << 20, 1 << 16, 48 << 20
#: Chunks that are encoded in one text.
TOGETHER = 4096

# Kinds of bytes, as the vocabulary's splitter tells them apart.
OTHER, LETTER, DIGIT, MARK, SPACE, LINE, TAIL, LEAD2, LEAD3, QUOTE = range(10)
_RANGES = ((MARK, 0x21, 0x7F), (QUOTE, 0x27, 0x28), (DIGIT, 0x30, 0x3A), (LETTER, 0x41, 0x5B), (LETTER, 0x61, 0x7B), (SPACE, 32, 33), (LINE, 9, 14),
           (TAIL, 0x80, 0xC0), (LEAD2, 0xC3, 0xE0), (LEAD3, 0xE4, 0xF0))
KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _low, _high in _RANGES:
    KINDS[_low:_high] = _kind
#: What may stand before a lone blank, behind it, and what is one.
SOLID, FRONT, BLANK = (np.isin(np.arange(10), x) for x in ([LETTER, DIGIT, MARK, QUOTE], [LETTER, DIGIT, MARK, QUOTE, LEAD2, LEAD3], [SPACE, LINE]))
#: Pairs of kinds (16 * first + second) between which a piece always ends; a quote may begin a contraction.
PARTS = np.zeros(160, dtype=bool)
PARTS[[16 * a + b for a, b in ((LETTER, DIGIT), (LETTER, MARK), (LETTER, QUOTE), (DIGIT, LETTER), (DIGIT, MARK), (DIGIT, QUOTE), (MARK, LETTER), (MARK, DIGIT))]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after the other."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    return np.repeat((starts - stops + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)


class Encoder:
    """Ids of whole texts, a batch at a time.

    The vocabulary's splitter always ends a piece at certain places: at a lone blank between two other characters,
    and where letters, digits and marks meet. A text's ids are those of its chunks, cut there, one after the other.
    A batch's chunks tile its bytes; Arrow finds the distinct ones, those not yet known are encoded (many in one
    text, as the splitter parts them again), and numpy gathers the ids. What is known is kept in arrays of
    HELD_BYTES at most. Where a place is in doubt (blanks beside blanks, characters that may be blanks) nothing is
    cut; batches with special tokens, and vocabularies that split otherwise, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        #: Ids whose bytes begin with a space, so that they begin a chunk.
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.stops = np.zeros(0, dtype=self.kind), np.zeros(1, dtype=np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has."""
        at = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        raw = np.frombuffer(chunks.buffers()[2], dtype=np.uint8) if len(chunks) else np.zeros(0, dtype=np.uint8)
        spaces = np.concatenate([[0], np.cumsum(raw == 32)])
        led = (spaces[at[1:]] - spaces[at[:-1]] == 1) & (raw[np.minimum(at[:-1], max(0, len(raw) - 1))] == 32)
        sizes = np.zeros(len(chunks), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.flatnonzero(led)
        groups = [order[a : a + TOGETHER] for a in range(0, len(order), TOGETHER)]
        for a in range(0, len(groups), 64):
            some = groups[a : a + 64]
            texts = [b"".join(chunks.take(pa.array(g)).to_pylist()).decode() for g in some]
            for group, ids in zip(some, self._plain(texts), strict=True):
                starts = np.flatnonzero(self.leads[ids])
                if len(starts) != len(group) or starts[0]:  # not one lead for each: a chunk at a time, below
                    led[group] = False
                    continue
                sizes[group] = np.diff(np.append(starts, len(ids)))
                parts.append((group, ids))
        rest = np.flatnonzero(~led)
        for a in range(0, len(rest), 8192):
            some = rest[a : a + 8192]
            found = self._plain([b.decode() for b in chunks.take(pa.array(some)).to_pylist()])
            sizes[some] = [len(x) for x in found]
            parts.append((some, np.concatenate(found)))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=self.kind)
        for group, ids in parts:
            out[spread(starts[group], sizes[group])] = ids
        return out, sizes

    def _cuts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where chunks start: at the texts' starts, and wherever a piece certainly ends."""
        if not len(raw):
            return np.zeros(0, dtype=np.int64)
        kinds = KINDS[raw]
        # a character of two or three bytes that can't be a blank counts as a mark that nothing but a blank parts from its neighbours
        wide = np.flatnonzero(kinds == TAIL)
        wide = wide[wide > 2]
        whole = (kinds[wide - 1] == LEAD2) | (kinds[wide - 1] == TAIL) & (kinds[wide - 2] == LEAD3)
        solid = SOLID[kinds]
        solid[wide[whole]] = True
        # a lone blank between two others: cut before it, and behind it unless it is a space
        blank = np.flatnonzero(BLANK[kinds[1:-1]]) + 1
        blank = blank[solid[blank - 1] & FRONT[kinds[blank + 1]]]
        text = np.searchsorted(edges, blank, side="right")
        blank = blank[(blank > edges[text - 1]) & (blank + 1 < edges[text])]
        starts = np.zeros(len(raw), dtype=bool)
        starts[1:] = PARTS[kinds[:-1] * 16 + kinds[1:]]
        starts[blank] = True
        starts[blank[kinds[blank] == LINE] + 1] = True
        starts[edges[:-1][np.diff(edges) > 0]] = True
        return np.flatnonzero(starts)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other (each with the end id behind it), and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        whole = raw.tobytes() if self.special else b""
        if not self.splits or any(s.encode() in whole for s in self.special):
            found = self._plain(texts.to_pylist())
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            ids = np.concatenate(found) if len(found) else np.zeros(0, dtype=self.kind)
        else:
            starts = self._cuts(raw, edges)
            bounds = np.append(starts, len(raw)).astype(np.int32)
            chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
            place = pc.index_in(chunks.dictionary, value_set=self.known).to_numpy(zero_copy_only=False)
            missing = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), dtype=bool)
            if missing.any():
                new = chunks.dictionary.filter(pa.array(missing))
                ids, n = self._chunk_ids(new)
                place[missing] = len(self.known) + np.arange(len(new))
                self.known = pa.concat_arrays([self.known, new])
                self.ids = np.concatenate([self.ids, ids])
                self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(n)])
            which = place.astype(np.int64)[chunks.indices.to_numpy()]
            n = self.stops[which + 1] - self.stops[which]
            ids = self.ids[spread(self.stops[which], n)]
            through = np.concatenate([[0], np.cumsum(n)])
            sizes = np.diff(through[np.searchsorted(starts, edges)])
            if self.known.nbytes + self.ids.nbytes + self.stops.nbytes > HELD_BYTES:
                self._forget()
        if end is not None:
            out = np.full(len(ids) + len(sizes), end, dtype=self.kind)
            out[spread(np.cumsum(sizes + 1) - sizes - 1, sizes)] = ids
            return out, sizes + 1
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST = "part int, seq int, name string, bytes long, records long, ids long, width int"
ENCODED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("spot", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())])


def encoded(documents: DataFrame, tokenizer: str, width: int, end_id: int = END_ID) -> DataFrame:
    """doc_id, the ids of the whole text and the end id (little-endian) and their width; part: the row's range of ids.

    Rows with one id are told apart by a checksum of their text, so that a hot (or null) id fills many ranges.
    """
    key = F.col("doc_id").cast(LongType())
    texts = documents.select(key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("key"), F.xxhash64("text").alias("spot"), "text")
    bounds = range_bounds(texts.drop("text"), width)

    def run(batches):
        codec = encoder(tokenizer)
        for batch in batches:
            for some in slices(batch, 3, BATCH_ROWS, BATCH_BYTES):
                known, keys, spots, column = some.columns
                parts = [bisect_right(bounds, row) for row in zip(known.to_pylist(), keys.to_pylist(), spots.to_pylist(), strict=True)]
                ids, sizes = codec.encode(column, end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * codec.width
                rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                ids_of = pc.if_else(known, keys, pa.scalar(None, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), ids_of, spots, rows, pa.array(np.full(len(sizes), codec.width, dtype=np.int32))], schema=ENCODED)

    return texts.mapInArrow(run, "part int, doc_id long, spot long, ids binary, width int")


def write_records(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes the files; returns the manifest, a row for each file, itself kept in the shared folder."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = Rolled(folder, f"part-{part:06d}", ".rec", roll)
        starts: list[int] = []
        ids = width = 0

        def closed():
            nonlocal starts, ids
            name, size = out.commit()
            out.beside(".idx", frame(np.array(starts, dtype="<u8").tobytes()))
            row = [part, out.count - 1, name, size, len(starts), ids, width]
            starts, ids = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, KINDS_OF, strict=True)], names=NAMES)

        for batch in batches:
            for part_of in slices(batch, 1):
                for key, raw, width in zip(*[c.to_pylist() for c in part_of.columns], strict=True):
                    starts.append(out.write(frame(struct.pack("<Bq", key is None, key or 0) + raw)))
                    ids += len(raw) // width
                    if out.full:
                        yield closed()
        if starts:
            yield closed()

    KINDS_OF = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
    parts = shuffle_width(documents.sparkSession)
    run = encoded(documents, tokenizer, parts, end_id).repartitionById(parts, "part").sortWithinPartitions("doc_id", "spot", "ids").select("doc_id", "ids", "width")
    return stage(run.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' checksum of every record, from the files."""
    run = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    based = manifest.select("name", "width", F.coalesce(F.sum("ids").over(run), F.lit(0)).alias("base"))
    spread = based.repartition(max(1, min(10_000, manifest.count())))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts, sizes, sums, at = [], [], [], [], row["base"]
                with opened(folder, row["name"]) as stream:
                    for data in frames(stream):
                        empty, key = struct.unpack_from("<Bq", data)
                        ids = np.frombuffer(data, dtype=f"<u{row['width']}", offset=9)
                        keys.append(None if empty else key)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4")))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_records(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or default_tokenizer())


def encode_and_read(documents: DataFrame, tokenizer: str) -> DataFrame:
    folder = fresh_dir(documents.sparkSession, "records")
    return read_records(write_records(documents, folder, tokenizer), folder)
