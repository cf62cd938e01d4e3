"""Telephony audio in a media column: mu-law, A-law and ADPCM, expanded and resampled.

A payload becomes a WAV file of 8 kHz codes: one byte is one mu-law or A-law sample, or two ADPCM
nibbles. Files are stored in the shared folder as a Parquet column, read back, expanded by lookup
tables (ADPCM: all blocks of a batch in step) and resampled: to 4 kHz PCM of 8 bits (unsigned, as in a WAV file), which is stored as it is,
or to 16 kHz PCM of 16 bits, stored packed without loss.

Cases. Null text is empty; payloads are filled with blanks to a positive multiple of 192 bytes, so
an empty one holds one frame; equal texts give equal files and features, whatever their ids; null
ids and repeated rows pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record_batch, slices
from .common import stage

FRAME = 192
RATE = 8000
CODECS = ("mulaw", "alaw", "adpcm")
#: WAVE format tags of the codecs.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}

# Step sizes and index changes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, mantissa = code >> 4 & 7, code & 15
    size = np.where(part == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + nibble: the change of the prediction, and 16 times the next index."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + np.array(CHANGES)[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (16 * index).astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
_CHANGE, _NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 4 + b) bytes to (n, 1 + 2 b) samples; every step handles all blocks."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel()
    now, index = head.astype(np.int32), np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), dtype=np.int16)
    out[0] = now
    at = 1
    for column in codes:
        for nibble in (column & 15, column >> 4):
            cell = index + nibble
            now = now + _CHANGE[cell]
            np.clip(now, -32768, 32767, out=now)
            index = _NEXT[cell]
            out[at] = now
            at += 1
    return np.ascontiguousarray(out.T)


def _taps(half: int = 6) -> np.ndarray:
    """A windowed sinc that gives the sample midway between two others."""
    x = np.arange(-half, half) + 0.5
    taps = np.sinc(x) * np.hanning(2 * half + 2)[1:-1]
    return taps / taps.sum()


_HALFWAY = _taps()


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples and, between them, interpolated ones (edges repeat)."""
    half = len(_HALFWAY) // 2
    padded = np.concatenate([np.full(half - 1, pcm[0]), pcm, np.full(half, pcm[-1])]).astype(np.float32)
    between = np.convolve(padded, _HALFWAY.astype(np.float32), mode="valid")
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(between), -32768, 32767)
    return out


def _low_pass(half: int = 4) -> np.ndarray:
    """A windowed sinc that keeps what half the rate can hold, centred between two samples."""
    x = (np.arange(2 * half) - half + 0.5) / 2
    taps = np.sinc(x) * np.hanning(2 * half + 2)[1:-1]
    return (taps / taps.sum()).astype(np.float32)


_LOW = _low_pass()


def resample_half(pcm: np.ndarray) -> np.ndarray:
    """Half the rate, as unsigned 8-bit PCM: one sample for every two (edges repeat, a last one alone counts as two)."""
    half, n = len(_LOW) // 2, -(-len(pcm) // 2)
    padded = np.concatenate([np.full(half - 1, pcm[0]), pcm, np.full(half + 1, pcm[-1])]).astype(np.float32)
    out = np.zeros(n, dtype=np.float32)
    for k, tap in enumerate(_LOW):
        out += tap * padded[k : k + 2 * n : 2]
    return np.clip(np.rint(out / 256) + 128, 0, 255).astype(np.uint8)


#: How stored sound begins: flags and the number of samples. PLAIN: unsigned 8-bit PCM follows.
_PACKED = struct.Struct("<BI")
_PALETTE, _EXACT, _PLAIN = 1, 2, 4


def plain(samples: np.ndarray) -> bytes:
    """Unsigned 8-bit PCM as it is stored."""
    return _PACKED.pack(_PLAIN, len(samples)) + samples.astype(np.uint8).tobytes()


def levels_of(sounds: list[np.ndarray]) -> np.ndarray | None:
    """The values of every other sample of all sounds, if these are 256 at most."""
    values = np.unique(np.concatenate([np.unique(s[::2]) for s in sounds])) if sounds else np.zeros(0, dtype=np.int16)
    return values if 0 < len(values) <= 256 else None


def packed(pcm: np.ndarray, values: np.ndarray | None = None) -> bytes:
    """16-bit samples without loss, so that a general compressor has little left to do.

    Every other sample is stored, by its place among `values` (the levels of many sounds, so that equal stretches of
    them look alike; of this one by default) if there are 256 at most, else as its change. The samples between are stored as what they are off the interpolated ones: for sound that
    resample_double made that is nothing, and one flag says so.
    """
    own, between = pcm[::2], pcm[1::2]
    off = (between - resample_double(own)[1::2][: len(between)]).astype("<i2") if len(pcm) else between
    values = levels_of([pcm]) if values is None else values
    flags = (0 if values is None else _PALETTE) | (0 if off.any() else _EXACT)
    if flags & _PALETTE:
        body = bytes([len(values) - 1]) + values.astype("<i2").tobytes() + np.searchsorted(values, own).astype(np.uint8).tobytes()
    else:
        body = np.diff(own, prepend=np.int16(0)).astype("<i2").tobytes()
    return _PACKED.pack(flags, len(pcm)) + body + (b"" if flags & _EXACT else off.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """The samples of packed(), or those of plain() with 16 bits."""
    flags, n = _PACKED.unpack_from(data)
    if flags & _PLAIN:
        return (np.frombuffer(data, dtype=np.uint8, count=n, offset=_PACKED.size).astype(np.int16) - 128) * 256
    half, at = -(-n // 2), _PACKED.size
    if flags & _PALETTE:
        many = data[at] + 1
        values = np.frombuffer(data, dtype="<i2", count=many, offset=at + 1)
        own = values[np.frombuffer(data, dtype=np.uint8, count=half, offset=at + 1 + 2 * many)]
        at += 1 + 2 * many + half
    else:
        own = np.cumsum(np.frombuffer(data, dtype="<i2", count=half, offset=at), dtype=np.int16)
        at += 2 * half
    if not n:
        return own.astype(np.int16)
    out = resample_double(own)[:n]
    if not flags & _EXACT:
        out[1::2] += np.frombuffer(data, dtype="<i2", count=n // 2, offset=at)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def to_wav(payload: bytes, codec: str) -> bytes:
    if codec == "adpcm":
        rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME)
        blocks = np.zeros((len(rows), FRAME + 4), dtype=np.uint8)
        blocks[:, 4:] = rows
        data, align, bits, per = blocks.tobytes(), FRAME + 4, 4, 1 + 2 * FRAME
        extra = struct.pack("<HH", 2, per)
        byte_rate = RATE * align // per
    else:
        data, align, bits, extra, byte_rate = payload, 1, 8, struct.pack("<H", 0), RATE
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, byte_rate, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(wav: bytes) -> tuple[str, bytes]:
    """Codec and data chunk."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, ""
    while at < len(wav):
        name, n = wav[at : at + 4], int.from_bytes(wav[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag = int.from_bytes(wav[at + 8 : at + 10], "little")
            codec = next(c for c, t in TAGS.items() if t == tag)
        elif name == b"data":
            return codec, wav[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload_from(codec: str, data: bytes) -> bytes:
    if codec != "adpcm":
        return data
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, FRAME + 4)[:, 4:]).tobytes()


def expand(files: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """8 kHz PCM of many (codec, data) at once."""
    out: list[np.ndarray | None] = [MULAW[np.frombuffer(d, dtype=np.uint8)] if c == "mulaw" else ALAW[np.frombuffer(d, dtype=np.uint8)] if c == "alaw" else None for c, d in files]
    packed = [i for i, pcm in enumerate(out) if pcm is None]
    if packed:
        joined = np.frombuffer(b"".join(files[i][1] for i in packed), dtype=np.uint8).reshape(-1, FRAME + 4)
        pcm, at = decode_adpcm(joined), 0
        for i in packed:
            n = len(files[i][1]) // (FRAME + 4)
            out[i] = pcm[at : at + n].ravel()
            at += n
    return out


def feature_of(codec: str, pcm: np.ndarray) -> str:
    """Features of the resampled sound in a line of text."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    energy = int(np.dot(wide, wide)) // len(wide)
    return f"{codec};n={len(pcm)};peak={int(np.abs(wide).max())};energy={energy};crossings={crossings};pcm={zlib.crc32(pcm.tobytes()):08x}"


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
DECODED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm", pa.binary())]
)
_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"


#: Media columns are pressed harder than other staged tables: they are the job's product, and read more often than written.
PRESSED = {"parquet.compression.codec.zstd.level": "11", "parquet.page.size": str(4 << 20)}


def store_media(documents: DataFrame, name: str = "audio") -> DataFrame:
    """doc_id, n_bytes and the stored WAV file of each text; the payload's checksum picks the codec."""

    def build(batches):
        for batch in batches:
            for part in slices(batch, 1):
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield record_batch(MEDIA, part.column(0), [n for n, _ in made], [to_wav(p, CODECS[zlib.crc32(p) % 3]) for _, p in made])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(texts.mapInArrow(build, "doc_id long, n_bytes long, media binary"), name, **PRESSED)


def decode_media(media: DataFrame, keep_pcm: bool = True, pack: bool = False, half: bool = False) -> DataFrame:
    """Digests and features of stored files, and their PCM at 16 kHz (little-endian, 16 bit; or packed()); half: their plain() PCM at 4 kHz."""

    def decode(batches):
        for batch in batches:
            for part in slices(batch, 2, limit=2 << 20):
                stored = part.column(2).to_pylist()
                files = [from_wav(w) for w in stored]
                payloads = [payload_from(c, d) for c, d in files]
                stored_pcm = [plain(resample_half(pcm)) for pcm in expand(files)] if half else None
                sounds = [unpacked(b) for b in stored_pcm] if half else [resample_double(pcm) for pcm in expand(files)]
                shared = {c: levels_of([s for (k, _), s in zip(files, sounds, strict=True) if k == c]) for c in CODECS} if pack and not half else {}
                yield record_batch(
                    DECODED,
                    part.column(0),
                    part.column(1),
                    [len(p) for p in payloads],
                    [hashlib.sha256(p).hexdigest() for p in payloads],
                    [zlib.crc32(p[-16:]) for p in payloads],
                    [len(w) for w in stored],
                    [hashlib.sha256(w).hexdigest() for w in stored],
                    [feature_of(c, s) for (c, _), s in zip(files, sounds, strict=True)],
                    stored_pcm if half and keep_pcm else [None if not keep_pcm else packed(s, shared[c]) if pack else s.tobytes() for (c, _), s in zip(files, sounds, strict=True)],
                )

    return media.mapInArrow(decode, _DDL)


def store_pcm(media: DataFrame, name: str = "audio-pcm", half: bool = False) -> DataFrame:
    """decode_media written to the shared folder, PCM (packed; half: plain, at 4 kHz) and all."""
    return stage(decode_media(media, pack=True, half=half), name, **PRESSED)


def read_features(stored: DataFrame) -> DataFrame:
    """The rows of store_pcm without their PCM; the features are those of the stored PCM."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, 8, limit=8 << 20):
                codecs = [f.partition(";")[0] for f in part.column(7).to_pylist()]
                features = [feature_of(c, unpacked(b)) for c, b in zip(codecs, part.column(8).to_pylist(), strict=True)]
                yield record_batch(pa.schema(list(DECODED)[:8]), *[part.column(k) for k in range(7)], features)

    return stored.mapInArrow(read, _DDL.removesuffix(", pcm binary"))


def op9_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_features(store_pcm(store_media(docs), half=True))
