"""Files, tokens, archives and audio: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import rows_of, table
from tracewright.llm import audio, files, queries, token_records, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", "a", "x  y", "a   b", " lead", "tail ", "x\n y", "x \ny", "\n\n", "it's we're", "<|endoftext|> x", "привет мир", "日本 語", "é a\xa0b", "a\x1cb", "tab\t \tz", "word " * 3000]


def odd_documents(spark, key="doc_id"):
    rows = [(i, t, i * 10) for i, t in enumerate(ODD)] + [(3, "x  y", 1), (None, "no id", 2)]
    return spark.createDataFrame(rows, f"{key} long, text string, start long")


def test_crc32c():
    assert files.crc32c(b"123456789") == 0xE3069283
    table_ = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        table_[i] = c
    for n in (0, 1, 31, 32, 255, 256, 257, 513, 4000):
        data, c = random.Random(n).randbytes(n), 0xFFFFFFFF
        for b in data:
            c = c >> 8 ^ table_[(c ^ b) & 255]
        assert files.crc32c(data) == c ^ 0xFFFFFFFF


def test_frames_are_checked():
    import io

    good = files.frame(b"abc") + files.frame(b"")
    assert list(files.frames(io.BytesIO(good))) == [b"abc", b""]
    for at in (0, 9, 13, 16):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(files.frames(io.BytesIO(bytes(bad))))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = token_records.default_tokenizer()
    plain, mine = Tokenizer.from_file(path), token_records.Encoder(path)
    rng = random.Random(0)
    bits = ["the", " ", "  ", "\n", "a1", ",", "'s", "é", "ß", "x.", "!!", "\t", "12", "Ｑ", "\xa0", "don't", "…", "'", "\r\n", "e\u0301", "\u3000", "\u2009", "日", "😀", "(", '"', "\x85", "\x1f", "\x0b"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.choice((1, 3, 40)))) for _ in range(4000)]
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    odd = [i for i, t in enumerate(texts) if t and "<|" in t]
    for rows in (range(len(texts)), [i for i in range(len(texts)) if i not in odd], odd):
        for end in (None, 2, 2):
            ids, sizes = mine.encode(pa.array([None, *[texts[i] for i in rows]], pa.string()).slice(1), end)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [want[i] + ([] if end is None else [end]) for i in rows]
    assert mine.known.nbytes < token_records.HELD_BYTES


def test_token_records(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_records.default_tokenizer())
    docs = odd_documents(spark)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_records.encode_and_read(docs, token_records.default_tokenizer()).collect())
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    want, start = [], 0
    for known, key, t in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((start, key if known else None, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_records.encode_and_read(docs.filter("doc_id > 999"), token_records.default_tokenizer()).count() == 0


def test_index_finds_records(spark, tmp_path):
    import struct

    folder = f"file://{tmp_path}"
    manifest = token_records.write_records(odd_documents(spark), folder, token_records.default_tokenizer(), roll=2000).collect()
    assert len(manifest) > 2 and sum(r["records"] for r in manifest) == len(ODD) + 2
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
    for r in manifest:
        data = (tmp_path / r["name"]).read_bytes()
        index = (tmp_path / (r["name"] + ".idx")).read_bytes()
        starts = np.frombuffer(index[12:-4], dtype="<u8")
        assert len(starts) == r["records"]
        for s in starts[::-1].tolist():
            n, check = struct.unpack_from("<QI", data, s)
            assert files.masked(files.crc32c(data[s : s + 8])) == check


def test_equal_ids_are_written_alike_whatever_their_order(spark, tmp_path):
    rows = [(i % 3 or None, f"text {i * 7919 % 50}") for i in range(200)]
    written = []
    for k, some in enumerate((rows, rows[::-1])):
        folder = f"file://{tmp_path}/{k}"
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(5 - k)
        token_records.write_records(docs, folder, token_records.default_tokenizer(), roll=1000)
        files_ = {p.name: p.read_bytes() for p in (tmp_path / str(k)).iterdir()}
        written.append(b"".join(files_[n] for n in sorted(files_) if n.endswith(".rec")))
    assert written[0] == written[1] and written[0]


def test_warc_equals_its_sql(spark):
    df = queries.queries()["op10_warc"](spark, SF)
    assert table(df.columns, df.collect()) == table(*rows_of(queries.oracle_sql()["op10_warc"], SF))


def test_warc_cases(spark, tmp_path):
    big, small = "<p>é</p>" * 40, "tiny"
    rows = [(5, "u5", big), (2, "u\r\n2", big), (9, None, small), (1, "u1", small), (7, "u7", None), (8, "u8", ""), (2, "again", big), (None, "none", big), (30, "x", big + "!")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, folder, roll=300)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(manifest, folder).collect()}
    n = len(big.encode())
    assert got == {(2, "response", None, n), (2, "revisit", 2, n), (5, "revisit", 2, n), (None, "revisit", 2, n), (1, "response", None, 4), (9, "response", None, 4), (7, "response", None, 0), (8, "response", None, 0), (30, "response", None, n + 1)}
    first = {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir()}
    assert len(first) > 2 and not [p for p in first if p.endswith(".tmp")]
    warc.write_warc(pages.orderBy(F.desc("page_id")), f"file://{tmp_path}/again", roll=300)
    assert first == {p.name: p.read_bytes() for p in (tmp_path / "again").iterdir()}
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


# --- audio ----------------------------------------------------------------------------------


def test_companding_tables():
    def mulaw(code):
        code = ~code & 255
        size = ((((code & 15) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
        return -size if code & 0x80 else size

    def alaw(code):
        code ^= 0x55
        size, part = (code & 15) << 4, (code & 0x70) >> 4
        size = size + 8 if part == 0 else (size + 0x108) << (part - 1)
        return size if code & 0x80 else -size

    assert audio.MULAW.tolist() == [mulaw(c) for c in range(256)] and audio.ALAW.tolist() == [alaw(c) for c in range(256)]
    assert audio.MULAW[0] == -32124 and audio.MULAW[255] == 0 and audio.ALAW[0x55] == -8


def test_adpcm_against_a_nibble_loop():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (7, 4 + 32), dtype=np.uint8)
    blocks[:, 2] %= 89
    for block, out in zip(blocks, audio.decode_adpcm(blocks), strict=True):
        now, index = int(block[:2].view("<i2")[0]), int(block[2])
        want = [now]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = audio.STEPS[index]
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if code & bit else 0
                now = max(-32768, min(32767, now - change if code & 8 else now + change))
                index = max(0, min(88, index + audio.CHANGES[code & 7]))
                want.append(now)
        assert out.tolist() == want


def test_resampling_keeps_samples_and_interpolates():
    t = np.arange(400) / 8000
    pcm = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    out = audio.resample_double(pcm)
    fine = 8000 * np.sin(2 * np.pi * 440 * np.arange(800) / 16000)
    assert (out[::2] == pcm).all() and np.abs(out[20:-20] - fine[20:-20]).max() < 40
    assert len(audio.resample_double(pcm[:1])) == 2


def test_media_round_trip(spark):
    docs = odd_documents(spark)
    rows = audio.decode_media(audio.store_media(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    for d in docs.collect():
        raw = (d["text"] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-16:]) and len(r["pcm"]) >= 4 * r["payload_bytes"]
    assert {r["feature"].split(";")[0] for r in rows} == set(audio.CODECS)
    same = [r for r in rows if r["doc_id"] == 3]
    assert len(same) == 2 and same[0][1:8] == same[1][1:8]
    assert by[0]["media_sha256"] == by[1]["media_sha256"]
    for codec in audio.CODECS:
        assert audio.payload_from(*audio.from_wav(audio.to_wav(b"x" * 192 + b"y" * 192, codec))) == b"x" * 192 + b"y" * 192


def test_query_stores_the_pcm(spark, monkeypatch):
    import zlib

    staged, stage = [], audio.stage
    monkeypatch.setattr(audio, "stage", lambda df, name, **how: staged.append(stage(df, name, **how)) or staged[-1])
    rows = {r["doc_id"]: r for r in audio.op9_audio(spark, "/root/testdata/sf0.001").collect()}
    held = staged[-1].select("doc_id", "pcm").collect()
    assert len(held) == len(rows)
    sounds = {r["doc_id"]: audio.unpacked(r["pcm"]).astype("<i2").tobytes() for r in held}
    assert all(rows[k]["feature"].endswith(f"pcm={zlib.crc32(s):08x}") for k, s in sounds.items())


def test_packing_is_lossless():
    rng = np.random.default_rng(5)
    sounds = [np.zeros(0), np.array([-32768]), np.array([32767, -32768]), rng.integers(-32768, 32768, 1001), rng.integers(-3, 3, 1000), rng.integers(-32768, 32768, 70000)]
    sounds += [audio.resample_double(x.astype(np.int16)) for x in sounds if len(x)]
    for pcm in sounds:
        pcm = pcm.astype(np.int16)
        back = audio.unpacked(audio.packed(pcm))
        assert back.dtype == np.int16 and np.array_equal(back, pcm)
        shared = audio.levels_of([pcm, np.array([5, 5], dtype=np.int16)])
        assert shared is None or np.array_equal(audio.unpacked(audio.packed(pcm, shared)), pcm)
    assert len(audio.packed(audio.resample_double(rng.integers(-3, 3, 1000).astype(np.int16)))) < 1100


def test_audio_feature_by_brute_force(spark):
    """The stored sound, decoded sample by sample, gives the query's feature."""
    docs = odd_documents(spark)
    got = {(r["doc_id"], r["media_sha256"]): r["feature"] for r in audio.read_features(audio.store_pcm(audio.store_media(docs))).collect()}
    for d in docs.collect():
        payload = audio.payload_of(d["text"])[1]
        codec = audio.CODECS[zlib.crc32(payload) % 3]
        pcm = []
        if codec == "adpcm":
            for a in range(0, len(payload), 192):
                now = index = 0
                pcm.append(0)
                for byte in payload[a : a + 192]:
                    for code in (byte & 15, byte >> 4):
                        step = audio.STEPS[index]
                        change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                        now = max(-32768, min(32767, now - change if code & 8 else now + change))
                        index = max(0, min(88, index + audio.CHANGES[code & 7]))
                        pcm.append(now)
        else:
            pcm = [int((audio.MULAW if codec == "mulaw" else audio.ALAW)[b]) for b in payload]
        out = audio.resample_double(np.array(pcm, dtype=np.int16)).tolist()
        assert out[::2] == pcm
        cross = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
        want = f"{codec};n={len(out)};peak={max(map(abs, out))};energy={sum(x * x for x in out) // len(out)};crossings={cross};pcm={zlib.crc32(np.array(out, dtype='<i2').tobytes()):08x}"
        assert got[d["doc_id"], hashlib.sha256(audio.to_wav(payload, codec)).hexdigest()] == want


def test_audio_of_an_empty_table(spark):
    assert audio.read_features(audio.store_pcm(audio.store_media(odd_documents(spark).limit(0)))).count() == 0


def test_half_the_rate_keeps_low_tones_and_drops_high_ones():
    t = np.arange(1600) / 8000
    tone = lambda f: (12000 * np.sin(2 * np.pi * f * t)).astype(np.int16)
    low = (audio.resample_half(tone(300)).astype(int) - 128) * 256
    # a sample stands midway between the two that it replaces
    want = 12000 * np.sin(2 * np.pi * 300 * (np.arange(800) * 2 + 0.5) / 8000)
    assert len(low) == 800 and np.abs(low[10:-10] - want[10:-10]).max() < 600
    assert np.abs((audio.resample_half(tone(3600)).astype(int) - 128) * 256)[10:-10].max() < 2000
    assert [len(audio.resample_half(np.zeros(n, dtype=np.int16))) for n in (1, 2, 3)] == [1, 1, 2]
    assert audio.resample_half(np.full(9, 32767, dtype=np.int16)).tolist() == [255] * 5 and audio.resample_half(np.full(4, -32768, dtype=np.int16)).tolist() == [0, 0]


def test_stored_sound_is_read_without_a_resampler(spark, monkeypatch):
    """The query's store holds every resampled sample; what the query reads from it follows from these bytes alone."""
    docs = odd_documents(spark)
    stored = audio.store_pcm(audio.store_media(docs), half=True)
    features = sorted((r["doc_id"] or -1, r["feature"]) for r in audio.read_features(stored).collect())
    found = []
    for r in stored.collect():
        size = int.from_bytes(r["pcm"][1:5], "little")
        samples = [(b - 128) * 256 for b in r["pcm"][5:]]
        assert len(samples) == size and r["pcm"][0] == 4
        # one sample a byte at 8 kHz, or 385 a frame of 192 bytes
        codec = r["feature"].split(";")[0]
        assert size == -(-(r["payload_bytes"] // 192 * 385 if codec == "adpcm" else r["payload_bytes"]) // 2)
        cross = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        found.append((r["doc_id"] or -1, f"{codec};n={size};peak={max(map(abs, samples))};energy={sum(x * x for x in samples) // size};crossings={cross};pcm={zlib.crc32(np.array(samples, dtype='<i2').tobytes()):08x}"))
    assert features == sorted(found)
