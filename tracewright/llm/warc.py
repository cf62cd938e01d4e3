"""Deterministic sharded WARC writer and its reader.

Rows are range-sorted by page; each task streams its run into gzip files (a member for each record)
that roll once their compressed size reaches a limit. Headers and digests are made anew from the
payload. Files appear under temporary names, are renamed when whole, and count once the manifest,
written last, lists them.

Which payloads repeat is found on digests alone. A page that revisits another gets a narrow marker
row, which is sorted in front of the page's own row, so the payloads move through one exchange only.

Cases. Null html is an empty payload; pages with a null id come last and are written without one;
of rows with equal ids and equal payloads of at least `least` bytes the first is the response and
the rest revisit it; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, shuffle_width, stage
from .files import Rolled, opened

ROLL_BYTES = 64 << 20
LEAST = 100
#: Regenerated headers carry one date, so that equal inputs give equal files.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID(int=0x6F1D6F0E5C3B4A79A1C2D3E4F5061728)

MANIFEST = "part int, seq int, name string, bytes long, records long"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record, not yet compressed. A revisit carries the HTTP head alone."""
    name = uuid.uuid5(_SPACE, f"{page_id}|{digest}|{revisit}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}|{digest}|False')}>")
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream):
    """The uncompressed gzip members of a stream, one after the other."""
    inflate, out = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        out.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(out)
            data = inflate.unused_data or stream.read(1 << 20)
            inflate, out = zlib.decompressobj(31), []
        else:
            data = stream.read(1 << 20)
    if any(out):
        raise ValueError("the archive ends inside a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, block and payload of a record; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    fields["payload-bytes"] = http.rpartition(b"Content-Length: ")[2].decode()
    return fields, block, payload


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def write_warc(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives and returns their manifest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).alias("n"),
    ).filter(F.col("n") >= least)
    narrow = stage(narrow, "warc-digests")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    markers = (
        narrow.join(firsts.select("digest", "first"), "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind"))
        .distinct()
    )
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"),
    )
    width = shuffle_width(pages.sparkSession)
    last = F.col("page_id").isNull()
    run = (
        markers.unionByName(rows)
        .withColumn("_last", last)
        .repartitionByRange(width, "_last", "page_id")
        .sortWithinPartitions("_last", "page_id", "kind", "url", "html")
        .select("page_id", "url", "html", "digest", "first", "kind")
    )

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = Rolled(folder, f"part-{part:06d}", ".warc.gz", roll)
        page, firsts_of, seen, records = object(), {}, set(), 0

        def closed():
            nonlocal records
            name, size = out.commit()
            row = (part, out.count - 1, name, size, records)
            records = 0
            return _batch([row], [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()], ["part", "seq", "name", "bytes", "records"])

        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                for r in batch.slice(a, 128).to_pylist():
                    if r["page_id"] != page:
                        page, firsts_of, seen = r["page_id"], {}, set()
                    if r["kind"] == 0:
                        firsts_of[r["digest"]] = r["first"]
                        continue
                    payload = r["html"].encode("utf-8")
                    digest = hashlib.sha256(payload).hexdigest()
                    long = len(payload) >= least
                    again = long and (digest in firsts_of or digest in seen)
                    refers = firsts_of.get(digest, page) if again else None
                    if long:
                        seen.add(digest)
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(press.compress(record_bytes(page, r["url"], payload, digest, refers, again)) + press.flush())
                    records += 1
                    if out.full:
                        yield closed()
        if records:
            yield closed()

    return stage(run.mapInArrow(write, MANIFEST), "warc-manifest")


READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives that the manifest lists."""
    spread = manifest.select("name").repartition(max(1, min(10_000, manifest.count())))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with opened(folder, name) as stream:
                    for raw in members(stream):
                        f, _, _ = parsed(raw)
                        rows.append((number(f.get("WARC-Page-ID")), int(f["payload-bytes"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], number(f.get("WARC-Refers-To-Page-ID"))))
                        if len(rows) == 10_000:
                            yield _batch(rows, kinds, READ)
                            rows = []
                yield _batch(rows, kinds, READ)

    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k,
         min(page_id) OVER (PARTITION BY payload_digest) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN first END AS refers_to
FROM q
"""
