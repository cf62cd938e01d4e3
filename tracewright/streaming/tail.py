"""A streaming source that follows logs as they grow (T-1).

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", folder).load()

Rows are file, at (the byte that the line begins at) and value. An offset says for every file up to where its whole lines
have been read, so each is read once, also over a restart: what follows the last line end is held back until its own line
end is there. Growth is read in ranges of `split` bytes, one task each; a range has the lines that begin in it.

Cases. A path that isn't there yet, or a folder without files, has no rows; names with a leading dot or underscore aren't logs; a
file that got shorter began anew and is read from its start (one that was rewritten with the same length or more isn't
noticed); a file that goes missing keeps its place; bytes that aren't UTF-8 are replaced. The offset has an entry for each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])
BLOCK = 1 << 20
SPLIT = 64 << 20


def file_system(path: str):
    """Arrow's file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_line_end(stream, size: int) -> int:
    """The place behind the last line end in the first `size` bytes, searched from behind a block at a time."""
    stop = size
    while stop > 0:
        start = max(0, stop - BLOCK)
        stream.seek(start)
        found = stream.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int
    end: int
    first: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split
        self.ends: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, top = file_system(self.path)
        info = system.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
        for f in found:
            if f.type != fs.FileType.File or f.base_name[:1] in ("_", ".") or self.sizes.get(f.path) == f.size:
                continue
            with system.open_input_file(f.path) as stream:
                self.ends[f.path] = last_line_end(stream, f.size)
            self.sizes[f.path] = f.size
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.ends = {**start, **self.ends}
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            begin = 0 if begin > stop else begin
            out += [Range(file, low, min(low + self.split, stop), stop, low == begin) for low in range(begin, stop, self.split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        with system.open_input_file(part.file) as stream:
            at = part.low if part.first else part.low - 1
            stream.seek(at)
            # behind the first range of a growth, lines begin after the first line end from the byte before on
            skip, rest = not part.first, b""
            while at < part.high or rest:
                block = stream.read(min(BLOCK, part.end - at - len(rest)))
                if not block:
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                starts, values = [], []
                for line in lines:
                    if skip:
                        skip = False
                    elif at < part.high:
                        starts.append(at)
                        values.append(line.removesuffix(b"\r").decode(errors="replace"))
                    at += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(values)), pa.array(starts, pa.int64()), pa.array(values)], schema=SCHEMA)
                if at >= part.high:
                    return


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)))
