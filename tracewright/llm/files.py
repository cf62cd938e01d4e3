"""Files in the shared folder, written and read by Python workers; checksums of framed records.

A worker writes under a temporary name that no other attempt has and renames when the file is
whole. The final name depends on the rows alone, so an attempt that runs again after a lost
executor replaces a file with the same bytes.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np


class Rolled:
    """Streams into files `<folder>/<stem>-<n><suffix>`; a new one once `limit` bytes are written."""

    def __init__(self, folder: str, stem: str, suffix: str, limit: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stem, self.suffix, self.limit = stem, suffix, limit
        self.count, self.stream, self.at = 0, None, 0

    def _temporary(self) -> str:
        return f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"

    def write(self, data) -> int:
        """The offset at which data starts."""
        if self.stream is None:
            self.name = f"{self.stem}-{self.count:05d}{self.suffix}"
            self.temp, self.at = self._temporary(), 0
            self.stream = self.fs.open_output_stream(self.temp, compression=None)
        start = self.at
        self.stream.write(data)
        self.at += len(data)
        return start

    @property
    def full(self) -> bool:
        return self.stream is not None and self.at >= self.limit

    def commit(self) -> tuple[str, int]:
        """Name and length of the file that is now whole."""
        self.stream.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        self.stream, self.count = None, self.count + 1
        return self.name, self.at

    def beside(self, suffix: str, data: bytes) -> None:
        """A whole file beside the one committed last."""
        temp = self._temporary()
        with self.fs.open_output_stream(temp, compression=None) as out:
            out.write(data)
        self.fs.move(temp, f"{self.folder}/{self.name}{suffix}")


def opened(folder: str, name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)


# --- CRC-32C over numpy blocks -------------------------------------------------------------

_BLOCK = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


_BYTE = _byte_table()


def _position_tables() -> np.ndarray:
    """[p, b]: what byte b adds to the checksum state when p bytes of a block follow it."""
    rows = [_BYTE]
    for _ in range(_BLOCK + 3):
        last = rows[-1]
        rows.append((last >> np.uint32(8)) ^ _BYTE[last & np.uint32(255)])
    return np.stack(rows)


_AHEAD = _position_tables()
_IN_BLOCK = np.ascontiguousarray(_AHEAD[:_BLOCK][::-1])
_FLAT = _IN_BLOCK.ravel()
_ROW = np.arange(_BLOCK, dtype=np.int32) * 256
#: The state's four bytes, carried over one block.
_CARRY = [[int(x) for x in _AHEAD[_BLOCK - 1 - k]] for k in range(4)]
_BYTE_INT = [int(x) for x in _BYTE]


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli). Blocks are reduced at once by table and exclusive-or, then chained.

    The first block is filled up with zeros in front, which leave a zero state as it is; the
    initial state is folded into the first four bytes instead.
    """
    if len(data) < 32:
        state = 0xFFFFFFFF
        for byte in data:
            state = (state >> 8) ^ _BYTE_INT[(state ^ byte) & 255]
        return state ^ 0xFFFFFFFF
    blocks = -(-len(data) // _BLOCK)
    cells = np.zeros(blocks * _BLOCK, dtype=np.uint8)
    at = len(cells) - len(data)
    cells[at:] = np.frombuffer(data, dtype=np.uint8)
    cells[at : at + 4] ^= 255
    parts = np.bitwise_xor.reduce(_FLAT[cells.reshape(blocks, _BLOCK) + _ROW], axis=1).tolist()
    a, b, c, d = _CARRY
    state = 0
    for part in parts:
        state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ part
    return state ^ 0xFFFFFFFF


def masked(checksum: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays sound."""
    return (((checksum >> 15) | (checksum << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(crc32c(head))), data, struct.pack("<I", masked(crc32c(data)))))


def frames(stream):
    """The records of a stream of frames, each checked."""
    while head := stream.read(12):
        length, check = struct.unpack("<QI", head)
        if masked(crc32c(head[:8])) != check:
            raise ValueError("a record's length fails its checksum")
        body = stream.read(length + 4)
        if len(body) != length + 4 or masked(crc32c(data := body[:length])) != int.from_bytes(body[length:], "little"):
            raise ValueError("a record fails its checksum")
        yield data
