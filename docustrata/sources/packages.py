"""ZIP packages by their directory: the end record, the entries, and the bytes of one entry, each read from where it lies.

``read(offset, length)`` is all that is asked of a package, so a file in a store is read in ranges: its end, its
directory and the entries that are wanted, never as a whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

Read = Callable[[int, int], bytes]

# Marks of the format's records, and how far from the end the last one may begin.
_END, _END64, _AT64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_REACH = 65_557
STORED, DEFLATED = 0, 8


class BadPackage(ValueError):
    """What is no package, or is damaged."""


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    compressed_size: int
    size: int
    offset: int


def end_record(read: Read, size: int) -> tuple[int, int, int]:
    """(entries, offset and length of the directory) as the last end record says, those of large packages included."""
    begin = max(0, size - END_REACH)
    tail = read(begin, size - begin)
    at = tail.rfind(_END)
    if at < 0 or at + 22 > len(tail):
        raise BadPackage("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFFFFFF in (length, offset) or count == 0xFFFF:
        pointer = read(max(0, begin + at - 20), 20)
        if pointer[:4] == _AT64:
            record = read(struct.unpack_from("<Q", pointer, 8)[0], 56)
            if record[:4] == _END64 and len(record) == 56:
                count, length, offset = struct.unpack_from("<QQQ", record, 32)
    if offset + length > size:
        raise BadPackage("directory past the end")
    return count, offset, length


def _large(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that stand in the extra field for large packages."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            rest = iter(struct.unpack_from(f"<{min(n, len(extra) - at - 4) // 8}Q", extra, at + 4))
            return [next(rest, v) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return values


def entries(read: Read, size: int) -> list[Entry]:
    """Entries in the order of the directory; a record that is none ends it."""
    count, offset, length = end_record(read, size)
    data, at, out = read(offset, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != _ENTRY or at + 46 > len(data):
            break
        method, packed, plain = struct.unpack_from("<H8xII", data, at + 10)
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        (local,) = struct.unpack_from("<I", data, at + 42)
        more = data[at + 46 + name : at + 46 + name + extra]
        plain, packed, local = _large(more, [plain, packed, local])
        out.append(Entry(data[at + 46 : at + 46 + name].decode("utf-8", "replace"), method, packed, plain, local))
        at += 46 + name + extra + comment
    return out


def unpack(read: Read, entry: Entry, most: int) -> bytes:
    """An entry's bytes, stored or deflated; ValueError where they can't be had or exceed ``most``."""
    if entry.method not in (STORED, DEFLATED):
        raise BadPackage(f"unsupported method {entry.method}")
    if entry.size > most or entry.compressed_size > most:
        raise BadPackage("too large")
    head = read(entry.offset, 30)
    if head[:4] != _LOCAL or len(head) < 30:
        raise BadPackage("no local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    data = read(entry.offset + 30 + name + extra, entry.compressed_size)
    if len(data) < entry.compressed_size:
        raise BadPackage("entry past the end")
    if entry.method == STORED:
        return data
    engine = zlib.decompressobj(-15)
    try:
        out = engine.decompress(data, most + 1)
    except zlib.error as e:
        raise BadPackage(str(e)) from None
    if len(out) > most:
        raise BadPackage("too large")
    if not engine.eof:
        raise BadPackage("compressed data ends early")
    return out


def reader(content: bytes) -> Read:
    """Ranges of bytes in memory."""
    return lambda offset, length: content[offset : offset + length]


class Writer:
    """A package written front to back: entries as they are (stored), then the directory. Only the directory is held.

    ``write``: takes bytes; ``time`` and ``date``: the entries' stamp. A name that comes again gets a number.
    """

    def __init__(self, write: Callable[[bytes], object], time: int, date: int):
        self._write, self._stamp = write, struct.pack("<HH", time, date)
        self.size, self.entries, self._directory, self._names = 0, 0, [], {}

    def _put(self, data: bytes) -> None:
        self._write(data)
        self.size += len(data)

    def add(self, name: str, data: bytes) -> None:
        n = self._names[name] = self._names.get(name, 0) + 1
        raw = (name if n == 1 else f"{name}~{n}").encode()
        at = self.size
        if at + len(data) > 0xFFFFFFFE or self.entries == 0xFFFE:
            raise BadPackage("a package of over 4 GB or 65,534 entries")
        # fixed values: version 2.0, names in UTF-8, stored
        common = struct.pack("<HHH", 20, 0x0800, STORED) + self._stamp + struct.pack("<IIIHH", zlib.crc32(data), len(data), len(data), len(raw), 0)
        self._put(_LOCAL + common + raw)
        self._put(data)
        self._directory.append(_ENTRY + struct.pack("<H", 0x0314) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw)
        self.entries += 1

    def close(self) -> None:
        at = self.size
        for record in self._directory:
            self._put(record)
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, self.entries, self.entries, self.size - at, at, 0))
