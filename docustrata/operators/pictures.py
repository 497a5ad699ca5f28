"""Pictures in binary streams: found by how they begin, measured by their format, unpacked from the wrappers of form designers.

A stream is read once from the front: one pattern finds the next place where any format may begin, and that
format's function says how long it is. What it takes is skipped. Compound files inside a stream are opened and searched too.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

from ..sources.containers import OLE_MARK, CompoundFile


@dataclass(frozen=True)
class Picture:
    """What begins at an offset: its kind, the bytes it takes there, and its own bytes where they differ from those."""

    extension: str
    mime_type: str
    length: int
    label: str
    rebuilt: bytes | None = None


# How pictures and their wrappers begin, and limits of what is accepted.
_PICTURE_CLASS = bytes.fromhex("0452E30B918FCE119DE300AA004BB851")
_WRAPPER = b"\x6c\x74\x00\x00"
_PNG, _PNG_END = b"\x89PNG\r\n\x1a\n", b"IEND\xae\x42\x60\x82"
_DIB_SIZES, _DIB_BITS, _DIB_SIDE, _DIB_PACKING = (40, 52, 56, 108, 124), (1, 4, 8, 16, 24, 32), 20_000, 6
_OPEN_END, _ICONS, _NESTED = 2_000_000, 64, 8
_NEXT = re.compile(rb"\x89PNG|\xff\xd8|GIF8|BM")


def _u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def _until(data: bytes, at: int, mark: bytes, skip: int) -> int | None:
    end = data.find(mark, at + skip)
    return None if end < 0 else end + len(mark) - at


def _png(data, at, inner):
    n = _until(data, at, _PNG_END, 8)
    return n and Picture("png", "image/png", n, "PNG image")


def _jpeg(data, at, inner):
    n = _until(data, at, b"\xff\xd9", 2)
    return n and Picture("jpg", "image/jpeg", n, "JPEG image")


def _gif(data, at, inner):
    n = _until(data, at, b";", 13)
    return n and Picture("gif", "image/gif", n, "GIF image")


def _bmp(data, at, inner):
    n = _u32(data, at + 2)
    return Picture("bmp", "image/bmp", n, "BMP image") if at + 14 < len(data) and 14 < n <= len(data) - at else None


def _icon(data, at, inner):
    """Directories of icons and cursors; inside a wrapper every entry must have bytes behind the directory."""
    count, kind = _u16(data, at + 4), _u16(data, at + 2)
    head = 6 + 16 * count
    if at + 6 >= len(data) or not 0 < count < _ICONS or at + head > len(data):
        return None
    entries = [(_u32(data, at + 14 + 16 * i), _u32(data, at + 18 + 16 * i)) for i in range(count)]
    n = max(head, *(size + offset for size, offset in entries))
    if n > len(data) - at or inner and any(not size or offset < head for size, offset in entries):
        return None
    return Picture("ico", "image/x-icon", n, "ICO icon") if kind == 1 else Picture("cur", "image/x-icon", n, "CUR cursor")


def _open_ended(data: bytes, at: int, skip: int, most: int) -> int:
    """Length up to where another picture may begin, for formats that do not say it."""
    later = _NEXT.search(data, at + skip)
    return min(later.start() - at if later else most, len(data) - at)


def _tiff(data, at, inner):
    n = _open_ended(data, at, 8, _OPEN_END)
    return Picture("tif", "image/tiff", n, "TIFF image") if n > 32 else None


def _placeable(data, at, inner):
    if not inner and at + 22 >= len(data):
        return None
    return Picture("wmf", "image/wmf", _open_ended(data, at, 22, len(data) if inner else _OPEN_END), "Placeable WMF image")


def _is_emf(data: bytes, at: int) -> bool:
    return _u32(data, at) == 1 and at + 88 < len(data) and data[at + 40 : at + 44] == b" EMF"


def _emf(data, at, inner):
    n = _u32(data, at + 48)
    return Picture("emf", "image/emf", n, "EMF image") if _is_emf(data, at) and 88 < n <= len(data) - at else None


def _dib(data, at, inner):
    """A bitmap without its file header, which is put before it."""
    if at + 40 > len(data):
        return None
    head, width, height, planes, bits, packing, stated = struct.unpack_from("<IiiHHII", data, at)
    colours = _u32(data, at + 32)
    if not (head in _DIB_SIZES and 0 < width <= _DIB_SIDE and 0 < abs(height) <= _DIB_SIDE and planes == 1 and bits in _DIB_BITS and packing <= _DIB_PACKING):
        return None
    pixels = head + 4 * ((colours or 1 << bits) if bits <= 8 else 0)
    n = pixels + (stated or (bits * width + 31) // 32 * 4 * abs(height))
    if n > len(data) - at:
        return None
    return Picture("bmp", "image/bmp", n, "DIB rebuilt as BMP" if inner else "DIB image rebuilt as BMP", b"BM" + struct.pack("<IIII", 14 + n, 0, 14 + pixels, 0)[:12] + data[at : at + n])


def _unwrapped(payload: bytes) -> Picture | None:
    """The picture that a wrapper's payload begins with; metafiles without a length take all of it."""
    m = _START.match(payload)
    if m and m.lastgroup in _PLAIN and (got := _FORMATS[m.lastgroup](payload, 0, True)):
        return got if got.rebuilt else replace(got, rebuilt=payload[: got.length])
    if got := _dib(payload, 0, True):
        return got
    words = _u32(payload, 6)
    if len(payload) >= 18 and _u16(payload, 0) in (1, 2) and _u16(payload, 2) == 9 and _u16(payload, 4) >= 0x100 and 9 < words and 2 * words <= len(payload):
        return Picture("wmf", "image/wmf", len(payload), "WMF image", payload)
    if _is_emf(payload, 0):
        return Picture("emf", "image/emf", len(payload), "EMF image", payload)
    return None


def _wrapped(data, at, inner):
    """A StdPicture: mark, size, payload. What is not known keeps its bytes."""
    size = _u32(data, at + 4)
    if inner or at + 8 > len(data) or not size or at + 8 + size > len(data):
        return None
    payload = data[at + 8 : at + 8 + size]
    got = _unwrapped(payload)
    if got is None:
        return Picture("picture.bin", "application/octet-stream", 8 + size, "MS-OFORMS StdPicture payload", payload)
    return replace(got, length=8 + size, label=f"MS-OFORMS StdPicture {got.label}")


def _classed(data, at, inner):
    got = None if inner or data[at + 16 : at + 20] != _WRAPPER else _wrapped(data, at + 16, False)
    return got and replace(got, length=16 + got.length, label=f"MS-OFORMS GuidAndPicture {got.label}")


_FORMATS = {"classed": _classed, "wrapped": _wrapped, "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "icon": _icon, "tiff": _tiff, "wmf": _placeable, "emf": _emf, "dib": _dib}
_PLAIN = ("png", "jpeg", "gif", "bmp", "icon", "tiff", "wmf", "emf")
_START = re.compile(
    b"(?P<classed>" + re.escape(_PICTURE_CLASS) + b")|(?P<wrapped>" + _WRAPPER + b")|(?P<png>" + re.escape(_PNG)
    + rb")|(?P<jpeg>\xff\xd8)|(?P<gif>GIF8[79]a)|(?P<bmp>BM)|(?P<icon>\x00\x00[\x01\x02]\x00)|(?P<tiff>II\*\x00|MM\x00\*)|(?P<wmf>\xd7\xcd\xc6\x9a)"
    + rb"|(?P<emf>\x01\x00\x00\x00(?s:.{36}) EMF)|(?P<dib>[\x28\x34\x38\x6c\x7c]\x00\x00\x00(?s:.{8})\x01\x00)"
)


def _literal(mark: bytes):
    return lambda data, at: data.find(mark, at)


def _search(pattern: bytes):
    search = re.compile(pattern).search
    return lambda data, at: m.start() if (m := search(data, at)) else -1


#: The alternatives of _START one by one, so that each is looked for as fast as the bytes are that lead it; no two match at one place.
_EACH = [
    ("classed", _literal(_PICTURE_CLASS)), ("wrapped", _literal(_WRAPPER)), ("png", _literal(_PNG)), ("jpeg", _literal(b"\xff\xd8")), ("gif", _search(rb"GIF8[79]a")), ("bmp", _literal(b"BM")),
    ("icon", _literal(b"\x00\x00\x01\x00")), ("icon", _literal(b"\x00\x00\x02\x00")), ("tiff", _literal(b"II*\x00")), ("tiff", _literal(b"MM\x00*")), ("wmf", _literal(b"\xd7\xcd\xc6\x9a")),
    ("emf", _search(rb"\x01\x00\x00\x00(?s:.{36}) EMF")), ("dib", _search(rb"[\x28\x34\x38\x6c\x7c]\x00\x00\x00(?s:.{8})\x01\x00")),
]


def _starts(data: bytes):
    """A function from an offset to (place, format) of the first start there or behind it, None behind the last; offsets must not fall."""
    ahead = [(place, i) for i, (_, find) in enumerate(_EACH) if (place := find(data, 0)) >= 0]

    def first(at: int) -> tuple[int, str] | None:
        while ahead:
            place, i = min(ahead)
            if place >= at:
                return place, _EACH[i][0]
            ahead.remove((place, i))
            if (place := _EACH[i][1](data, at)) >= 0:
                ahead.append((place, i))
        return None

    return first


def _found(data: bytes) -> Iterator[tuple[int, Picture]]:
    at, first = 0, _starts(data)
    while start := first(at):
        at, kind = start
        got = _FORMATS[kind](data, at, False)
        if got:
            yield at, got
        at += max(got.length, 1) if got else 1


def to_hex(n: int, width: int = 4) -> str:
    return f"0x{n:0{width}X}"


def stream_name(path: str) -> str:
    """A stream's path with its control characters spelt out."""
    return path.replace("\x01", "0x01 ").replace("\x03", "0x03 ")


def find_media(data: bytes, depth: int = 0) -> list[tuple[int, str, str, int, bytes, str]]:
    """(offset, extension, MIME type, length, bytes, place) of the pictures of a stream, then of those in compound files inside it.

    ``length`` is what a picture takes in its stream. Compound files are opened _NESTED deep at most.
    """
    out = [(at, p.extension, p.mime_type, p.length, p.rebuilt if p.rebuilt is not None else data[at : at + p.length], f"{p.label} at {to_hex(at)}") for at, p in _found(data)]
    at = data.find(OLE_MARK)
    while at >= 0 and depth < _NESTED:
        step = 1
        try:
            for path, stream in CompoundFile(data[at:]).streams():
                out += [(at, e, t, n, b, f"Nested OLE at {to_hex(at)} / {stream_name(path)} / {place}") for _, e, t, n, b, place in find_media(stream, depth + 1)]
            step = 512
        except (ValueError, struct.error, IndexError):
            pass  # the mark alone is no compound file
        at = data.find(OLE_MARK, at + step)
    return out


def _size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def find_signatures(data: bytes) -> list[tuple[int, str, str]]:
    """(offset, label, detail) of pictures, of wrappers (whose payload is looked into) and of compound files."""
    out, at = [], 0
    mark = re.compile(_START.pattern + b"|(?P<ole>" + re.escape(OLE_MARK) + b")", _START.flags)
    while m := mark.search(data, at):
        at, step = m.start(), 1
        if m.lastgroup == "ole":
            out.append((at, "Nested OLE compound file", OLE_MARK.hex(" ").upper()))
        elif m.lastgroup == "wrapped" and at + 8 <= len(data) and 0 < _u32(data, at + 4) <= len(data) - at - 8:
            out.append((at, "MS-OFORMS StdPicture", f"{_size_text(_u32(data, at + 4))} picture payload"))
            step = 8
        elif m.lastgroup != "wrapped" and (got := _FORMATS[m.lastgroup](data, at, False)):
            own = got.rebuilt is not None
            out.append((at, got.label, _size_text(len(got.rebuilt) if own else got.length) + " extracted/rebuilt" * own))
            step = max(got.length, 1)
        at += step
    return out


def std_picture_at(data: bytes, start: int) -> int:
    """Where the first wrapper with a payload begins, from an offset on; -1 if nowhere."""
    at = data.find(_WRAPPER, start)
    while at >= 0 and not (at + 8 <= len(data) and 0 < _u32(data, at + 4) <= len(data) - at - 8):
        at = data.find(_WRAPPER, at + 1)
    return at
