"""Profiles of binary streams: entropy, strings, identifiers, signatures, media."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pictures


def _bits(data: np.ndarray) -> float:
    n = np.bincount(data, minlength=256)
    n = n[n > 0]
    return float(np.log2(len(data)) - (n * np.log2(n)).sum() / len(data)) if len(data) else 0.0


def _profiled(batches):
    """Size, entropy and zero bytes of each content: a histogram of 256 counters a row, inside the task."""
    for batch in batches:
        key, column = batch.column(0), batch.column(1)
        data = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column]
        yield pa.RecordBatch.from_arrays([key, pa.array([len(d) for d in data], pa.int64()), pa.array([_bits(d) for d in data], pa.float64()), pa.array([int((d == 0).sum()) for d in data], pa.int64())], [batch.schema.names[0], "size", "entropy", "zero_bytes"])


def byte_profile(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Size, Shannon entropy in bits a byte, and zero bytes of every row; zeros for null or empty. Text counts by its UTF-8 bytes."""
    return rows.select(key, F.col(column).cast("binary").alias("content")).mapInArrow(_profiled, f"`{key}` {rows.schema[key].dataType.simpleString()}, size long, entropy double, zero_bytes long")


def entropy(rows: DataFrame, key: str, column: str) -> DataFrame:
    return byte_profile(rows, key, column).select(key, "entropy")


def _scan(find, names: list[str], types: list[pa.DataType]):
    """Rows that ``find`` yields for each (key, content) of a batch."""

    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                got = list(find(content.as_py() or b""))
                rows += got
                keys += [key.as_py()] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [batch.schema.names[0], *names])

    return run


def _each(rows: DataFrame, key: str, column: str, find, fields: str, types: list[pa.DataType]) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    return rows.select(key, column).mapInArrow(_scan(find, names, types), f"`{key}` {rows.schema[key].dataType.simpleString()}, {fields}")


_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){4}")


def find_strings(data: bytes) -> list[tuple[str, int, str]]:
    """(encoding, offset, value) of runs of four and more printable ASCII characters, one byte each or two at even offsets, by offset."""
    out = [("ASCII", m.start(), m.group().decode("ascii")) for m in re.finditer(rb"[\x20-\x7e]{4,}", data)]
    if not _WIDE.search(data):  # no run of two-byte characters at any offset: the common case, told faster than the runs at even ones are found
        return out
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    inside = np.concatenate([[False], (words >= 0x20) & (words <= 0x7E), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    out += [("UTF-16LE", 2 * int(a), data[2 * a : 2 * b].decode("utf-16-le")) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 4]
    return sorted(dict.fromkeys(out), key=lambda s: s[1])


def find_guids(data: bytes) -> list[tuple[int, str]]:
    """(offset, GUID) of 16-byte windows with the marks of one; the windows do not overlap."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 16:
        return []
    n = len(b) - 15
    likely = np.flatnonzero(((b[8 : 8 + n] & 0xC0) == 0x80) & ((b[7 : 7 + n] >> 4) <= 5))
    out, free = [], 0
    for at in likely.tolist():
        window = data[at : at + 16]
        if at >= free and window not in (b"\0" * 16, b"\xff" * 16):
            h = window.hex().upper()
            out.append((at, "{%s-%s-%s-%s-%s}" % (bytes.fromhex(h[:8])[::-1].hex().upper(), bytes.fromhex(h[8:12])[::-1].hex().upper(), bytes.fromhex(h[12:16])[::-1].hex().upper(), h[16:20], h[20:])))
            free = at + 16
    return out


def strings(rows: DataFrame, key: str, column: str) -> DataFrame:
    return _each(rows, key, column, find_strings, "encoding string, offset long, value string", [pa.string(), pa.int64(), pa.string()])


def guids(rows: DataFrame, key: str, column: str) -> DataFrame:
    return _each(rows, key, column, find_guids, "offset long, guid string", [pa.int64(), pa.string()])


def media(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Pictures in binary streams, in the order they are found: offset, extension, mime_type, length, bytes, place."""
    return _each(rows, key, column, pictures.find_media, "offset long, extension string, mime_type string, length long, bytes binary, place string", [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()])


def signatures(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Pictures, their wrappers and compound files in binary streams: offset, label, detail."""
    return _each(rows, key, column, pictures.find_signatures, "offset long, label string, detail string", [pa.int64(), pa.string(), pa.string()])


# Bit -> property of a form's and of a site's property mask (public MS-OFORMS format).
FORM_FLAGS = {1: "BackColor", 2: "ForeColor", 3: "NextAvailableID", 6: "BooleanProperties", 7: "BorderStyle", 8: "MousePointer", 9: "ScrollBars", 10: "DisplayedSize", 11: "LogicalSize", 12: "ScrollPosition", 13: "GroupCount", 15: "MouseIcon", 16: "Cycle", 17: "SpecialEffect", 18: "BorderColor", 19: "Caption", 20: "Font", 21: "Picture", 22: "Zoom", 23: "PictureAlignment", 24: "PictureTiling", 25: "PictureSizeMode", 26: "ShapeCookie", 27: "DrawBuffer"}
GENERIC_FLAGS = {b: f"Property{b}" for b in range(32)} | {10: "Size/position", 11: "Caption/name string", 12: "Font", 13: "Picture/icon", 14: "Mouse/icon data", 15: "Extra data"}
SITE_FLAGS = {0: "Name", 1: "Tag", 2: "Position", 3: "ControlTipText", 4: "RuntimeLicKey", 5: "ControlSource", 6: "RowSource", 7: "Enabled/visibility flags"}


def mask_flags(mask: Column, flags: dict[int, str]) -> Column:
    """Names of the bits that are set, by bit."""
    return F.filter(F.array(*(F.when(F.getbit(mask, F.lit(b)) == 1, F.lit(n)) for b, n in flags.items())), lambda x: x.isNotNull())
