"""Scalar functions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 27 code points of windows-1252 that differ from ISO-8859-1.
_C1 = "".join(map(chr, (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

ZIP_MAGIC, OLE_MAGIC = bytes.fromhex("504B0304"), bytes.fromhex("D0CF11E0A1B11AE1")


def unsigned(x: Column, offset: int, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset; bytes past the end count as zero."""
    got = F.rpad(F.hex(F.substring(x, offset + 1, size)), 2 * size, "0")
    turned = F.concat(*(F.substring(got, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("long")


def read_u16(x: Column, offset: int) -> Column:
    return unsigned(x, offset, 2).cast("int")


def read_u32(x: Column, offset: int) -> Column:
    return unsigned(x, offset, 4)


def read_i32(x: Column, offset: int) -> Column:
    n = unsigned(x, offset, 4)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def begins(x: Column, magic: bytes, offset: int = 0) -> Column:
    return F.substring(x, offset + 1, len(magic)) == F.lit(bytearray(magic))


def is_zip(x: Column) -> Column:
    return begins(x, ZIP_MAGIC)


def is_ole(x: Column) -> Column:
    return begins(x, OLE_MAGIC)


def decode_cp1252(x: Column) -> Column:
    return F.translate(F.decode(x, "ISO-8859-1"), _C1, _CP1252)


def decode_utf16le(x: Column) -> Column:
    return F.replace(F.decode(x, "UTF-16LE"), F.lit("\0"), F.lit(""))


def format_guid(x: Column) -> Column:
    """Sixteen bytes as ``{…}``, the first three fields little-endian."""
    h = F.hex(x)
    pair = lambda i: F.substring(h, 2 * i + 1, 2)
    field = lambda *at: F.concat(*(pair(i) for i in at))
    return F.concat(F.lit("{"), F.concat_ws("-", field(3, 2, 1, 0), field(5, 4), field(7, 6), field(8, 9), field(*range(10, 16))), F.lit("}"))


def dos_time(t: Column) -> Column:
    return F.shiftleft(F.hour(t), 11).bitwiseOR(F.shiftleft(F.minute(t), 5)).bitwiseOR(F.floor(F.second(t) / 2).cast("int"))


def dos_date(t: Column) -> Column:
    return F.shiftleft(F.greatest(F.year(t), F.lit(1980)) - 1980, 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
