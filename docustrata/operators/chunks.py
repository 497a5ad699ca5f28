"""Scans of byte streams of any size, held as chunks (key, start, content): each chunk is scanned by itself, and only what touches a border is shuffled.

Chunks of a stream follow each other without gaps and have an even length of 32 bytes at least, the last one excepted. ``chunked`` cuts
streams that fit a row; the data source ``byte_chunks`` reads larger files so.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binary import find_guids

_GUID = 16


def chunked(rows: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Streams cut into chunks of ``size`` bytes (even, 32 at least); null and empty ones have none."""
    if size < 32 or size % 2:
        raise ValueError("chunks have an even size of 32 bytes at least")
    starts = F.sequence(F.lit(0), F.octet_length(column) - 1, F.lit(size))
    each = rows.where(F.octet_length(column) > 0).select(key, F.col(column).alias("content"), F.explode(starts).alias("start"))
    return each.select(F.col(key).alias("key"), F.col("start").cast("long").alias("start"), F.substring("content", F.col("start") + 1, F.lit(size)).alias("content"))


def _bytes(x) -> bytes:
    return x.as_py() or b""


def histogram(chunks: DataFrame) -> DataFrame:
    """(key, byte, n): how often each byte occurs in a stream; counted per batch of chunks, then added."""
    kind = chunks.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            total: dict = {}
            for k, x in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                total[k] = total.get(k, 0) + np.bincount(np.frombuffer(_bytes(x), np.uint8), minlength=256)
            rows = [(k, int(b), int(n[b])) for k, n in total.items() for b in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column("key").type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["key", "byte", "n"])

    return chunks.select("key", "content").mapInArrow(run, f"key {kind}, byte int, n long").groupBy("key", "byte").agg(F.sum("n").alias("n"))


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """(key, size, entropy in bits a byte, zero_bytes) of streams."""
    counts = histogram(chunks).groupBy("key").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.log2("n")).alias("w"), F.sum(F.when(F.col("byte") == 0, F.col("n")).otherwise(0)).alias("zero_bytes"))
    return counts.select("key", "size", (F.log2("size") - F.col("w") / F.col("size")).alias("entropy"), "zero_bytes")


def _pieces(data: bytes) -> list[tuple[str, int, int, str]]:
    """(encoding, from, to, text) of runs of printable characters that are long enough or touch a border."""
    out = [("ASCII", m.start(), m.end(), m.group().decode("ascii")) for m in re.finditer(rb"[\x20-\x7e]+", data) if m.end() - m.start() >= 4 or m.start() == 0 or m.end() == len(data)]
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    inside = np.concatenate([[False], (words >= 0x20) & (words <= 0x7E), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 4 or a == 0 or b == len(words):
            out.append(("UTF-16LE", 2 * a, 2 * b, data[2 * a : 2 * b].decode("utf-16-le")))
    return out


def chunk_strings(chunks: DataFrame) -> DataFrame:
    """(key, encoding, offset, value): the strings of whole streams; those that go over borders are put together from their pieces."""
    kind = chunks.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, start, x in zip(batch.column("key"), batch.column("start").to_pylist(), batch.column("content"), strict=True):
                data = _bytes(x)
                got = _pieces(data)
                own = pa.array([k.as_py()] * len(got), batch.column("key").type)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([g[0] for g in got], pa.string()), pa.array([start + g[1] for g in got], pa.int64()), pa.array([start + g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.string()), pa.array([g[1] == 0 or g[2] >= len(data) - 1 for g in got], pa.bool_())],
                    ["key", "encoding", "a", "b", "value", "border"],
                )

    found = chunks.select("key", "start", "content").mapInArrow(run, f"key {kind}, encoding string, a long, b long, value string, border boolean")
    w = Window.partitionBy("key", "encoding").orderBy("a")
    parts = found.where("border").withColumn("new", F.coalesce(F.lag("b").over(w) != F.col("a"), F.lit(True)).cast("long"))
    parts = parts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("key", "encoding", "run").agg(F.min("a").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "value"))), lambda p: p["value"]), "").alias("value"))
    inner = found.where("not border").select("key", "encoding", F.col("a").alias("offset"), "value")
    return inner.unionByName(whole.select("key", "encoding", "offset", "value")).where(F.length("value") >= 4)


def _likely(data: bytes) -> list[int]:
    """Offsets of 16 bytes with the marks of a GUID, overlapping ones included."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - _GUID + 1
    if n <= 0:
        return []
    at = np.flatnonzero(((b[8 : 8 + n] & 0xC0) == 0x80) & ((b[7 : 7 + n] >> 4) <= 5))
    return [int(i) for i in at if data[i : i + _GUID] not in (b"\0" * _GUID, b"\xff" * _GUID)]


def _clusters(at: list[int]) -> list[list[int]]:
    """Offsets in groups: what is a GUID's length or more behind the one before begins a new one."""
    out: list[list[int]] = []
    for i in at:
        if out and i - out[-1][-1] < _GUID:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def chunk_guids(chunks: DataFrame) -> DataFrame:
    """(key, offset, guid): of the places that look like a GUID, from the front, those that overlap no earlier one, over whole streams.

    Groups of overlapping places that lie inside a chunk are settled there; those at borders meet in one group by their offsets.
    """
    kind = chunks.schema["key"].dataType.simpleString()

    def guid(data: bytes) -> str:
        return find_guids(data)[0][1]

    def run(batches):
        for batch in batches:
            rows = []
            for k, start, x in zip(batch.column("key").to_pylist(), batch.column("start").to_pylist(), batch.column("content"), strict=True):
                data = _bytes(x)
                for own in _clusters(_likely(data)):
                    free, closed = own[0], own[0] >= _GUID and own[-1] + _GUID <= len(data) - _GUID + 1
                    for i in own:
                        if not closed or i >= free:
                            rows.append((k, start + i, guid(data[i : i + _GUID]), closed, None, None))
                            free = i + _GUID
                rows.append((k, start, None, False, data[: _GUID - 1], None))
                rows.append((k, start + len(data), None, False, None, data[-(_GUID - 1) :]))
            types = (batch.column("key").type, pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "offset", "guid", "closed", "head", "tail"])

    def over(batches):
        """Places that begin before a border and end behind it."""
        for batch in batches:
            rows = []
            for k, at, tail, head in zip(*(batch.column(c).to_pylist() for c in ("key", "offset", "tail", "head")), strict=True):
                data = tail + head
                rows += [(k, at - len(tail) + i, guid(data[i : i + _GUID])) for i in _likely(data) if i < len(tail) < i + _GUID]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column("key").type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["key", "offset", "guid"])

    found = chunks.select("key", "start", "content").mapInArrow(run, f"key {kind}, offset long, guid string, closed boolean, head binary, tail binary")
    tails = found.where("tail is not null").select("key", "offset", "tail")
    heads = found.where("head is not null").select("key", "offset", "head")
    between = tails.join(heads, ["key", "offset"]).select("key", "offset", "tail", "head").mapInArrow(over, f"key {kind}, offset long, guid string")
    open_ = found.where("guid is not null and not closed").select("key", "offset", "guid").unionByName(between)
    w = Window.partitionBy("key").orderBy("offset")
    groups = open_.withColumn("new", F.coalesce(F.col("offset") - F.lag("offset").over(w) >= _GUID, F.lit(True)).cast("long")).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = groups.groupBy("key", "g").agg(F.array_sort(F.collect_list(F.struct("offset", "guid"))).alias("s"))
    none = F.expr("cast(array() as array<struct<offset:bigint,guid:string>>)")
    taken = F.aggregate("s", none, lambda t, x: F.when((F.size(t) == 0) | (x["offset"] >= F.element_at(t, -1)["offset"] + _GUID), F.concat(t, F.array(x))).otherwise(t))
    settled = one.select("key", F.explode(taken).alias("x")).select("key", "x.offset", "x.guid")
    return found.where("closed").select("key", "offset", "guid").unionByName(settled)
