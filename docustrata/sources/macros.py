"""Macro projects: compressed sources, module and reference records (public MS-OVBA format)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.binary import decode_cp1252
from ..functions.text import js_trim, lines, normalize_guid, safe_file_name, split_value


def decompress(data: bytes) -> bytes:
    """Unpacks a compressed container. A chunk with a wrong signature ends it; copies from before a chunk's start give zeros."""
    if not data or data[0] != 1:
        raise ValueError("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        header = struct.unpack_from("<H", data, at)[0]
        if header >> 12 & 7 != 3:
            break
        end = min(len(data), at + (header & 0xFFF) + 3)
        at += 2
        if not header >> 15:
            out += data[at:end]
            at = end
            continue
        begun = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    at = end
                    break
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max(4, (len(out) - begun - 1).bit_length()) if len(out) > begun else 4
                back, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                for _ in range(length):
                    out.append(out[-back] if back <= len(out) - begun else 0)
    return bytes(out)


@F.pandas_udf(BinaryType())
def unpacked(content: pd.Series, offset: pd.Series) -> pd.Series:
    """Source bytes of a module stream from a text offset, without trailing NULs; null where it can't be unpacked."""

    def one(x, at):
        try:
            return decompress(bytes(x[int(at) :])).rstrip(b"\0")
        except (ValueError, TypeError, struct.error):
            return None

    return pd.Series([one(x, at) for x, at in zip(content, offset, strict=True)])


@F.pandas_udf(BinaryType())
def best_unpacked(content: pd.Series) -> pd.Series:
    """Of all offsets where a container may begin, the source that scores best; null where none scores over 8."""
    import re

    def score(text: bytes) -> float:  # fixed values: what each mark of a source counts
        head = text[:2000]
        printable = sum(32 <= b < 127 or b in (9, 10, 13) for b in head)
        points = 50 * bool(re.search(rb"Attribute\s+VB_Name", text)) + 20 * bool(re.search(rb"(?i)\b(Sub|Function|Property|Dim|End)\b", text)) + 20 * bool(re.search(rb"(?i)Begin\s+VB\.", text))
        return points + (printable / len(head) if head else 0)

    def one(x):
        best, top = None, 8.0
        at = x.find(b"\x01") if x is not None else -1
        while at >= 0:
            try:
                text = decompress(x[at:]).rstrip(b"\0")
            except (ValueError, struct.error):
                text = b""
            if (s := score(text)) > top:
                best, top = text, s
            at = x.find(b"\x01", at + 1)
        return best

    return pd.Series([one(x) for x in content])


def _records(data: bytes, at: int) -> Iterator[tuple[int, bytes, int]]:
    """(id, payload, end) from an offset on; IndexError past the end."""
    while at < len(data):
        if at + 6 > len(data):
            raise IndexError("record header past the end")
        kind, size = struct.unpack_from("<HI", data, at)
        if at + 6 + size > len(data):
            raise IndexError("record past the end")
        at += 6 + size
        yield kind, data[at - size : at], at


def modules_at(data: bytes) -> int:
    """Offset of the modules record: id 0x000F, size 2, 1 to 999 modules, then the cookie record; -1 if there is none."""
    at = data.find(b"\x0f\x00\x02\x00\x00\x00")
    while at >= 0:
        if len(data) >= at + 14 and 0 < struct.unpack_from("<H", data, at + 6)[0] < 1000 and data[at + 8 : at + 14] == b"\x13\x00\x02\x00\x00\x00":
            return at
        at = data.find(b"\x0f\x00\x02\x00\x00\x00", at + 1)
    return -1


#: Ids that a module's records come in, in order; what is in brackets may lack.
_ORDER = [0x19, (0x47,), 0x1A, 0x32, 0x1C, 0x48, 0x31, 0x1E, 0x2C]


def dir_modules(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, stream, text offset, type id) of the modules. A record past the end drops all; an unexpected one ends the list."""
    at = modules_at(data)
    if at < 0:
        return []
    count = struct.unpack_from("<H", data, at + 6)[0]
    out: list[tuple[str, str, int, int]] = []
    try:
        records = _records(data, at + 16)
        for _ in range(count):
            got: dict[int, bytes] = {}
            kind, payload, _ = next(records)
            for want in _ORDER:
                if isinstance(want, tuple):
                    if kind == want[0]:
                        got[kind] = payload
                        kind, payload, _ = next(records)
                    continue
                if kind != want:
                    return out
                got[kind] = payload
                kind, payload, _ = next(records)
            type_id = 0
            while kind in (0x21, 0x22, 0x25, 0x28):
                type_id = kind if kind in (0x21, 0x22) else type_id
                kind, payload, _ = next(records)
            if kind != 0x2B:
                return out
            text = lambda k: got[k].decode("cp1252", "replace")
            out.append((text(0x19), text(0x1A), struct.unpack("<I", got[0x31][:4].ljust(4, b"\0"))[0], type_id))
    except (IndexError, StopIteration):
        return out if len(out) == count else []
    return out


def dir_references(data: bytes) -> list[tuple[str, str | None, str | None, str]]:
    """(kind, name, library id, record) of the records before the modules; a byte that begins no record is skipped.

    An original id that no reference record follows is a control's reference of its own.
    """
    import re

    end = modules_at(data)
    data = data[:end] if end > 0 else data
    clean = lambda b: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", "", b.decode("cp1252", "replace")).strip()

    def library(b: bytes) -> str | None:
        text = clean(b)
        text = text[m.start() :] if (m := re.search(r"(?i)\*?\\G\{", text)) else text
        return re.sub(r"[^\x20-\x7e]+$", "", text).strip() or None

    def sized(b: bytes) -> bytes:
        n = struct.unpack_from("<I", b)[0] if len(b) >= 4 else 0
        return b[4 : 4 + n] if 0 < n <= len(b) - 4 else b""

    out, at, name, original = [], 0, None, None
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HI", data, at)
        if at + 6 + size > len(data):
            at += 1
            continue
        payload, at = data[at + 6 : at + 6 + size], at + 6 + size
        if kind == 0x16:
            name = clean(payload)
            if data[at : at + 2] == b"\x3e\x00" and at + 6 <= len(data):
                n = struct.unpack_from("<I", data, at + 2)[0]
                if at + 6 + n <= len(data):
                    name = data[at + 6 : at + 6 + n].decode("utf-16-le", "replace").replace("\0", "").strip() or name
                    at += 6 + n
        elif kind == 0x33:
            original = library(payload)
        elif kind in (0x0D, 0x0E, 0x2F, 0x30):
            first = sized(payload)
            found = library(first)
            if kind == 0x0E and found:
                found = library(sized(payload[4 + len(first) :])) or found
            elif kind in (0x2F, 0x30) and not found:
                found = library(payload)
            if found or original or name:
                told = found or original
                out.append(({0x0D: "registered", 0x0E: "project"}.get(kind, "control"), name, told, f"record 0x{kind:04X} {told or ''}".strip()))
                name = original = None
        elif original:
            out.append(("control", name, original, f"record 0x0033 {original}"))
            name = original = None
    return out


def _decoded(decode, names, types):
    def run(batches):
        for batch in batches:
            own, rows, places = [], [], []
            for i, content in enumerate(batch.column("content")):
                try:
                    found = decode(decompress(content.as_py() or b""))
                except (ValueError, struct.error):
                    found = []
                own += [i] * len(found)
                places += range(len(found))
                rows += found
            taken = pa.array(own, pa.int64())
            key = [batch.column(c).take(taken) for c in ("doc_id", "container")]
            yield pa.RecordBatch.from_arrays([*key, pa.array(places, pa.int32()), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], ["doc_id", "container", "ord", *names])

    return run


def project_dir_modules(dirs: DataFrame) -> DataFrame:
    """Modules of ``dir`` streams (doc_id, container, content)."""
    return dirs.select("doc_id", "container", "content").mapInArrow(_decoded(dir_modules, ["name", "stream_name", "text_offset", "module_type_id"], [pa.string(), pa.string(), pa.int64(), pa.int32()]), "doc_id string, container string, ord int, name string, stream_name string, text_offset long, module_type_id int")


def project_dir_references(dirs: DataFrame) -> DataFrame:
    """References of ``dir`` streams, with guid, version and path taken from the library id."""
    out = dirs.select("doc_id", "container", "content").mapInArrow(_decoded(dir_references, ["kind", "name", "lib_id", "raw"], [pa.string()] * 4), "doc_id string, container string, ord int, kind string, name string, lib_id string, raw string")
    some = lambda pattern: F.get(F.filter(F.split("lib_id", "#"), lambda p: F.rlike(p, F.lit(pattern))), F.lit(0))
    return out.withColumns({"guid": normalize_guid(F.col("lib_id")), "version": some(r"^[0-9]+\.[0-9]+\z"), "path": some(r"(?i)[A-Z]:\\|/|\.dll|\.ocx|\.tlb|\.olb")})


def library_fields(x: Column) -> dict[str, Column]:
    parts = F.filter(F.transform(F.split(x, "#"), js_trim), lambda p: p != "")
    some = lambda pattern: F.get(F.filter(parts, lambda p: F.rlike(p, F.lit(pattern))), F.lit(0))
    return {"guid": normalize_guid(x), "version": some(r"^[0-9]+\.[0-9]+\z"), "path": some(r"(?i)[\\/]|\.dll|\.ocx|\.tlb|\.olb")}


def _project_lines(projects: DataFrame) -> DataFrame:
    text = decode_cp1252(F.col("content"))
    rows = projects.select("doc_id", "container", F.posexplode(lines(text)).alias("ord", "line")).withColumn("line", js_trim(F.col("line")))
    return rows.select("*", F.split_part("line", F.lit("="), F.lit(1)).alias("key"), split_value(F.col("line")).alias("value")).where("key <> '' and value <> ''")


def project_modules(projects: DataFrame) -> DataFrame:
    """Modules that ``PROJECT`` streams (doc_id, container, content) name; of one name, the last line counts."""
    kind = F.when(F.col("key") == "Module", "module").when(F.col("key") == "Class", "class").when(F.col("key") == "BaseClass", "form").when(F.col("key") == "Document", "document")
    name = F.when(F.col("key") == "Document", F.split_part("value", F.lit("/"), F.lit(1))).otherwise(F.col("value"))
    rows = _project_lines(projects).select("doc_id", "container", "ord", name.alias("name"), kind.alias("type")).where("type is not null")
    return rows.groupBy("doc_id", "container", F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "type"), "ord").alias("m")).select("doc_id", "container", "m.*")


def project_references(projects: DataFrame) -> DataFrame:
    """References, objects and packages that ``PROJECT`` streams name."""
    rows = _project_lines(projects).where(F.col("key").isin("Reference", "Object", "Package"))
    parts = F.filter(F.transform(F.split("value", "#"), js_trim), lambda p: p != "")
    named = F.filter(parts, lambda p: F.rlike(p, F.lit(r"^[A-Za-z_][A-Za-z0-9_. -]*\z")))
    library = F.nullif(F.regexp_extract("value", r"(?i)(\*?\\G\{[^}]+\}#[^#]+#[^#]+#?[^#]*)", 1), F.lit(""))
    fields = library_fields(F.col("value"))
    return rows.select("doc_id", "container", "ord", F.when(F.col("key") == "Reference", "registered").otherwise(F.lower("key")).alias("kind"), F.get(named, F.lit(0)).alias("name"), F.coalesce(library, fields["guid"]).alias("lib_id"), *(v.alias(k) for k, v in fields.items()), F.col("line").alias("raw"))


def references(streams: DataFrame) -> DataFrame:
    """References of the projects in compound streams, those of ``PROJECT``, then those of ``dir``, each (source, kind, name, lib_id, raw) of a container once.

    doc_id, container, ord, source, kind, name, lib_id, guid, version, path, raw.
    """
    lower = F.lower("path")
    said = project_references(streams.where(lower.isin("project", "vba/project"))).withColumn("source", F.lit("PROJECT"))
    bound = project_dir_references(streams.where(lower.isin("vba/dir", "dir"))).withColumn("source", F.lit("dir"))
    columns = ["doc_id", "container", "source", "ord", "kind", "name", "lib_id", "guid", "version", "path", "raw"]
    both = said.select(*columns).unionByName(bound.select(*columns)).withColumn("ord", F.when(F.col("source") == "dir", F.lit(1 << 20)).otherwise(F.lit(0)) + F.col("ord"))
    first = both.groupBy("doc_id", "container", "source", "kind", "name", "lib_id", "raw").agg(F.min_by(F.struct("ord", "guid", "version", "path"), "ord").alias("r"))
    return first.select("doc_id", "container", "r.ord", "source", "kind", "name", "lib_id", "r.guid", "r.version", "r.path", "raw")


def recovered_sources(streams: DataFrame, found: DataFrame) -> DataFrame:
    """Sources searched for in all streams of the containers that gave neither sources nor form streams: the last resort."""
    lower = F.lower("path")
    other = streams.where((lower != "project") & ~F.startswith(lower, F.lit("vba/"))).select("doc_id", "container")
    bare = streams.join(found.select("doc_id", "container").unionByName(other).distinct(), ["doc_id", "container"], "left_anti")
    name = F.coalesce(F.nullif(safe_file_name(F.element_at(F.split("path", "/"), -1)), F.lit("stream")), F.lit("module"))
    return bare.withColumn("source", best_unpacked("content")).where("source is not null").select("doc_id", F.col("ord").alias("file_ord"), F.concat(name, F.lit(".bas")).alias("name"), F.lit("vba").alias("kind"), F.concat("container", F.lit("/"), "path").alias("source_path"), decode_cp1252(F.col("source")).alias("text"), "container")


def module_sources(streams: DataFrame) -> DataFrame:
    """Sources of the modules in compound streams (doc_id, container, ord, path, content).

    Modules that a ``dir`` record places are unpacked from its offset; other streams under ``VBA/`` that
    ``PROJECT`` names are searched for the best container. Joins move keys and module streams only.
    """
    lower = F.lower("path")
    dirs, projects = streams.where(lower == "vba/dir"), streams.where(lower == "project")
    named = project_modules(projects).select("doc_id", "container", F.lower("name").alias("key"), "type")
    placed = project_dir_modules(dirs).withColumn("at", F.lower(F.concat(F.lit("vba/"), "stream_name")))
    code = streams.where(F.startswith(lower, F.lit("vba/")) & ~lower.isin("vba/dir", "vba/_vba_project")).select("doc_id", "container", F.col("ord").alias("stream_ord"), lower.alias("at"), "path", "content")
    by_name = named.withColumnRenamed("type", "t1")
    exact = placed.join(code, ["doc_id", "container", "at"]).withColumn("key", F.lower("name")).join(by_name, ["doc_id", "container", "key"], "left")
    exact = exact.withColumn("source", unpacked("content", "text_offset")).where("source is not null").select("doc_id", "container", "stream_ord", "at", "name", F.coalesce("t1", F.when(F.col("module_type_id") == 0x22, "class").otherwise("module")).alias("type"), "source", F.concat("path", F.lit(" @ 0x"), F.lower(F.hex("text_offset"))).alias("source_path"))
    left = code.join(exact.select("doc_id", "container", "at"), ["doc_id", "container", "at"], "left_anti").withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("key", F.lower("name"))
    scanned = left.join(named, ["doc_id", "container", "key"]).withColumn("source", best_unpacked("content")).where("source is not null").select("doc_id", "container", "stream_ord", "at", "name", "type", "source", F.concat("path", F.lit(" (recovered by scan)")).alias("source_path"))
    both = exact.unionByName(scanned)
    ending = F.when(F.col("type") == "class", ".cls").when(F.col("type") == "form", ".frm").otherwise(".bas")
    found = both.select("doc_id", "container", F.col("stream_ord").alias("file_ord"), F.concat("name", ending).alias("name"), F.when(F.col("type") == "form", "frm").otherwise("vba").alias("kind"), F.concat("container", F.lit("/"), "source_path").alias("source_path"), decode_cp1252(F.col("source")).alias("text"))
    return found.unionByName(recovered_sources(streams, found)).drop("container")
