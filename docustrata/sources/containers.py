"""Rows from containers: ZIP packages and compound files, decoded inside tasks, one document at a time.

Spark reads and deals the documents (``binaryFile``); a decoder sees one document's bytes and yields its
parts as rows, which stay in the same partition. A damaged container gives a row in ``error`` and no others.
"""

from __future__ import annotations

import codecs
import struct
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import OLE_MAGIC as OLE_MARK
from ..functions.binary import is_ole, is_zip
from . import packages

PARTS = "doc_id string, ord int, path string, method int, compressed_size long, size long, content binary, error string"
#: Largest part that is unpacked: a guard against bombs. A larger one gives a row without content and an error.
MOST = 1 << 30
#: Bytes of content in a batch that a task hands on.
BATCH = 16 << 20


def raw_documents(spark, path: str, glob: str = "*") -> DataFrame:
    """Documents of a folder: doc_id (digest of the path), path, file_name, content, format (raw, zip, ole, unsupported)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return with_format(found.select(F.sha2("path", 256).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content"))


def addressed_documents(addresses: DataFrame) -> DataFrame:
    """The documents at addresses (path), as ``raw_documents`` gives those of a folder.

    Tasks read them, many to a task however small they are, and the driver holds no list of them. Addresses are what ``pyarrow.fs`` opens.
    """

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    def read(batches):
        from pyarrow import fs

        stores: dict[str, tuple] = {}
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                top, _, name = path.rpartition("/")
                if top not in stores:
                    stores[top] = fs.FileSystem.from_uri(top) if "://" in top else (fs.LocalFileSystem(), top.removeprefix("file:"))
                store, at = stores[top]
                with store.open_input_file(f"{at}/{name}") as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size >= BATCH:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    dealt = addresses.select("path").repartition(4 * addresses.sparkSession.sparkContext.defaultParallelism, "path")
    found = dealt.mapInArrow(read, "path string, content binary")
    return with_format(found.select(F.sha2("path", 256).alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content"))


def with_format(docs: DataFrame) -> DataFrame:
    loose = F.rlike("file_name", F.lit(r"(?i)\.(bas|cls|frm|frx)\z"))
    return docs.withColumn("format", F.when(loose, "raw").when(is_zip(F.col("content")), "zip").when(is_ole(F.col("content")), "ole").otherwise("unsupported"))


def zip_parts(content: bytes, wanted: Callable[[str], bool]) -> Iterator[tuple]:
    """Entries in the order of the central directory; content only of wanted ones, stored or deflated."""
    read = packages.reader(content)
    for n, entry in enumerate(packages.entries(read, len(content))):
        data, error = None, None
        if wanted(entry.name):
            try:
                data = packages.unpack(read, entry, MOST)
            except packages.BadPackage as e:
                error = str(e)
        yield n, entry.name, entry.method, entry.compressed_size, entry.size, data, error


_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
_NONE = 0xFFFFFFFF


#: An entry of a directory: name, its length, type, left, right, child, first sector, size.
_ENTRY = struct.Struct("<64sHBxIII36xII4x")
_HEAD = struct.Struct("<HH14xI4xIIIII")  # from byte 30: sizes of sectors, first of the directory, cutoff, small table, further tables
_WORD = struct.Struct("<I")


class CompoundFile:
    """Streams of a compound file (public MS-CFB format): sectors chained by tables, small streams inside the root's.

    Tables stay bytes: a word is read when a chain comes to it.
    """

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 512:
            raise ValueError("no compound file header")
        shift, small_shift, first_dir, self.cutoff, first_small, _, first_extra, extras = _HEAD.unpack_from(data, 30)
        self.size, self.small_size = 1 << shift, 1 << small_shift
        tables = [s for s in self._words(data[76:512].rstrip(b"\xff") + b"\xff\xff\xff") if s < _END - 3]
        seen: set[int] = set()
        while extras and first_extra < _END - 3 and first_extra not in seen:
            seen.add(first_extra)
            words = self._words(self._sector(first_extra))
            tables += [s for s in words[:-1] if s < _END - 3]
            first_extra = words[-1] if words else _END
        self.next = b"".join([t[: len(t) & ~3] for t in map(self._sector, tables)])
        self.small_next = self._chain(first_small)
        self.entries = self._directory(self._chain(first_dir))
        self.root = next((i for i, e in enumerate(self.entries) if e and e[1] == 5), None)
        self.small = self._chain(self.entries[self.root][5]) if self.root is not None else b""

    @staticmethod
    def _words(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) & ~3])

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    @staticmethod
    def _follow(first: int, table: bytes) -> list[int]:
        """A chain's numbers, to its end or to one that it has held before."""
        n, out, seen = len(table) // 4, [], set()
        while first < n and first not in seen:
            seen.add(first)
            out.append(first)
            (first,) = _WORD.unpack_from(table, 4 * first)
        return out

    def _chain(self, first: int) -> bytes:
        return b"".join(map(self._sector, self._follow(first, self.next)))

    @staticmethod
    def _directory(data: bytes) -> list[tuple | None]:
        """(name, type, left, right, child, first sector, size) by number; None for unused entries."""
        out: list[tuple | None] = []
        for name, length, kind, left, right, child, first, size in _ENTRY.iter_unpack(data[: len(data) & ~127]):
            if kind and length > 2:
                name, _ = codecs.utf_16_le_decode(name[: min(length, 64) - 2], "replace", True)
                out.append((name, kind, left, right, child, first, size))
            else:
                out.append(None)
        return out

    def streams(self) -> Iterator[tuple[str, bytes]]:
        """(path, bytes), each storage's streams in directory order; a later stream of the same path replaces an earlier one."""
        yield from ((path, content) for path, _, content in self.listed(lambda path: True))

    def listed(self, wanted: Callable[[str], bool]) -> Iterator[tuple[str, int, bytes | None]]:
        """(path, size, bytes) of all streams; bytes of the wanted ones only."""
        entries, n = self.entries, len(self.entries)
        found: dict[str, tuple[int, int]] = {}
        todo, seen = [(entries[self.root][4], "", False)] if self.root is not None else [], set()
        while todo:
            i, folder, passed = todo.pop()  # passed: what is left of it is done
            if i >= n or (e := entries[i]) is None:
                continue
            name, kind, left, right, child, first, size = e
            if not passed:
                if i in seen:
                    continue
                seen.add(i)
                if right < n:
                    todo.append((right, folder, False))
                if left < n:
                    todo += [(i, folder, True), (left, folder, False)]
                    continue
            if kind == 2:
                found[folder + name] = (first, size)
            elif kind == 1:
                todo.append((child, f"{folder}{name}/", False))
        for path, (first, size) in found.items():
            yield path, size, self._read(first, size) if wanted(path) else None

    def _read(self, first: int, size: int) -> bytes:
        if not size:
            return b""
        if size >= self.cutoff:
            return self._chain(first)[:size]
        n = self.small_size
        return b"".join(self.small[i * n : (i + 1) * n] for i in self._follow(first, self.small_next))[:size]


_ROW = [("doc_id", pa.string()), ("ord", pa.int32()), ("path", pa.string()), ("method", pa.int32()), ("compressed_size", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]


def _rows(decode):
    """Rows of many documents in a batch, of about ``BATCH`` bytes."""

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_ROW)], [n for n, _ in _ROW])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc, content in zip(batch.column("doc_id"), batch.column("content"), strict=True):
                key = doc.as_py()
                try:
                    own = [(key, *row) for row in decode(content.as_py() or b"")]
                except (ValueError, struct.error, IndexError) as e:
                    own = [(key, None, None, None, None, None, None, str(e))]
                rows += own
                size += sum(len(r[6]) for r in own if r[6])
                if size >= BATCH or len(rows) >= 10_000:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return run


def package_parts(docs: DataFrame, wanted: str | None = None) -> DataFrame:
    """Entries of ZIP documents (doc_id, content). ``wanted``: pattern of the paths whose content is unpacked (default: all)."""
    import re

    test = re.compile(wanted or "", re.I).search
    return docs.select("doc_id", "content").mapInArrow(_rows(lambda b: zip_parts(b, lambda p: bool(test(p)))), PARTS)


def compound_streams(docs: DataFrame) -> DataFrame:
    """Streams of compound files (doc_id, content)."""
    return docs.select("doc_id", "content").mapInArrow(_rows(lambda b: ((i, p, None, None, len(x), x, None) for i, (p, x) in enumerate(CompoundFile(b).streams()))), PARTS)


#: Paths of a package that the extraction is about.
WANTED = r"vbaProject\.bin$|/(media|activeX|embeddings)/"


def classified(parts: DataFrame) -> DataFrame:
    """Adds kind, note and mime_type of package parts by their paths."""
    has = lambda p: F.rlike("path", F.lit(f"(?i){p}"))
    kind = F.when(has("/media/"), "media").when(has(r"\.xml\z"), "xml").when(has("/activeX/"), "activex").otherwise("binary")
    note = F.when(has("/activeX/"), "ActiveX control package part").when(has("/media/"), "Office document media asset").when(is_ole(F.col("content")), "Embedded OLE compound file").otherwise("Office embedded package part")
    mime = F.when(has(r"\.xml\z"), "application/xml").when(has(r"\.jpe?g\z"), "image/jpeg").when(has(r"\.(png|gif|bmp|wmf|emf)\z"), F.concat(F.lit("image/"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)\z", 1)))).otherwise("application/octet-stream")
    return parts.withColumns({"kind": kind, "note": note, "mime_type": mime})


def write_zips(files: DataFrame, folder: str, at: datetime | None = None) -> DataFrame:
    """Packs files (doc_id, file_ord, path, content) into one stored ZIP per document and returns doc_id, path, size, entries.

    A document's files come to one task in their order and are written as they come, so a task holds a batch of files and a
    directory, not an export. Colliding paths get a numbered suffix. ``folder``: an address (``hdfs://``, ``s3://``, ``file://``) that all
    executors reach; a bare path only where all runs in one process. ``at``: the time stamped on entries (default: now).
    """
    master = files.sparkSession.sparkContext.master
    if "://" not in folder and master != "local" and not master.startswith("local["):
        raise ValueError("give the folder as an address that the driver and all executors share")
    t = at or datetime.now()
    time, date = t.hour << 11 | t.minute << 5 | t.second // 2, max(t.year - 1980, 0) << 9 | t.month << 5 | t.day

    def pack(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        doc, out, writer, part = None, None, None, ""

        def closed():
            writer.close()
            out.close()
            store.move(part, f"{top.rstrip('/')}/{doc}.zip")  # a repeated task replaces the file as a whole
            return pa.RecordBatch.from_pylist([{"doc_id": doc, "path": f"{folder.rstrip('/')}/{doc}.zip", "size": writer.size, "entries": writer.entries}])

        for batch in batches:
            for i in range(len(batch)):
                own, path, content = (batch.column(c)[i].as_py() for c in ("doc_id", "path", "content"))
                if writer is None or own != doc:
                    if writer is not None:
                        yield closed()
                    doc, part = own, f"{top.rstrip('/')}/{own}.zip.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                    writer = packages.Writer(out.write, time, date)
                writer.add(path, content or b"")
        if writer is not None:
            yield closed()

    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "file_ord", "path", "content")
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "file_ord", "path")
    return dealt.mapInArrow(pack, "doc_id string, path string, size long, entries long")
