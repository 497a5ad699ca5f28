"""Spark data sources over folders of documents: ``office_parts`` (entries of packages), ``office_streams`` (compound streams), ``byte_chunks`` (files of any size in ranges).

    office.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("office_parts").load("s3://bucket/folder").where("kind = 'media'")

Files are listed once and dealt to partitions of about equal bytes. Of a package its end and its directory are read,
then the entries that the pushed filters leave; the others are neither read nor unpacked. Columns are pruned by the schema that is
given (``spark.read.schema("doc_id string, path string")``): without ``content`` no entry is read at all.

Addresses are what ``pyarrow.fs`` opens (local paths, ``s3://``, ``hdfs://``, ``gs://``); all executors must reach them. For stores
that only Spark opens, ``containers.raw_documents`` reads the same documents.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.binary import OLE_MAGIC, ZIP_MAGIC
from . import packages
from .containers import MOST, CompoundFile

PARTS = "doc_id string, file string, ord int, path string, kind string, method int, compressed_size long, size long, content binary, error string, unpacked long"
STREAMS = "doc_id string, file string, container string, ord int, path string, kind string, size long, content binary, error string, unpacked long"
CHUNKS = "doc_id string, file string, start long, content binary"
#: Bytes of files in a partition; bytes of a chunk.
PARTITION, CHUNK = 128 << 20, 1 << 20


def part_kind(path: str) -> str:
    """media, xml, activex or binary, by the path inside a package; the rule of ``containers.classified``."""
    if "/media/" in path.lower():
        return "media"
    if path.lower().endswith(".xml"):
        return "xml"
    return "activex" if "/activex/" in path.lower() else "binary"


def stream_kind(path: str) -> str:
    """project, source or designer, by the path inside a compound file."""
    lower = path.lower()
    return "project" if lower == "project" or lower in ("vba/dir", "dir") else "source" if lower.startswith("vba/") else "designer"


@dataclass
class Files(InputPartition):
    """Addresses and sizes of the files of a partition."""

    value: int
    files: list


def dealt(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Partitions of about equal bytes: the largest file first, each to the emptiest partition."""
    n = max(1, min(len(files), -(-sum(size for _, size in files) // most)))
    heap, own = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        held, i = heapq.heappop(heap)
        own[i].append((path, size))
        heapq.heappush(heap, (held + size, i))
    return [Files(i, x) for i, x in enumerate(own)] if files else []


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class OfficeReader(DataSourceReader):
    """Lists, deals and reads files; ``pushed`` are the filters that it applies itself."""

    #: Columns that filters are taken for; they are known before anything is unpacked.
    KNOWN = ("path", "kind", "file", "doc_id")

    def __init__(self, schema: StructType, options: dict[str, str], streams: bool):
        self.columns, self.options, self.streams = schema.fieldNames(), options, streams
        self.pushed: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in self.KNOWN and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.pushed.append(f)
            else:
                yield f

    def holds(self, row: dict, only: tuple[str, ...] | None = None) -> bool:
        """Whether a row passes the pushed filters (on the columns ``only``, where given)."""
        for f in self.pushed:
            if only is not None and f.attribute[0] not in only:
                continue
            v = row.get(f.attribute[0])
            if isinstance(f, IsNotNull):
                good = v is not None
            elif isinstance(f, EqualTo):
                good = v is not None and v == f.value
            elif isinstance(f, In):
                good = v is not None and v in f.value
            elif isinstance(f, StringStartsWith):
                good = v is not None and v.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                good = v is not None and v.endswith(f.value)
            else:
                good = v is not None and f.value in v
            if not good:
                return False
        return True

    def listed(self) -> list[tuple[str, int]]:
        """Files below the path, those that the pushed filters on the file leave."""
        from pyarrow import fs

        path = self.options["path"]
        store, top = _store(path)
        head = path[: len(path) - len(top)] if path.endswith(top) else ""
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        every = [(head + i.path, i.size) for i in found if i.type == fs.FileType.File]
        return [f for f in every if self.holds(self._file(f[0]), ("file", "doc_id"))]

    @staticmethod
    def _file(path: str) -> dict:
        return {"file": path.rsplit("/", 1)[-1], "doc_id": hashlib.sha256(path.encode()).hexdigest()}

    def partitions(self):
        return dealt(self.listed(), int(self.options.get("maxpartitionbytes", PARTITION)))

    def read(self, partition: Files) -> Iterator[tuple]:
        self.unpacked = 0
        for path, size in partition.files:
            store, at = _store(path)
            with store.open_input_file(at) as f:
                read = lambda offset, length, f=f: f.read_at(length, offset) if length > 0 else b""
                own = self._file(path)
                head = read(0, 8)
                try:
                    rows = self._streams(read, size, head, own) if self.streams else self._parts(read, size, head, own)
                    for row in rows:
                        yield tuple((own | row | {"unpacked": self.unpacked}).get(c) for c in self.columns)
                except (ValueError, struct.error, IndexError) as e:
                    row = own | {"error": str(e), "unpacked": self.unpacked}
                    if self.holds(row):
                        yield tuple(row.get(c) for c in self.columns)

    def _unpack(self, read, entry: packages.Entry) -> bytes:
        data = packages.unpack(read, entry, MOST)
        self.unpacked += len(data)
        return data

    def _parts(self, read, size: int, head: bytes, own: dict) -> Iterator[dict]:
        if head[:4] != ZIP_MAGIC:
            return
        for n, e in enumerate(packages.entries(read, size)):
            row = {"ord": n, "path": e.name, "kind": part_kind(e.name), "method": e.method, "compressed_size": e.compressed_size, "size": e.size}
            if not self.holds(own | row):
                continue
            if "content" in self.columns:
                try:
                    row["content"] = self._unpack(read, e)
                except packages.BadPackage as x:
                    row["error"] = str(x)
            yield row

    def _streams(self, read, size: int, head: bytes, own: dict) -> Iterator[dict]:
        if head == OLE_MAGIC:
            yield from self._compound(own["file"], read(0, size), own)
        elif head[:4] == ZIP_MAGIC:
            for e in packages.entries(read, size):
                if re.search(r"(?i)vbaProject\.bin\Z", e.name):
                    yield from self._compound(e.name, self._unpack(read, e), own)

    def _compound(self, container: str, data: bytes, own: dict) -> Iterator[dict]:
        whole = "content" in self.columns
        wanted = lambda path: self.holds(own | {"path": path, "kind": stream_kind(path)})
        for n, (path, size, content) in enumerate(CompoundFile(data).listed(lambda p: whole and wanted(p))):
            if wanted(path):
                yield {"container": container, "ord": n, "path": path, "kind": stream_kind(path), "size": size, "content": content}


class OfficeParts(DataSource):
    """Entries of ZIP packages: doc_id, file, ord, path, kind, method, compressed_size, size, content, error, unpacked (bytes that the task has unpacked so far)."""

    @classmethod
    def name(cls):
        return "office_parts"

    def schema(self):
        return PARTS

    def reader(self, schema):
        return OfficeReader(schema, dict(self.options), False)


class OfficeStreams(DataSource):
    """Streams of compound files, and of the macro projects inside packages: doc_id, file, container, ord, path, kind, size, content, error, unpacked."""

    @classmethod
    def name(cls):
        return "office_streams"

    def schema(self):
        return STREAMS

    def reader(self, schema):
        return OfficeReader(schema, dict(self.options), True)


class ChunkReader(OfficeReader):
    """Ranges of files: a partition is a run of chunks of one file."""

    KNOWN = ("file", "doc_id")

    def partitions(self):
        size = int(self.options.get("chunkbytes", CHUNK))
        most = max(1, int(self.options.get("maxpartitionbytes", PARTITION)) // size)
        if size < 32 or size % 2:
            raise ValueError("chunks have an even size of 32 bytes at least")
        runs = [(path, at, min(at + size * most, n)) for path, n in self.listed() for at in range(0, n, size * most)]
        return [Files(i, [(run, size)]) for i, run in enumerate(runs)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for (path, since, till), size in partition.files:
            store, at = _store(path)
            with store.open_input_file(at) as f:
                for start in range(since, till, size):
                    row = self._file(path) | {"start": start}
                    if "content" in self.columns:
                        row["content"] = f.read_at(min(size, till - start), start)
                    yield tuple(row.get(c) for c in self.columns)


class ByteChunks(DataSource):
    """Files of any size as chunks (doc_id, file, start, content) of ``chunkBytes`` (default 1 MB); for the scans of ``operators.chunks``."""

    @classmethod
    def name(cls):
        return "byte_chunks"

    def schema(self):
        return CHUNKS

    def reader(self, schema):
        return ChunkReader(schema, dict(self.options), False)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (OfficeParts, OfficeStreams, ByteChunks):
        spark.dataSource.register(source)
