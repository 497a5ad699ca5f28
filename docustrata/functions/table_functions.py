"""Table functions over bytes: what a container, a stream or a macro project holds, as rows.

For SQL each has two forms. ``name(content)`` is called per row, after ``LATERAL``. ``name_of(TABLE(...))`` takes a table of
(key, content) in Arrow batches and gives the key with the rows, without a shuffle unless ``PARTITION BY`` asks for one:

    SELECT d.doc_id, s.* FROM docs d, LATERAL strings(d.content) s
    SELECT * FROM strings_of(TABLE(SELECT doc_id, content FROM docs))

Of a batched function in SQL, Spark holds the input rows, contents too, until their task ends, on disk when memory is short. For large
tables there is a third form, ``found(docs.select("doc_id", "content"), "strings")``: the same batches and columns, and no row is held.

The key of a table is a string; in the third form it keeps its type. A null or empty content, and one that is not of the format,
gives no rows. In a damaged container the rows before the damage count where the format can be read that far. With
``PARTITION BY`` a key's rows are read one after another, each by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators import binary, forms, pictures
from ..sources import containers, macros, packages

#: Rows, and bytes of texts and contents, after which a batched function hands its results on.
ROWS, BYTES = 4096, 4 << 20

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _zip_entries(data: bytes) -> Iterator[tuple]:
    for n, e in enumerate(packages.entries(packages.reader(data), len(data))):
        yield n, e.name, e.method, e.compressed_size, e.size, e.offset


def _cfb_streams(data: bytes) -> Iterator[tuple]:
    for n, (path, content) in enumerate(containers.CompoundFile(data).streams()):
        yield n, path, len(content), content


def _ovba_text(data: bytes) -> Iterator[tuple]:
    text = macros.decompress(data)
    yield len(text), text.rstrip(b"\0").decode("cp1252", "replace")


def _dir_modules(data: bytes) -> Iterator[tuple]:
    yield from ((n, *m) for n, m in enumerate(macros.dir_modules(macros.decompress(data))))


def _dir_references(data: bytes) -> Iterator[tuple]:
    yield from ((n, *r) for n, r in enumerate(macros.dir_references(macros.decompress(data))))


def _recover_media(data: bytes) -> Iterator[tuple]:
    yield from pictures.find_media(data)


def _strings(data: bytes) -> Iterator[tuple]:
    yield from binary.find_strings(data)


def _guids(data: bytes) -> Iterator[tuple]:
    yield from binary.find_guids(data)


def _signatures(data: bytes) -> Iterator[tuple]:
    yield from pictures.find_signatures(data)


def _oforms(data: bytes, name: str) -> Iterator[tuple]:
    kind, sure, records = forms.stream_records(name, data) or (None, None, [])
    for r, (offset, what, size, properties) in enumerate(records):
        for p, (key, value) in enumerate(properties):
            yield kind, sure, r, offset, what, size, p, key, value


def _object_records(data: bytes) -> Iterator[tuple]:
    yield from ((n, *r, len(data)) for n, r in enumerate(forms.object_records(data)))


#: Name of a function -> its columns, and the rows that a content gives.
FUNCTIONS: dict[str, tuple[str, Callable[..., Iterator[tuple]]]] = {
    "zip_entries": ("ord int, name string, method int, compressed_size long, size long, local_offset long", _zip_entries),
    "cfb_streams": ("ord int, path string, size long, content binary", _cfb_streams),
    "ovba_text": ("n_bytes long, text string", _ovba_text),
    "dir_modules": ("ord int, name string, stream_name string, text_offset long, module_type_id int", _dir_modules),
    "dir_references": ("ord int, kind string, name string, lib_id string, raw string", _dir_references),
    "recover_media": ("offset long, extension string, mime_type string, length long, bytes binary, place string", _recover_media),
    "strings": ("encoding string, offset long, value string", _strings),
    "guids": ("offset long, guid string", _guids),
    "signatures": ("offset long, label string, detail string", _signatures),
    "oforms": ("kind string, confidence string, record_ord int, offset long, type string, size long, prop_ord int, name string, value string", _oforms),
}
#: Those of the third form and of ``lists``: the same, and what is no function of SQL.
FOUND = FUNCTIONS | {"object_records": ("record_ord int, offset long, size long, mask long, stream_size long", _object_records)}


def _rows(find: Callable[..., Iterator[tuple]], content: bytes | None, *more) -> Iterator[tuple]:
    try:
        if content:
            yield from find(bytes(content), *more)
    except (ValueError, struct.error, IndexError):
        return


def _lateral(columns: str, find: Callable[..., Iterator[tuple]], named: bool):
    class PerRow:
        def eval(self, content):
            yield from _rows(find, content)

    class PerNamedRow:
        def eval(self, content, name):
            yield from _rows(find, content, name or "")

    return udtf(PerNamedRow if named else PerRow, returnType=columns, useArrow=False)


def _decoder(columns: str, find: Callable[..., Iterator[tuple]], named: bool):
    """From a batch, columns by position (key, content and, for form streams, the stream's name), and its keys: tables of the rows found."""
    fields = [f.rsplit(" ", 1) for f in columns.split(", ")]

    names = ["key", *("key_name" if n == "key" else n for n, _ in fields)]

    heavy = [i for i, (_, t) in enumerate(fields) if t in ("string", "binary")]

    def table(keys, places, rows):
        return pa.table([keys.take(pa.array(places, pa.int64())), *(pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields, strict=True))], names=names)

    def decode(rows, keys):
        contents, more = rows.column(1), ()
        places, found, held = [], [], 0
        for at in range(rows.num_rows):  # a content at a time; a table for many contents, as each table handed on costs as much as many rows
            if named:
                more = (rows.column(2)[at].as_py() or "",)
            for row in _rows(find, contents[at].as_py(), *more):
                places.append(at)
                found.append(row)
                for i in heavy:
                    held += len(row[i] or "")
                if len(found) >= ROWS or held >= BYTES:
                    yield table(keys, places, found)
                    places, found, held = [], [], 0
        if found:
            yield table(keys, places, found)

    return decode


def _batched(columns: str, find: Callable[..., Iterator[tuple]], named: bool):
    decode = _decoder(columns, find, named)

    class PerBatch:
        def eval(self, rows):
            yield from decode(rows, pa.array(map(str, rows.column(0).to_pylist()), pa.string()))

    return arrow_udtf(PerBatch, returnType=f"key string, {columns}")


def found(table: DataFrame, name: str) -> DataFrame:
    """The rows that function ``name`` finds in a table of (key, content) or, for ``oforms``, (key, content, stream): key, and the function's columns."""
    columns, find = FOUND[name]
    decode = _decoder(columns, find, name == "oforms")

    def run(batches):
        for rows in batches:
            for t in decode(rows, rows.column(0)):
                yield from t.to_batches()

    run.__name__ = f"{name}_of"  # as plans show it
    return table.mapInArrow(run, f"key {table.schema[0].dataType.simpleString()}, {columns}")


def lists(table: DataFrame, names: list[str]) -> DataFrame:
    """The rows that several functions find in a table of (key, content), in lists of structs named as the functions: one row per content, nothing to be joined again."""
    fields = [[f.rsplit(" ", 1) for f in FOUND[n][0].split(", ")] for n in names]
    types = [pa.struct([(f, _ARROW[t]) for f, t in own]) for own in fields]

    def packed(keys, places, found, ends):
        held = []
        for rows, end, kind in zip(found, ends, types, strict=True):
            columns = zip(*rows) if rows else ((),) * kind.num_fields
            held.append(pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *held], ["key", *names])

    def run(batches):
        for rows in batches:
            contents, places = rows.column(1), []
            for at in range(rows.num_rows):
                if not places:
                    found, ends, held = [[] for _ in names], [[0] for _ in names], 0
                content = contents[at].as_py()
                for n, own, end in zip(names, found, ends, strict=True):
                    own.extend(_rows(FOUND[n][1], content))
                    end.append(len(own))
                places.append(at)
                held += len(content or b"")
                if max(map(len, found)) >= ROWS or held >= BYTES:
                    yield packed(rows.column(0), places, found, ends)
                    places = []
            if places:
                yield packed(rows.column(0), places, found, ends)

    run.__name__ = "_".join(names) + "_lists"  # as plans show it
    listed = ", ".join(f"{n} array<struct<{', '.join(f'{f}:{t}' for f, t in own)}>>" for n, own in zip(names, fields, strict=True))
    return table.mapInArrow(run, f"key {table.schema[0].dataType.simpleString()}, {listed}")


def register(spark: SparkSession) -> list[str]:
    """Registers both SQL forms of every function; returns their names."""
    out = []
    for name, (columns, find) in FUNCTIONS.items():
        named = name == "oforms"
        spark.udtf.register(name, _lateral(columns, find, named))
        spark.udtf.register(f"{name}_of", _batched(columns, find, named))
        out += [name, f"{name}_of"]
    return out
