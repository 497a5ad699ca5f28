"""What a binary stream is, as one record: title, summary, first signatures, labelled GUIDs, first strings, and its form structure."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forms, labels, pictures
from .binary import _bits, find_guids, find_strings

#: Signatures of a record, as the survey says; strings and GUIDs of it.
SIGNATURES, STRINGS, GUIDS = 24, 40, 40
_PICTURE = re.compile("(?i)image|bitmap|icon|cursor")
_NAMES = [f.split(" ", 1)[0] for f in ("size", "entropy", "zero_bytes", "summary", "n_strings", "n_guids", "n_signatures", "signatures", "guids", "strings", "kind", "confidence", "notes")]
_PAIR = pa.struct([("label", pa.string()), ("value", pa.string())])
_SIGNATURE = pa.struct([("offset", pa.int64()), ("label", pa.string()), ("detail", pa.string())])
_GUID = pa.struct([("offset", pa.int64()), ("guid", pa.string()), ("label", pa.string())])
_STRING = pa.struct([("encoding", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
_TYPES = (pa.int64(), pa.float64(), pa.int64(), pa.list_(_PAIR), pa.int64(), pa.int64(), pa.int64(), pa.list_(_SIGNATURE), pa.list_(_GUID), pa.list_(_STRING), pa.string(), pa.string(), pa.list_(pa.string()))
_SCHEMA = (
    "size long, entropy double, zero_bytes long, summary array<struct<label:string,value:string>>, n_strings long, n_guids long, n_signatures long,"
    " signatures array<struct<offset:long,label:string,detail:string>>, guids array<struct<offset:long,guid:string,label:string>>, strings array<struct<encoding:string,offset:long,value:string>>, kind string, confidence string, notes array<string>"
)


def profile(path: str, data: bytes) -> tuple:
    """The record of one stream, in the order of its columns."""
    signatures, strings, guids = pictures.find_signatures(data), find_strings(data), find_guids(data)
    kind, sure, _ = forms.stream_records(path, data) or (None, None, [])
    raw = np.frombuffer(data, np.uint8)
    bits, zeros = _bits(raw), int((raw == 0).sum())
    folder, _, name = path.rpartition("/")
    summary = [
        ("Storage", folder or "(root)"),
        ("Stream", pictures.stream_name(name)),
        ("Size", pictures._size_text(len(data))),
        ("Entropy", f"{bits:.2f} bits/byte"),
        ("Zero bytes", f"{zeros} ({100 * zeros / len(data) if data else 0:.1f}%)"),
        ("Media candidates", str(sum(bool(_PICTURE.search(s[1])) for s in signatures))),
        ("Text strings", str(len(strings))),
        ("GUID candidates", str(len(guids))),
        ("MS-OFORMS", f"{kind} ({sure})" if kind else "No structured match"),
    ]
    each = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
    return (
        len(data), bits, zeros, each(("label", "value"), summary), len(strings), len(guids), len(signatures),
        each(("offset", "label", "detail"), signatures[:SIGNATURES]),
        [{"offset": o, "guid": g, "label": labels.GUIDS.get(g)} for o, g in guids[:GUIDS]],
        each(("encoding", "offset", "value"), strings[:STRINGS]), kind, sure, [forms.NOTES[kind]] if kind else [],
    )


def stream_profiles(streams: DataFrame, key: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """One record per stream: key, path, title and the columns of ``profile``. Null or empty contents have an empty record. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            rows = [profile(p or "", x.as_py() or b"") for p, x in zip(batch.column("_path").to_pylist(), batch.column("_content"), strict=True)]
            own = [c for c in batch.schema.names if c != "_content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES))], [*own, *_NAMES])

    types = "".join(f"`{k}` {streams.schema[k].dataType.simpleString()}, " for k in key)
    out = streams.select(*key, F.col(path).alias("_path"), F.col(content).cast("binary").alias("_content")).mapInArrow(run, f"{types}_path string, {_SCHEMA}")
    return out.select(*key, F.col("_path").alias("path"), forms.stream_title(F.coalesce("_path", F.lit(""))).alias("title"), *_NAMES)
