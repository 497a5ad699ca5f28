"""What is stored of embedded (ActiveX) controls: class metadata, property streams, and the streams of their storage."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.containers import OLE_MARK, CompoundFile
from . import forms, labels, merges, pictures
from .binary import find_guids, find_strings
from .pictures import to_hex

# Patterns of class metadata, font names, limits of lists.
_USER_TYPE = re.compile(r"(?i)Microsoft Forms|Control|Button|Box|Label|Image|Object")
_CLIPBOARD = re.compile(r"(?i)Embedded Object|Object|Control")
_PROG_ID = re.compile(r"[A-Za-z][A-Za-z0-9_.]+(\.[0-9]+)?")
_FONTS = re.compile(r"(?i)Aptos|Arial|Calibri|Cambria|Courier New|MS Sans Serif|Segoe UI|Tahoma|Times New Roman|Verdana")
STRINGS, GUIDS, SIGNATURES, COLOURS, EXTRAS = 16, 16, 12, 8, 10


def colours(data: bytes) -> list[tuple[int, str, str, str]]:
    """(offset, name, value, confidence) of aligned integers that may be colours: of the system, or red, green and blue."""
    out = []
    for i, (v,) in enumerate(struct.iter_unpack("<I", data[: len(data) // 4 * 4])):
        if v >> 24 == 0x80:
            name = labels.SYSTEM_COLORS.get(v & 0xFF, f"system color {v & 0xFF}")
            out.append((4 * i, "SystemColor", f"{to_hex(v, 8)} ({name})", "medium"))
        elif v and v >> 24 == 0:
            out.append((4 * i, "RgbColor", f"{to_hex(v, 8)} (#{v:06x})", "low"))
    return out


def mask_names(mask: int, user_type: str | None) -> list[str]:
    table = labels.BUTTON_MASK if "commandbutton" in (user_type or "").lower() else labels.CONTROL_MASK
    return [name for bit, name in table.items() if mask >> bit & 1]


def class_metadata(data: bytes) -> dict[str, str | None]:
    """clsid, user_type, clipboard_format and prog_id of a class stream, each from the first string that looks like one."""
    texts = [v for _, _, v in find_strings(data) if v]
    first = lambda test: next((v for v in texts if test(v)), None)
    guid = data[12:28]
    clsid = "{%s-%s-%s-%s-%s}" % (guid[3::-1].hex(), guid[5:3:-1].hex(), guid[7:5:-1].hex(), guid[8:10].hex(), guid[10:].hex()) if len(data) >= 28 else None
    return {"clsid": clsid and clsid.upper(), "user_type": first(_USER_TYPE.search), "clipboard_format": first(lambda v: _CLIPBOARD.search(v) and "microsoft forms" not in v.lower()), "prog_id": first(_PROG_ID.fullmatch)}


def contents_properties(data: bytes, source: str, user_type: str | None) -> list[tuple[str, str, str, str]]:
    """(name, value, source, confidence) of what a property stream tells: header, caption, font, colours, other strings."""
    out = []
    if len(data) >= 8:
        minor, major, size, mask = struct.unpack_from("<BBHI", data)
        if minor == 0 and major in (2, 4) and 4 <= size <= len(data):
            names = ", ".join(mask_names(mask, user_type)) or "unknown flags"
            out += [(n, v, source, "medium") for n, v in (("PersistedRecordVersion", f"{major}.{minor}"), ("PersistedRecordSize", f"{size} bytes"), ("PersistedPropMask", f"{to_hex(mask, 8)} ({names})"))]
    some = [(o, v) for _, o, v in find_strings(data) if forms.useful_text(v)]
    at = lambda o: f"{source}@{to_hex(o)}"
    caption = next((s for s in some if labels.is_human(s[1])), None)
    font = next((s for s in some if _FONTS.fullmatch(s[1])), None)
    out += [(n, s[1], at(s[0]), "high") for n, s in (("Caption", caption), ("FontName", font)) if s]
    out += [(n, v, at(o), sure) for o, n, v, sure in colours(data)[:COLOURS]]
    rest = [s for s in some if s is not caption and s is not font][:EXTRAS]
    return out + [("StringProperty", labels.labelled(v), at(o), "low") for o, v in rest]


def stream_summary(path: str, data: bytes) -> dict:
    known = lambda g: f"{g} ({labels.GUIDS[g.upper()]})" if g.upper() in labels.GUIDS else g
    form = forms.stream_records(path, data)
    return {
        "path": pictures.stream_name(path),
        "size": len(data),
        "strings": [labels.labelled(v) for _, _, v in find_strings(data)[:STRINGS]],
        "guids": [known(g) for _, g in find_guids(data)[:GUIDS]],
        "signatures": [f"{n} at {to_hex(o)} ({d})" for o, n, d in pictures.find_signatures(data)[:SIGNATURES]],
        "oforms": form and f"{form[0]} ({form[1]})",
    }


def persistence(data: bytes | None) -> dict | None:
    """Format (empty, raw-stream, cfb-storage, unknown), confidence, streams, class metadata, properties and warnings of a control's binary part."""
    if data is None:
        return None
    out = {"format": "raw-stream", "confidence": "medium", "size": len(data), "streams": [], "class": None, "properties": [], "warnings": []}
    if not data:
        return out | {"format": "empty", "confidence": "high", "warnings": ["ActiveX binary part is empty."]}
    if not data.startswith(OLE_MARK):
        return out | {"streams": [stream_summary("(raw)", data)], "properties": contents_properties(data, "(raw)", None), "warnings": ["No compound storage: read as one raw property stream."]}
    try:
        streams = list(CompoundFile(data).streams())
    except (ValueError, struct.error, IndexError) as e:
        return out | {"format": "unknown", "confidence": "low", "streams": [stream_summary("(unparsed)", data)], "warnings": [f"Compound storage can't be read: {e}"]}
    meta = next(((p, b) for p, b in streams if "compobj" in p.lower()), None)
    own = next(((p, b) for p, b in streams if pictures.stream_name(p).lower().rsplit("/", 1)[-1] == "contents"), None)
    found = class_metadata(meta[1]) if meta else None
    properties = []
    if found:
        said = (("CompObj CLSID", "clsid", "high"), ("UserType", "user_type", "high"), ("ClipboardFormat", "clipboard_format", "medium"), ("ProgID", "prog_id", "high"))
        properties += [(n, labels.labelled(found[k]) if k in ("clsid", "prog_id") else found[k], meta[0], sure) for n, k, sure in said if found[k]]
    if own:
        properties += contents_properties(own[1], own[0], found and found["user_type"])
    return out | {"format": "cfb-storage", "confidence": "high" if meta or own else "medium", "streams": [stream_summary(p, b) for p, b in streams], "class": found, "properties": properties, "warnings": [] if own else ["No contents stream in the storage."]}


_TEXTS = pa.list_(pa.string())
_STREAM = pa.struct([("path", pa.string()), ("size", pa.int64()), ("strings", _TEXTS), ("guids", _TEXTS), ("signatures", _TEXTS), ("oforms", pa.string())])
_CLASS = pa.struct([("clsid", pa.string()), ("user_type", pa.string()), ("clipboard_format", pa.string()), ("prog_id", pa.string())])
_PROPERTY = pa.struct([("name", pa.string()), ("value", pa.string()), ("source", pa.string()), ("confidence", pa.string())])
_RESULT = pa.struct([("format", pa.string()), ("confidence", pa.string()), ("size", pa.int64()), ("streams", pa.list_(_STREAM)), ("class", _CLASS), ("properties", pa.list_(_PROPERTY)), ("warnings", _TEXTS)])
_TYPE = "struct<format:string,confidence:string,size:long,streams:array<struct<path:string,size:long,strings:array<string>,guids:array<string>,signatures:array<string>,oforms:string>>,class:struct<clsid:string,user_type:string,clipboard_format:string,prog_id:string>,properties:array<struct<name:string,value:string,source:string,confidence:string>>,warnings:array<string>>"


def _persisted(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c != "bin"]
        got = [persistence(x.as_py()) for x in batch.column("bin")]
        rows = [p and p | {"properties": [dict(zip(("name", "value", "source", "confidence"), q, strict=True)) for q in p["properties"]]} for p in got]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, _RESULT)], [*names, "persistence_analysis"])


def persisted_controls(controls: DataFrame) -> DataFrame:
    """Embedded controls (rows of ``embedded.activex_controls``) with persistence_analysis in place of their bytes.

    Its properties join the control's own as ``bin.<name>``, the last of a name; its user type is the better label. Null without a binary part.
    """
    kept = ["doc_id", "id", "ord", "xml_path", "bin_path", "class_id", "label", "persistence"]
    schema = "doc_id string, id string, ord int, xml_path string, bin_path string, class_id string, label string, persistence string, properties map<string,string>, persistence_analysis " + _TYPE
    out = controls.select(*kept, "properties", "bin").mapInArrow(_persisted, schema)
    said = F.coalesce(F.col("persistence_analysis.properties"), F.array().cast("array<struct<name:string,value:string,source:string,confidence:string>>"))
    own = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    merged = merges.merged(F.concat(F.coalesce(own, F.array().cast("array<struct<name:string,value:string>>")), F.transform(said, lambda p: F.struct(F.concat(F.lit("bin."), p["name"]).alias("name"), p["value"].alias("value")))))
    return out.withColumns({"label": F.coalesce("persistence_analysis.class.user_type", "label"), "properties": merged, "source_files": F.filter(F.array("xml_path", "bin_path"), lambda x: x.isNotNull())})
