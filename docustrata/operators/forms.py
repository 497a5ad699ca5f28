"""Records of form designer streams (public MS-OFORMS format): headers, property masks, and what can be told of their values.

Decoding works on one stream's bytes inside a task and yields rows; controls are then put together from streams by joins and grouped aggregates.
"""

from __future__ import annotations

import bisect
import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binary, labels, merges, pictures
from .binary import FORM_FLAGS, SITE_FLAGS, find_strings
from .pictures import to_hex

# Names, limits and texts of what is shown.
_FONT_CLASS = bytes.fromhex("0352E30B918FCE119DE300AA004BB851")
_STRING_BITS = {0: "Decoded Name", 1: "Decoded Tag", 3: "Decoded ControlTipText", 4: "Decoded RuntimeLicKey", 5: "Decoded ControlSource", 6: "Decoded RowSource"}
_UNUSED_TEXT = re.compile(r"(?i)\ATahoma\Z|\A[-=]{5,}\Z|\A'|https?://|copyright|permission is hereby|software")
RECORDS, RECORD_TEXTS, STREAM_TEXTS, STREAM_REACH, SITE_REACH = 32, 12, 8, 128, 96
STREAM_TITLES = [
    (r"\Af\z", "Form/control properties stream"),
    (r"\Ao\z", "Object/property data stream"),
    (r"\Ax\z", "Extended form data stream"),
    (r"\A\x01CompObj\z", "COM compound object metadata"),
    (r"\A\x03VBFrame\z", "VB frame metadata"),
    (r"(?i)\Ai[0-9]+\z", "Embedded control storage"),
    (r"(?i)\APROJECT", "VBA project metadata stream"),
]
STREAM_TITLE_DEFAULT = "Binary form resource stream"
FORM_NOTE = "Values of variable size are decoded only where they can be told with confidence."
NOTES = {"Form stream": FORM_NOTE, "Object stream": "Offsets are a best effort where the stream mixes payloads.", "Extended stream": "Candidates of page and extended data.", "COM compound object": "Class metadata of the form or control.", "VBFrame metadata": "Metadata of frame-like containers."}


def stream_title(path: Column) -> Column:
    """What a stream of a designer storage is for, by its name."""
    name, out = F.element_at(F.split(path, "/"), -1), None
    for pattern, title in STREAM_TITLES:
        hit = F.rlike(name, F.lit(pattern))
        out = F.when(hit, title) if out is None else out.when(hit, title)
    return out.otherwise(STREAM_TITLE_DEFAULT)


def useful_text(x: str) -> bool:
    """Whether a string may be a property's value: no font name, rule line, comment, address or licence."""
    return 0 < len(x) <= 160 and not _UNUSED_TEXT.search(x)


def _pairs(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """(offset, first, second) of neighbouring 32-bit integers, every four bytes."""
    n = (end - start) // 4
    words = struct.unpack_from(f"<{n}I", data, start) if n > 0 else ()
    return [(start + 4 * i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]


def _sure(least: int, a: int, b: int) -> str:
    return "medium" if a < least and b < least else "low"


def form_sizes(data: bytes, start: int, end: int) -> list[tuple[int, int, int, str]]:
    """Pairs that may be a form's size in twips, the displayed one first: the largest sure one, or the largest."""
    found = [(o, w, h, _sure(25_000, w, h)) for o, w, h in _pairs(data, start, end) if 100 <= w < 32_000 and 100 <= h < 32_000]
    if not any(c[3] == "medium" for c in found):
        return sorted(found, key=lambda c: -c[1] * c[2])
    best = max((c for c in found if c[3] == "medium"), key=lambda c: c[1] * c[2])
    return [best, *(c for c in found if c is not best)]


def site_position(data: bytes, start: int, end: int) -> tuple[int, int, int, str] | None:
    """The pair that is most likely a control's position: sure ones first, those off the corner and not far away before others."""
    found = [(o, x, y, _sure(15_000, x, y)) for o, x, y in _pairs(data, start, end) if x <= 25_000 and y <= 25_000]
    sure = [c for c in found if c[3] == "medium"]
    return max(sure, key=lambda c: (c[1] > 0 or c[2] > 0) + (c[1] < 10_000 and c[2] < 10_000)) if sure else found[0] if found else None


def _texts_of(mask: int, form: bool, own: list, behind: list) -> list[tuple[str, str]]:
    """Strings given to the properties that the mask says are strings, in the order of its bits."""
    some = [(value, plain) for _, _, value in own + behind if useful_text(plain := re.sub(r"\s+\(.+\)\Z", "", value))]
    if not form:
        bits = [b for b in _STRING_BITS if mask >> b & 1]
        return [(_STRING_BITS[b], f"{labels.labelled(value)} (low)") for b, (value, _) in zip(bits, some)]
    human = [value for value, plain in some if labels.is_human(plain)]
    caption = [("Decoded Caption", f"{labels.labelled(human[0])} (medium)")] if human and mask >> 19 & 1 else []
    return caption + [(f"Decoded Child/Page Label {i + 1}", f"{labels.labelled(v)} (low)") for i, v in enumerate(human[1:8])]


def record_header(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(minor version, major version, size, property mask) of the record at an offset; none without a valid header."""
    if at + 8 > len(data):
        return None
    minor, major, size, mask = struct.unpack_from("<BBHI", data, at)
    return None if minor or major not in (2, 4) or not 4 <= size <= len(data) - at else (minor, major, size, mask)


def control_record(data: bytes, at: int, kind: str, form: bool, strings: list) -> tuple | None:
    """(offset, type, size, properties) of the record at an offset; none without a valid header."""
    if not (header := record_header(data, at)):
        return None
    minor, major, size, mask = header
    end = at + 4 + size
    flags = FORM_FLAGS if form else SITE_FLAGS
    names = ", ".join(n for b, n in flags.items() if mask >> b & 1) or "no known flags"
    out = [("MinorVersion", to_hex(minor, 2)), ("MajorVersion", to_hex(major, 2)), ("cb", f"{size} bytes"), ("PropMask", f"{to_hex(mask, 8)} ({names})")]
    if form:
        sizes = form_sizes(data, at + 8, min(end, len(data)))
        for bit, name, c in ((10, "Decoded DisplayedSize", sizes[:1]), (11, "Decoded LogicalSize", sizes[1:2])):
            out += [(name, f"{w} x {h} twips @ {to_hex(o)} ({sure})") for o, w, h, sure in c if mask >> bit & 1]
    elif mask >> 2 & 1 and (c := site_position(data, at + 8, min(len(data), end + SITE_REACH))):
        out.append(("Decoded SitePosition", f"{c[1]}, {c[2]} twips @ {to_hex(c[0])} ({c[3]})"))
    # strings come by offset, so those of a place are one slice
    since = lambda place: bisect.bisect_left(strings, place, key=lambda s: s[1])
    own, behind = strings[since(at + 8) : since(end)], strings[since(end) : since(min(len(data), end + STREAM_REACH))]
    out += _texts_of(mask, form, own, behind)
    out += [(f"Record string @ {to_hex(o)}", labels.labelled(v)) for _, o, v in own[:RECORD_TEXTS]]
    out += [(f"StreamData string @ {to_hex(o)}", labels.labelled(v)) for _, o, v in behind[:STREAM_TEXTS]]
    if (font := data.find(_FONT_CLASS, end)) >= 0:
        out.append(("Font", f"StdFont GUID at {to_hex(font)} (MSForms StdFont)"))
    if (picture := pictures.std_picture_at(data, end)) >= 0:
        out.append(("Picture", f"StdPicture at {to_hex(picture)} ({pictures._size_text(struct.unpack_from('<I', data, picture + 4)[0])})"))
    if form:
        texts = [o + at for _, o, _ in find_strings(data[at:end]) if o >= 8]
        extra = min(texts) if texts else max(at + 8, end - 24) if any(mask >> b & 1 for b in (10, 11, 12, 19)) else -1
        if extra >= 0:
            out.append(("ExtraDataBlock candidate", f"{to_hex(extra)}-{to_hex(end)}"))
    return at, kind, min(end, len(data)) - at, out


_VERSION = re.compile(rb"\x00[\x02\x04]")


def object_records(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, size, property mask) of the records of an object stream, by their headers alone."""
    out, at = [], 0
    while len(out) < RECORDS and (m := _VERSION.search(data, at)):
        at = m.start()
        if header := record_header(data, at):
            size = min(4 + header[2], len(data) - at)
            out.append((at, size, header[3]))
            at += size
        else:
            at += 1
    return out


def _site_records(data: bytes, strings: list) -> list[tuple]:
    return [control_record(data, at, "Nested OleSite/control record" if at else "OleSiteConcrete control", False, strings) for at, _, _ in object_records(data)]


def stream_records(path: str, data: bytes) -> tuple[str, str, list[tuple]] | None:
    """(kind, confidence, records) of a designer stream; none where it has no structure that is known."""
    name, strings = path.rsplit("/", 1)[-1], find_strings(data)
    texts = lambda some: [(f"{e} string @ {to_hex(o)}", v) for e, o, v in some]
    if name == "f" and (got := control_record(data, 0, "FormControl", True, strings)):
        return "Form stream", "high" if got[2] <= len(data) else "medium", [got]
    if name == "o" and (found := _site_records(data, strings)):
        return "Object stream", "medium" if len(found) > 1 or found[0][0] == 0 else "low", found
    if name == "x" and len(data) >= 8:
        each = [(8 * i, "PageProperties / extended data candidate", 8, [("Value1", to_hex(a, 8)), ("Value2", to_hex(b, 8))]) for i, (a, b) in enumerate(struct.iter_unpack("<II", data[: len(data) // 8 * 8]))]
        return "Extended stream", "low", each
    if name == "\x01CompObj":
        sure = any("microsoft forms" in v.lower() for _, _, v in strings)
        return "COM compound object", "high" if sure else "medium", [(0, "CompObj", len(data), [(n, labels.labelled(v)) for n, v in texts(strings)])]
    if name == "\x03VBFrame":
        return "VBFrame metadata", "medium", [(0, "VBFrame stream", len(data), [("Size", pictures._size_text(len(data))), *texts(strings[:8])])]
    return None


def resource_properties(records: list[tuple]) -> dict[str, str]:
    """Of a stream's records what describes its control: masks by record type, decoded values, fonts and pictures, identifiers, captions."""
    out: dict[str, str] = {}
    for _, kind, _, properties in records:
        for name, value in properties:
            value = labels.labelled(value)
            text = "string @" in name
            if name == "PropMask":
                out[f"{kind} PropMask"] = value
            elif name in ("Font", "Picture", "MouseIcon") or name.startswith("Decoded ") or text and re.search(r"(?i)Microsoft Forms|\AForms\.", value):
                out[name] = value
            elif text and labels.is_human(value):
                out[f"Label {len(out)}"] = value
    return out


_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
_RECORD = pa.struct([("offset", pa.int64()), ("type", pa.string()), ("size", pa.int64()), ("properties", pa.list_(_PAIR))])


def _analysed(batches):
    for batch in batches:
        kinds, sure, records, own = [], [], [], []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            got = stream_records(path.as_py() or "", content.as_py() or b"") or (None, None, [])
            pairs = lambda items: [{"name": n, "value": v} for n, v in items]
            kinds.append(got[0])
            sure.append(got[1])
            records.append([{"offset": o, "type": t, "size": s, "properties": pairs(p)} for o, t, s, p in got[2]])
            own.append(pairs(resource_properties(got[2]).items()))
        rest = [c for c in batch.schema.names if c != "content"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(kinds, pa.string()), pa.array(sure, pa.string()), pa.array(records, pa.list_(_RECORD)), pa.array(own, pa.list_(_PAIR))], [*rest, "oforms_kind", "oforms_confidence", "records", "own"])


def form_streams(streams: DataFrame) -> DataFrame:
    """Designer streams (doc_id, container, ord, path, content) with oforms_kind, oforms_confidence, records, and own (what describes their control).

    Streams without a known structure have a null kind and no records.
    """
    schema = "doc_id string, container string, ord int, path string, oforms_kind string, oforms_confidence string, records array<struct<offset:long,type:string,size:long,properties:array<struct<name:string,value:string>>>>, own array<struct<name:string,value:string>>"
    return streams.select("doc_id", "container", "ord", "path", "content").mapInArrow(_analysed, schema)


def form_records(analysed: DataFrame) -> DataFrame:
    """One row per property of every record: record_ord, offset, type, size, prop_ord, name, value."""
    rows = analysed.select("doc_id", "container", "ord", "path", "oforms_kind", "oforms_confidence", F.posexplode("records").alias("record_ord", "r"))
    return rows.select("doc_id", "container", "ord", "path", "oforms_kind", "oforms_confidence", "record_ord", "r.offset", "r.type", "r.size", F.posexplode("r.properties").alias("prop_ord", "p")).select("*", "p.*").drop("p")


def designer_streams(streams: DataFrame) -> DataFrame:
    """Compound streams of form storages: not of the project itself nor of its sources."""
    lower = F.lower("path")
    return streams.where((lower != "project") & ~F.startswith(lower, F.lit("vba/")))


def size_hint(x: Column) -> dict[str, Column]:
    """Numbers and confidence of ``W x H twips ... (confidence)``; null where the text says no size."""
    return _hint(x, r"(?i)([0-9]+)\s+x\s+([0-9]+)\s+twips.*\((medium|low)\)", "width", "height")


def position_hint(x: Column) -> dict[str, Column]:
    return _hint(x, r"(?i)([0-9]+),\s*([0-9]+)\s+twips.*\((medium|low)\)", "left", "top")


def _hint(x: Column, pattern: str, first: str, second: str) -> dict[str, Column]:
    part = lambda i: F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))
    return {first: part(1).cast("long"), second: part(2).cast("long"), "confidence": part(3)}


def controls(streams: DataFrame, analysed: DataFrame) -> DataFrame:
    """Controls of the form storages: every storage ``iN`` below a form, with what its own streams tell.

    One row per control: doc_id, container, form, control_ord, id, path, parent_path, name, caption, type, prog_id, properties, streams, left, top, width, height, unit,
    confidence. Of one property the last stream's value counts. Bounds are the decoded size and position where both are there, else
    those that a form stream's bytes suggest. ``parent_path`` is null for controls right below the form.
    """
    from .embedded import inferred_bounds

    key = ["doc_id", "container", "path"]
    part = F.split("path", "/")
    owned = analysed.select("doc_id", "container", "ord", F.col("path").alias("stream"), part.alias("parts"), "own").where("size(parts) >= 2")
    at = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    steps = owned.where("size(parts) >= 3").select("doc_id", "container", "ord", "parts", F.explode(F.sequence(F.lit(2), F.size("parts") - 1)).alias("depth"))
    is_control = lambda x: F.rlike(x, F.lit(r"(?i)\Ai[0-9]+\z"))
    found = steps.where(is_control(F.get("parts", F.col("depth") - 1)))
    parent = F.when((F.col("depth") > 2) & is_control(F.get("parts", F.col("depth") - 2)), at(F.col("depth") - 1))
    tree = found.groupBy("doc_id", "container", at(F.col("depth")).alias("path")).agg(F.min("ord").alias("control_ord"), F.first(F.get("parts", F.lit(0))).alias("form"), F.first(F.get("parts", F.col("depth") - 1)).alias("id"), F.first(parent).alias("parent_path"))
    # what each stream says, then folded in the order of streams: a control has few
    value = lambda k: F.get(F.transform(F.filter("own", lambda p: p["name"] == k), lambda p: p["value"]), F.lit(0))
    plain = lambda x: F.regexp_replace(x, r"\s+\(.+\)\z", "")
    from ..functions.text import bound, confidence, is_human_label, strip_confidence

    mine = lambda test: F.get(F.transform(F.filter("own", test), lambda p: p["value"]), F.lit(0))
    comp = F.endswith("stream", F.lit("/\x01CompObj"))
    prog = F.when(comp, plain(mine(lambda p: F.rlike(plain(p["value"]), F.lit(r"(?i)\AForms\.")))))
    named = F.when(comp, mine(lambda p: F.rlike(p["value"], F.lit("(?i)Microsoft Forms 2[.]0"))))
    said_name = bound(value("Decoded Name"), lambda v: bound(strip_confidence(v), lambda x: F.when(is_human_label(x) & (confidence(v) != "low"), x)))
    said_caption = bound(strip_confidence(value("Decoded Caption")), lambda x: F.when(is_human_label(x), x))
    label = plain(mine(lambda p: F.startswith(p["name"], F.lit("Label ")) & is_human_label(p["value"])))
    classed = bound(prog, lambda x: F.struct(x.alias("prog_id"), F.coalesce(labels.prog_id_label(x), x, named).alias("type")))
    said = owned.withColumn("path", at(F.size("parts") - 1)).select(*key, "ord", "stream", "own", classed.alias("class"), said_name.alias("said_name"), said_caption.alias("said_caption"), label.alias("label"))
    rows = said.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "stream", "own", "class.prog_id", "class.type", "said_name", "said_caption", "label"))).alias("s"))
    none = lambda: F.lit(None).cast("string")
    folded = F.aggregate(
        "s",
        F.struct(none().alias("name"), none().alias("caption")),
        lambda a, x: F.struct(F.coalesce(x["said_name"], a["name"], x["said_caption"], a["caption"], x["label"]).alias("name"), F.coalesce(x["said_caption"], a["caption"], x["label"]).alias("caption")),
    )
    last = lambda f: F.element_at(F.filter(F.transform("s", lambda x: x[f]), lambda v: v.isNotNull()), -1)
    has = F.size("s") > 0
    some = lambda f: F.when(has & F.exists("s", lambda x: x[f].isNotNull()), last(f))
    merged = merges.merged(F.flatten(F.transform("s", lambda x: F.coalesce(x["own"], F.array().cast("array<struct<name:string,value:string>>")))))
    facts = rows.select(*key, folded.alias("f"), some("prog_id").alias("prog_id"), some("type").alias("type"), F.transform("s", lambda x: x["stream"]).alias("streams"), merged.alias("properties"))
    # bounds by the bytes of a control's first form stream
    own_f = streams.where(F.endswith("path", F.lit("/f"))).select(F.struct("doc_id", "container", F.regexp_replace("path", r"/f\z", "").alias("path")).alias("k"), "content")
    guess = inferred_bounds(own_f, "k", "content")
    guess = guess.select("k.*", *(F.col(c).alias(f"g_{c}") for c in ("left", "top", "width", "height", "confidence")))
    out = tree.join(facts, key, "left").join(guess, key, "left")
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    shown, logical, place = size_hint(prop("Decoded DisplayedSize")), size_hint(prop("Decoded LogicalSize")), position_hint(prop("Decoded SitePosition"))
    size = {k: F.when(shown["width"].isNotNull(), shown[k]).otherwise(logical[k]) for k in shown}
    both = size["width"].isNotNull() & place["left"].isNotNull()
    pick = lambda c, decoded: F.when(both, decoded).otherwise(F.col(f"g_{c}"))
    sure = F.when((size["confidence"] == "medium") & (place["confidence"] == "medium"), "medium").otherwise("low")
    bounds = {"left": pick("left", place["left"]), "top": pick("top", place["top"]), "width": pick("width", size["width"]), "height": pick("height", size["height"]), "confidence": pick("confidence", sure)}
    return out.select(
        "doc_id", "container", "form", "control_ord", "id", "path", "parent_path", F.col("f.name").alias("name"), F.col("f.caption").alias("caption"), "type", "prog_id", "properties", "streams",
        *(v.alias(k) for k, v in bounds.items() if k != "confidence"), F.when(F.col("g_left").isNotNull() | both, "twips").alias("unit"), bounds["confidence"].alias("confidence"),
    )


def form_properties(streams: DataFrame, analysed: DataFrame) -> DataFrame:
    """Properties of the forms: those of their VBFrame, then what their own form and class streams add: doc_id, container, form, name, value."""
    from .embedded import frame_properties

    frame = frame_properties(streams)
    direct = analysed.where(F.rlike("path", F.lit("\\A[^/]+/(?:f|\x01CompObj)\\z"))).select("doc_id", "container", F.split_part("path", F.lit("/"), F.lit(1)).alias("form"), "ord", F.explode("own").alias("p"))
    direct = direct.groupBy("doc_id", "container", "form", F.col("p.name").alias("name")).agg(F.max_by("p.value", "ord").alias("value"))
    return frame.unionByName(direct.join(frame.select("doc_id", "container", "form", "name"), ["doc_id", "container", "form", "name"], "left_anti"))
