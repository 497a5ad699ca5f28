"""Embedded (ActiveX) controls of packages and form designer streams, decoded by expressions over their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import decode_cp1252
from ..functions.text import bound, hex_pairs, js_trim, lines, normalize_guid, to_hex
from . import labels, merges
from .source_code import exploded


def u32_at(hexadecimal: Column, offset: Column) -> Column:
    """Little-endian unsigned integer at a byte offset of a column of hexadecimal text; bytes past the end count as zero."""
    got = F.rpad(F.substr(hexadecimal, 2 * offset + 1, F.lit(8)), 8, "0")
    part = lambda i: F.substring(got, i, 2)
    return F.conv(F.concat(part(7), part(5), part(3), part(1)), 16, 10).cast("long")


def xml_properties(xml: Column) -> Column:
    """Map of an XML text's attributes and elements without children, by local name; the last one of a name counts."""
    local = lambda x: F.regexp_replace(x, "^.*:", "")
    attribute, element = r'(?:^|\s)([A-Za-z_:][A-Za-z0-9_.:-]*)\s*=\s*"([^"]*)"', r"<([A-Za-z_:][A-Za-z0-9_.:-]*)[^>]*>([^<]+)</\1>"

    def pairs(pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(xml, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(xml, F.lit(pattern), F.lit(2)).alias("v"))
        return F.transform(both, lambda p: F.struct(local(p["k"]).alias("k"), labels.with_label(js_trim(p["v"])).alias("v")))

    linked = F.regexp_extract(xml, r'(?i)r:id="([^"]+)"', 1)
    extra = F.when(linked != "", F.array(F.struct(F.lit("relationshipId").alias("k"), linked.alias("v"))))
    every = F.concat(pairs(attribute), pairs(element), F.coalesce(extra, F.array().cast("array<struct<k:string,v:string>>")))
    return merges.merged(every, "k", "v")


def activex_controls(parts: DataFrame) -> DataFrame:
    """Pairs ``activeXN.xml`` with the first ``activeXN.bin`` of its document: doc_id, id, xml_path, bin_path, class_id, label, properties, bin."""
    number = F.regexp_extract("path", r"(?i)/activeX/activeX([0-9]+)\.(?:xml|bin)\z", 1)
    own = parts.withColumn("number", number).where("number <> ''")
    xml = own.where(F.endswith(F.lower("path"), F.lit(".xml"))).select("doc_id", "number", "ord", F.col("path").alias("xml_path"), xml_properties(F.decode("content", "UTF-8")).alias("properties"))
    bins = own.where(F.endswith(F.lower("path"), F.lit(".bin"))).groupBy("doc_id", "number").agg(F.min_by(F.struct("path", "content"), "ord").alias("b"))
    p = lambda k: F.try_element_at("properties", F.lit(k))
    class_id = F.coalesce(p("classid"), p("classId"), p("clsid"))
    guid = normalize_guid(class_id)
    out = xml.join(bins, ["doc_id", "number"], "left")
    return out.select("doc_id", F.concat(F.lit("activeX"), "number").alias("id"), "ord", "xml_path", F.col("b.path").alias("bin_path"), F.coalesce(guid, class_id).alias("class_id"), labels.guid_label(guid).alias("label"), F.coalesce(p("persistence"), p("persistStorage")).alias("persistence"), "properties", F.col("b.content").alias("bin"))


def inferred_bounds(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The most likely position and size in twips among a form stream's first 160 bytes: left, top, width, height, confidence."""
    size = F.octet_length(column)
    last = F.least(size, F.lit(160)) - 16
    at = F.when((size >= 32) & (last >= 8), F.sequence(F.lit(8), last, F.lit(4))).otherwise(F.array().cast("array<int>"))
    read = lambda h, o: F.struct(o.alias("offset"), u32_at(h, o).alias("left"), u32_at(h, o + 4).alias("top"), u32_at(h, o + 8).alias("width"), u32_at(h, o + 12).alias("height"))
    fits = lambda c: (c["left"] < 60_000) & (c["top"] < 60_000) & c["width"].between(30, 31_999) & c["height"].between(30, 31_999)
    sure = lambda c: (c["left"] < 25_000) & (c["top"] < 25_000) & (c["offset"] <= 64)

    def score(c):  # fixed values: what each trait of a likely form counts
        one = lambda x: x.cast("int")
        return one(c["width"] > c["height"]) + 2 * one((c["width"] > 500) & (c["height"] > 300)) + one((c["left"] < 20_000) & (c["top"] < 20_000)) + 2 * one(sure(c))

    # the bytes are written out once a row, and the best place is exploded: a filter on it would make it again
    cells = bound(F.hex(F.substring(column, 1, 160)), lambda h: F.transform(at, lambda o: read(h, o)))
    scored = F.transform(F.filter(cells, fits), lambda c: F.struct((-score(c)).alias("order"), c["offset"].alias("offset"), c.alias("c"), sure(c).alias("sure")))
    out = exploded(rows, [key], F.slice(F.sort_array(scored), 1, 1), "b")
    out = out.where(F.col("b.sure") | ((F.col("b.c.left") <= 25_000) & (F.col("b.c.top") <= 25_000)))
    return out.select(key, "b.c.left", "b.c.top", "b.c.width", "b.c.height", F.when(F.col("b.sure"), "medium").otherwise("low").alias("confidence"))


def frame_properties(streams: DataFrame) -> DataFrame:
    """Properties of ``VBFrame`` streams (doc_id, container, path, content) by name: the last line of a name counts; Name is the form's."""
    own = streams.where(F.endswith("path", F.lit("/\x03VBFrame"))).withColumn("form", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("text", decode_cp1252(F.col("content")))
    pattern = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s*=\s*(.*?)\s*\z"
    rows = own.select("doc_id", "container", "form", F.posexplode(lines(F.col("text"))).alias("ord", "line"))
    rows = rows.select("doc_id", "container", "form", "ord", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", pattern, 2), r'^"|"\z', "").alias("value")).where("name <> ''")
    begun = own.select("doc_id", "container", "form", F.lit(-1).alias("ord"), F.lit("Name").alias("name"), F.regexp_extract("text", r"(?i)Begin\s+\{[^}]+\}\s+([^\s\r\n]+)", 1).alias("value")).where("value <> ''")
    return rows.unionByName(begun).groupBy("doc_id", "container", "form", "name").agg(F.max_by("value", "ord").alias("value"))


def hex_dump(x: Column, width: int = 16) -> Column:
    """Lines of offset, bytes and printable characters."""
    pairs = hex_pairs(x)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(pairs) / width).cast("int") - 1)), lambda i: F.struct((i * width).alias("at"), F.slice(pairs, i * width + 1, F.lit(width)).alias("b")))
    shown = lambda b: F.array_join(F.transform(b, lambda h: F.when(F.conv(h, 16, 10).cast("int").between(32, 126), F.char(F.conv(h, 16, 10).cast("int"))).otherwise(".")), "")
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(rows, lambda r: F.concat(F.lit("0x"), F.lpad(F.hex(r["at"]), 8, "0"), F.lit("  "), F.rpad(F.lower(F.array_join(r["b"], " ")), 3 * width - 1, " "), F.lit("  "), shown(r["b"]))), "\n")).otherwise("")
