"""From a folder of documents to the tables that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binary import decode_cp1252
from ..functions.text import safe_file_name
from ..operators import activex, embedded, forms, profiles
from ..operators import binary as B
from ..operators import controls as C
from ..operators import source_code as S
from ..sources import containers, macros


def streams(docs: DataFrame) -> DataFrame:
    """Compound streams of OLE documents and of the macro projects inside packages: doc_id, container, ord, path, content."""
    whole = docs.where("format = 'ole'").select("doc_id", F.col("file_name").alias("container"), "content")
    packed = containers.package_parts(docs.where("format = 'zip'"), r"vbaProject\.bin$").where("content is not null")
    inside = packed.select("doc_id", F.col("path").alias("container"), "content")
    both = whole.unionByName(inside)
    keyed = both.select(F.to_json(F.struct("doc_id", "container")).alias("doc_id"), "content")
    got = containers.compound_streams(keyed).where("path is not null")
    part = lambda k: F.get_json_object("doc_id", f"$.{k}")
    return got.select(part("doc_id").alias("doc_id"), part("container").alias("container"), "ord", "path", "content")


def source_files(docs: DataFrame, compound: DataFrame | None = None) -> DataFrame:
    """Sources of all documents (doc_id, file_ord, name, kind, source_path, text): loose files, and the modules of ``compound`` streams where given."""
    loose = docs.where("format = 'raw'").where(~F.endswith(F.lower("file_name"), F.lit(".frx")))
    kind = F.when(F.endswith(F.lower("file_name"), F.lit(".frm")), "frm").otherwise("vba")
    plain = loose.select("doc_id", F.lit(0).alias("file_ord"), F.col("file_name").alias("name"), kind.alias("kind"), F.col("path").alias("source_path"), decode_cp1252(F.col("content")).alias("text"))
    plain = plain.withColumn("text", F.regexp_replace("text", r"\x00+\z", ""))
    return plain if compound is None else plain.unionByName(macros.module_sources(compound))


def resources(docs: DataFrame, streams: DataFrame) -> DataFrame:
    """Binary resources of forms (doc_id, container, ord, path, content): designer streams, and loose ``.frx`` files under their own names."""
    loose = docs.where(F.endswith(F.lower("file_name"), F.lit(".frx")) & (F.col("format") == "raw")).select("doc_id", F.lit("").alias("container"), F.lit(0).alias("ord"), F.col("file_name").alias("path"), "content")
    return forms.designer_streams(streams).select("doc_id", "container", "ord", "path", "content").unionByName(loose)


def media(resources: DataFrame, parts: DataFrame) -> DataFrame:
    """Pictures of resources and of binary package parts, and the media parts themselves: doc_id, ord, name, mime_type, source_path, content, size.

    A picture's name is its stream's with a running number.
    """
    place = lambda c, p: F.concat_ws("/", F.nullif(c, F.lit("")), p)
    inner = resources.select("doc_id", place(F.col("container"), F.col("path")).alias("at"), F.concat(safe_file_name(F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(1)), r"(?i)\.frx\z", "")), F.when(F.contains("path", F.lit("/")), F.concat(F.lit("-"), safe_file_name(F.replace("path", F.lit("/"), F.lit("-"))))).otherwise("")).alias("base"), "content")
    packed = parts.where("kind in ('binary', 'activex') and content is not null and not lower(path) like '%vbaproject.bin'").select("doc_id", F.col("path").alias("at"), safe_file_name(F.replace("path", F.lit("/"), F.lit("-"))).alias("base"), "content")
    keyed = inner.unionByName(packed).select(F.to_json(F.struct("doc_id", "at", "base")).alias("k"), "content")
    found = B.media(keyed, "k", "content")
    number = F.row_number().over(Window.partitionBy("k").orderBy("offset", "place"))
    get = lambda n: F.get_json_object("k", f"$.{n}")
    found = found.withColumn("n", number).select(get("doc_id").alias("doc_id"), F.format_string("%s-%02d.%s", get("base"), "n", "extension").alias("name"), "mime_type", F.concat(get("at"), F.lit(" / "), "place").alias("source_path"), F.col("bytes").alias("content"))
    whole = parts.where("kind = 'media' and content is not null").select("doc_id", safe_file_name(F.replace("path", F.lit("/"), F.lit("-"))).alias("name"), "mime_type", F.col("path").alias("source_path"), "content")
    return whole.unionByName(found).withColumn("size", F.octet_length("content").cast("long"))


def extracted_files(docs: DataFrame, files: DataFrame, resources: DataFrame, media: DataFrame, parts: DataFrame, references: DataFrame) -> DataFrame:
    """All files that an extraction gives: doc_id, n (from 1, by kind, then name in the order of the locale), name, kind, mime_type, source_path, content, size."""
    columns = ["doc_id", "name", "kind", "mime_type", "source_path", "content"]
    text = F.lit("text/plain;charset=windows-1252")
    code = files.select("doc_id", "name", "kind", text.alias("mime_type"), "source_path", F.encode("text", "UTF-8").alias("content"))
    binary = F.lit("application/octet-stream")
    stored = resources.select("doc_id", F.when(F.endswith(F.lower("path"), F.lit(".frx")), F.col("path")).otherwise(F.concat(safe_file_name(F.split_part("path", F.lit("/"), F.lit(1))), F.lit("-"), safe_file_name(F.replace("path", F.lit("/"), F.lit("-"))), F.lit(".frx"))).alias("name"), F.lit("frx").alias("kind"), binary.alias("mime_type"), F.concat_ws("/", F.nullif("container", F.lit("")), "path").alias("source_path"), "content")
    packed = parts.where("content is not null and kind <> 'media' and not lower(path) like '%vbaproject.bin'").select("doc_id", safe_file_name(F.replace("path", F.lit("/"), F.lit("-"))).alias("name"), F.lit("binary").alias("kind"), "mime_type", "path", "content").withColumnRenamed("path", "source_path")
    json = lambda rows, name, fields: rows.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))), lambda r: r["x"])).alias("text")).select("doc_id", F.lit(name).alias("name"), F.lit("binary").alias("kind"), F.lit("application/json").alias("mime_type"), F.lit(f"[{name}]").alias("source_path"), F.encode("text", "UTF-8").alias("content"))
    refs = json(references, "vba-project-references.json", ["source", "kind", "name", "lib_id", "guid", "version", "path", "raw"])
    manifest = json(parts.where("content is not null and not lower(path) like '%vbaproject.bin'"), "office-package-manifest.json", ["path", "kind", "size", "note"])
    every = code.select(*columns)
    for more in (stored, media.withColumn("kind", F.lit("media")), packed, refs, manifest):
        every = every.unionByName(more.select(*columns))
    # a path begins with its document's name; a loose file's is that name
    at = F.when(F.contains("source_path", F.lit("://")) | F.startswith("source_path", F.lit("file:/")) | (F.col("source_path") == F.col("file_name")), F.col("file_name")).when(F.startswith("source_path", F.concat("file_name", F.lit(" / "))), F.col("source_path")).otherwise(F.concat("file_name", F.lit("/"), "source_path"))
    every = every.join(docs.select("doc_id", "file_name"), "doc_id").withColumn("source_path", at).drop("file_name")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(C.kind_rank(F.col("kind")), F.collate(F.col("name"), "UNICODE"), "source_path"))
    return every.withColumns({"n": n, "size": F.octet_length("content").cast("long")})


def model(spark: SparkSession, path: str | DataFrame, scratch: str | None = None) -> dict[str, DataFrame]:
    """The tables of the documents of a folder (or of ``containers.addressed_documents``) by name; each is lazy and can be written by itself.

    ``scratch``: a folder that all executors share. Given it, documents are read once, streams, sources and package parts are decoded once and
    written there, and all tables read them; without it, each table that is run decodes the folder's containers anew.
    """
    docs = path if isinstance(path, DataFrame) else containers.raw_documents(spark, path)

    def once(df: DataFrame, name: str) -> DataFrame:
        if scratch is None:
            return df
        df.write.mode("overwrite").parquet(f"{scratch.rstrip('/')}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch.rstrip('/')}/{name}")

    docs = once(docs, "documents")
    compound = once(streams(docs), "streams")
    parts = once(containers.classified(containers.package_parts(docs.where("format = 'zip'"), containers.WANTED)), "package_parts")
    loose = source_files(docs)
    files = once(loose.unionByName(macros.module_sources(compound)), "source_files")
    procs = S.procedure_uses(S.procedures(files, with_body=True))
    held = resources(docs, compound)
    analysed = once(forms.form_streams(held), "form_streams")
    designed = forms.controls(compound, analysed)
    pictures = media(held, parts)
    references = macros.references(compound)
    events = S.events(procs)
    modules = S.modules(files)
    form = F.split_part("path", F.lit("/"), F.lit(1))
    forms_ = held.where(F.contains("path", F.lit("/"))).select("doc_id", form.alias("form")).unionByName(modules.where("kind = 'form'").select("doc_id", F.col("module").alias("form"))).distinct()
    inferred = C.inferred_controls(events, designed, forms_)
    none = lambda t: F.lit(None).cast(t)
    notes = F.create_map(F.lit("InferredFromEvent"), F.col("inferred_from"), F.lit("Confidence"), F.lit("event-name heuristic"))
    guessed = inferred.select("doc_id", none("string").alias("container"), "form", F.lit(2**31 - 1).alias("control_ord"), "id", "path", none("string").alias("parent_path"), "name", none("string").alias("caption"), "type", none("string").alias("prog_id"), notes.alias("properties"), none("array<string>").alias("streams"), *(none("long").alias(k) for k in ("left", "top", "width", "height")), none("string").alias("unit"), none("string").alias("confidence"))
    controls = designed.unionByName(guessed)
    linked = C.event_links(events, controls)
    embedded_ = activex.persisted_controls(embedded.activex_controls(parts))
    dependencies = S.dependencies(files).unionByName(S.reference_dependencies(references))
    every = extracted_files(docs, files, held, pictures, parts, references)
    owner = C.result_owner(F.col("name"), F.col("source_path"))
    placed = every.withColumns({"owner": owner, "zip_path": C.zip_path(owner, F.col("kind"), F.col("source_path"), F.col("name"), F.col("n"))})
    return {
        "documents": docs.drop("content"),
        "rejected": docs.where("format = 'unsupported'").drop("content"),
        "package_parts": parts,
        "streams": compound,
        "source_files": files,
        "modules": modules,
        "procedures": procs.drop("body"),
        "bodies": procs,
        "variables": S.variables(files),
        "constants": S.constants(files),
        "declares": S.declares(files),
        "events": events,
        "risk_markers": S.risk_markers(files),
        "dependencies": dependencies,
        "call_edges": S.call_edges(procs),
        "module_references": S.module_references(files),
        "references": references,
        "resources": held,
        "form_streams": analysed,
        "form_records": forms.form_records(analysed),
        "forms": forms_,
        "form_properties": forms.form_properties(compound, analysed),
        "controls": controls,
        "event_links": linked,
        "activex_controls": embedded_,
        "media": pictures,
        "profiles": profiles.stream_profiles(held, ["doc_id", "container"]),
        "preview": C.preview_layout(controls),
        "files": placed,
        "result_groups": C.result_groups(every),
        "result_lists": C.result_lists(every),
        "validation": C.validation(every, controls, linked),
    }
