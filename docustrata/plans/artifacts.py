"""What an export holds besides the extracted files: reports, models as JSON, previews, and one text per procedure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_number, safe_file_name
from ..operators import reports as R


def _json(rows: DataFrame, order: list[str], fields: list[str], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A JSON array of the rows of each document, in order. Rows are sorted as texts: maps in them have no order."""
    each = rows.select(*by, F.struct(*order, F.to_json(F.struct(*fields)).alias("x")).alias("r"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), ",")
    return each.groupBy(*by).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("text"))


def _object(docs: DataFrame, **arrays: DataFrame) -> DataFrame:
    """A JSON object of arrays; those that a document lacks are empty."""
    out = docs.select("doc_id")
    for name, rows in arrays.items():
        out = out.join(rows.withColumnRenamed("text", name), "doc_id", "left")
    said = (F.concat(F.lit(f'"{n}":'), F.coalesce(F.col(n), F.lit("[]"))) for n in arrays)
    return out.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}")).alias("text"))


def chunk_path(module: Column, proc_ord: Column, name: Column) -> Column:
    n = (proc_ord + 1).cast("string")
    return F.concat(F.lit("procedure-chunks/"), safe_file_name(module), F.lit("/"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")), F.lit("-"), safe_file_name(name), F.lit(".vba"))


def procedure_chunks(bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """One text per procedure (doc_id, path, text): what is known of it as comments, then its lines; an open one has its first line only."""
    called = edges.groupBy("doc_id", "file_ord", "proc_ord").agg(F.array_join(F.array_sort(F.collect_set("callee")), ", ").alias("calls"))
    rows = bodies.join(called, ["doc_id", "file_ord", "proc_ord"], "left")
    end = F.coalesce("line_end", "line_start")
    body = F.when(F.col("line_end").isNull(), F.split_part("body", F.lit("\n"), F.lit(1))).otherwise(F.col("body"))
    said = {"Module": F.col("module"), "Procedure": F.col("name"), "Kind": F.col("kind"), "Scope": F.col("scope"), "Lines": F.concat_ws("-", F.col("line_start").cast("string"), end.cast("string")), "Calls": F.coalesce("calls", F.lit("none")), "Uses": F.coalesce(F.nullif(F.array_join("uses", ", "), F.lit("")), F.lit("none"))}
    text = F.concat(*(F.concat(F.lit(f"' {k}: "), v, F.lit("\n")) for k, v in said.items()), body, F.lit("\n"))
    return rows.select("doc_id", chunk_path(F.col("module"), F.col("proc_ord"), F.col("name")).alias("path"), text.alias("text"))


def layout_model(m: dict[str, DataFrame]) -> DataFrame:
    """Views with their size and controls with their bounds, in twips, and the embedded controls, as JSON."""
    value = lambda k: F.max(F.when(F.col("name") == k, F.col("value")))
    said = m["form_properties"].groupBy("doc_id", "form").agg(value("Caption").alias("caption"), parse_number(value("ClientWidth")).alias("client_width"), parse_number(value("ClientHeight")).alias("client_height"))
    bounds = F.when(F.col("left").isNotNull(), F.struct("left", "top", "width", "height", "unit", "confidence")).alias("bounds")
    each = m["controls"].select("doc_id", "form", F.struct("control_ord", F.struct("path", "name", "caption", "type", "prog_id", bounds, "parent_path").alias("x")).alias("r")).groupBy("doc_id", "form").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("controls"))
    views = m["forms"].join(said, ["doc_id", "form"], "left").join(each, ["doc_id", "form"], "left").withColumnRenamed("form", "name")
    return _object(m["documents"], views=_json(views, ["name"], ["name", "caption", "client_width", "client_height", "controls"]), document_controls=_json(m["activex_controls"], ["ord"], ["id", "label", "class_id", "xml_path", "bin_path", "properties"]))


def traceability(m: dict[str, DataFrame]) -> DataFrame:
    """Where every extracted file, module, procedure and control of the export comes from, as JSON."""
    procs = m["procedures"].withColumn("chunk_path", chunk_path(F.col("module"), F.col("proc_ord"), F.col("name")))
    return _object(
        m["documents"],
        files=_json(m["files"], ["n"], ["name", "kind", "zip_path", "source_path", "size"]),
        modules=_json(m["modules"], ["file_ord"], ["module", "file_name", "source_path"]),
        procedures=_json(procs, ["file_ord", "proc_ord"], ["module", "name", "line_start", "line_end", "chunk_path"]),
        controls=_json(m["controls"], ["form", "control_ord", "path"], ["form", "path", "name", "caption", "type", "streams", "parent_path"]),
        document_controls=_json(m["activex_controls"], ["ord"], ["id", "label", "class_id", "xml_path", "bin_path", "source_files"]),
    )


def application_model(m: dict[str, DataFrame]) -> DataFrame:
    """The relations of a document as one JSON object."""
    return _object(
        m["documents"],
        source_files=_json(m["files"], ["n"], ["name", "kind", "zip_path", "size"]),
        modules=_json(m["modules"], ["file_ord"], ["module", "file_name", "kind", "source_path"]),
        procedures=_json(m["procedures"], ["file_ord", "proc_ord"], ["module", "name", "kind", "scope", "signature", "parameters", "return_type", "line_start", "line_end", "uses"]),
        calls=_json(m["call_edges"], ["file_ord", "proc_ord", "callee"], ["module", "name", "callee_module", "callee"]),
        variables=_json(m["variables"], ["file_ord", "line"], ["module", "name", "scope", "type", "line", "statement"]),
        constants=_json(m["constants"], ["file_ord", "line"], ["module", "name", "scope", "type", "line", "statement"]),
        declarations=_json(m["declares"], ["file_ord", "line"], ["module", "statement"]),
        events=_json(m["event_links"], ["file_ord", "proc_ord"], ["module", "procedure", "control_name", "event_name", "linked_control_path", "linked_control_type"]),
        risk_markers=_json(m["risk_markers"], ["file_ord", "line", "rule_ord"], ["module", "category", "line", "text", "reason"]),
        module_references=_json(m["module_references"], ["module", "reference"], ["module", "reference"]),
        project_references=_json(m["references"], ["ord"], ["source", "kind", "name", "lib_id", "guid", "version", "path", "raw"]),
        form_properties=_json(m["form_properties"], ["form", "name"], ["form", "name", "value"]),
        controls=_json(m["controls"], ["form", "control_ord", "path"], ["form", "id", "path", "parent_path", "name", "caption", "type", "prog_id", "properties"]),
        document_controls=_json(m["activex_controls"], ["ord"], ["id", "label", "class_id", "xml_path", "bin_path", "persistence", "properties"]),
        dependencies=_json(m["dependencies"], ["ord", "value"], ["category", "value", "file_name", "reason"]),
        assets=_json(m["media"], ["name", "source_path"], ["name", "mime_type", "size", "source_path"]),
    )


def artifacts(m: dict[str, DataFrame]) -> DataFrame:
    """All generated files of every document: doc_id, path, text. ``m``: the tables of ``documents.model``.

    A document's report is joined in one task, as its export is; the relations behind it stay distributed.
    """
    unlinked = m["event_links"].where("linked_control_path is null")
    single = {
        "application-model.json": application_model(m),
        "application-summary.md": R.application_summary(m),
        "llm-rebuild-brief.md": R.rebuild_brief(m),
        "migration-checklist.md": R.migration_checklist(m["dependencies"], m["risk_markers"], unlinked, m["forms"], m["controls"], m["events"], m["procedures"], m["variables"]),
        "call-graph.md": R.call_graph(m["procedures"], m["call_edges"], m["event_links"]),
        "dependency-report.md": R.dependency_report(m["dependencies"], m["risk_markers"]),
        "vba-project-references.md": R.references_report(m["references"]),
        "frontend-implementation-plan.md": R.frontend_plan(m),
        "migration-test-plan.md": R.migration_test_plan(m["events"], m["procedures"], m["call_edges"], m["dependencies"]),
        "layout-model.json": layout_model(m),
        "traceability-map.json": traceability(m),
        "activex-controls.json": _json(m["activex_controls"], ["ord"], ["id", "label", "class_id", "xml_path", "bin_path", "properties"]),
        "activex-persistence.json": _json(m["activex_controls"].where("persistence_analysis is not null"), ["ord"], ["id", "xml_path", "bin_path", "persistence_analysis"]),
        "validation-report.md": R.validation_report(m["validation"], m["event_links"], m["controls"], m["files"]),
    }
    out = None
    for path, rows in single.items():
        one = rows.select("doc_id", F.lit(path).alias("path"), "text")
        out = one if out is None else out.unionByName(one)
    name = safe_file_name(F.col("form"))
    for rows, ending in ((R.preview_svg(m["preview"]), ".svg"), (R.preview_html(m["preview"]), ".html")):
        out = out.unionByName(rows.select("doc_id", F.concat(F.lit("visual-previews/"), name, F.lit(ending)).alias("path"), "text"))
    designer = _json(m["controls"], ["control_ord", "path"], ["id", "path", "parent_path", "name", "caption", "type", "prog_id", "properties", "streams"], ("doc_id", "form"))
    out = out.unionByName(designer.select("doc_id", F.concat(name, F.lit("/designer-summary/"), name, F.lit(".designer.json")).alias("path"), "text"))
    return out.unionByName(procedure_chunks(m["bodies"], m["call_edges"]))


def export_entries(m: dict[str, DataFrame]) -> DataFrame:
    """All entries of every document's export, generated ones first: doc_id, file_ord, path, content. Input of ``containers.write_zips``."""
    from pyspark.sql import Window

    made = artifacts(m).select("doc_id", F.lit(0).alias("late"), "path", F.encode("text", "UTF-8").alias("content"))
    taken = m["files"].select("doc_id", F.lit(1).alias("late"), F.col("zip_path").alias("path"), "content")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("late", "path"))
    return made.unionByName(taken).select("doc_id", order.alias("file_ord"), "path", "content")
