"""Text reports: relations of ordered lines, joined per document by one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_xml, graph_node_id, mermaid_label


def joined(rows: DataFrame, by: list[str], order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """One text per group: its lines in order."""
    got = rows.select(*by, F.struct(*order, line.alias("line")).alias("x")).groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return got.select(*by, F.array_join(F.transform("xs", lambda x: x["line"]), sep).alias("text"))


def top(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of every group: a report's limit, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def _lines(rows: DataFrame, section: int, line: Column, k1: str | int = 0, k2: str | int = 0, k3: str = "") -> DataFrame:
    """Lines of a report: their section, their place in it, and the text."""
    number = lambda k: (F.col(k) if isinstance(k, str) else F.lit(k)).cast("long")
    return rows.select("doc_id", F.lit(section).alias("section"), number(k1).alias("k1"), number(k2).alias("k2"), (F.col(k3) if k3 else F.lit("")).alias("k3"), line.alias("line"))


def _said(docs: DataFrame, section: int, *texts: str) -> DataFrame:
    """Lines that every document has."""
    return docs.select("doc_id", F.lit(section).alias("section"), F.posexplode(F.array(*map(F.lit, texts))).alias("k1", "line")).select("doc_id", "section", F.col("k1").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit("").alias("k3"), "line")


def _counted(docs: DataFrame, section: int, what: list[tuple[str, DataFrame]]) -> DataFrame:
    """Lines ``- name: number`` of grouped counts; documents without rows have zero."""
    out = docs
    for i, (_, rows) in enumerate(what):
        out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(f"n{i}")), "doc_id", "left")
    each = F.array(*(F.concat(F.lit(f"- {name}: "), F.coalesce(f"n{i}", F.lit(0)).cast("string")) for i, (name, _) in enumerate(what)))
    return out.select("doc_id", F.lit(section).alias("section"), F.posexplode(each).alias("k1", "line")).select("doc_id", "section", F.col("k1").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit("").alias("k3"), "line")


def _titled(rows: DataFrame, section: int) -> DataFrame:
    """A heading for every module that has rows."""
    return _lines(rows.select("doc_id", "file_ord", "module").distinct(), section, F.concat(F.lit("### "), "module"), "file_ord", -1)


def written(*parts: DataFrame) -> DataFrame:
    """One text per document: the lines of all parts by section and place. A document's report must fit a task."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return joined(rows, ["doc_id"], ["section", "k1", "k2", "k3"], F.col("line"))


_event = lambda: F.concat("procedure", F.lit(": "), "control_name", F.lit("."), "event_name")
_linked = lambda other: F.coalesce(F.concat(F.lit(" -> "), "linked_control_path"), F.lit(other))


def call_graph(procedures: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Mermaid graph of a document's calls, procedures without calls as lone nodes, the number of edges, and the handlers by module."""
    docs = procedures.select("doc_id").distinct()
    a, b = F.concat_ws(".", "module", "name"), F.concat_ws(".", "callee_module", "callee")
    node = lambda x: F.concat(graph_node_id(x), F.lit('["'), mermaid_label(x), F.lit('"]'))
    lone = procedures.join(edges.select("doc_id", "file_ord", "proc_ord"), ["doc_id", "file_ord", "proc_ord"], "left_anti")
    count = docs.join(edges.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return written(
        _said(docs, 0, "# VBA Call Graph", "", "```mermaid", "graph TD"),
        _lines(edges, 1, F.concat(F.lit("  "), node(a), F.lit(" --> "), node(b)), "file_ord", "proc_ord", "callee"),
        _lines(lone, 1, F.concat(F.lit("  "), node(a)), "file_ord", "proc_ord"),
        _lines(count, 2, F.concat(F.lit("```\n\nEdges: "), F.coalesce("n", F.lit(0)).cast("string"))),
        _said(docs, 3, "", "## Event Entry Points"),
        _titled(links, 4),
        _lines(links, 4, F.concat(F.lit("- "), _event(), _linked("")), "file_ord", "proc_ord"),
    )


def dependency_report(dependencies: DataFrame, risks: DataFrame, most: int = 60) -> DataFrame:
    """Sections of categories in the order they first occur, one line per dependency, then the first ``most`` risk markers of every module."""
    docs = dependencies.select("doc_id").unionByName(risks.select("doc_id")).distinct()
    first = dependencies.groupBy("doc_id", "category").agg(F.min(F.struct("ord.file_ord", "ord.ord")).alias("place"))
    rank = Window.partitionBy("doc_id").orderBy("place")
    first = first.withColumn("k", F.row_number().over(rank))
    own = dependencies.join(first, ["doc_id", "category"]).withColumn("m", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("ord", "value")))
    r = top(risks, ["doc_id", "file_ord"], ["line", "rule_ord"], most)
    return written(
        _said(docs, 0, "# Dependency Report", ""),
        _lines(first, 1, F.concat(F.lit("## "), "category"), "k", -1),
        _lines(own, 1, F.concat(F.lit("- "), "value", F.lit(" in "), "file_name", F.lit(": "), "reason"), "k", "m"),
        _said(docs, 2, "", "## Risk Markers"),
        _titled(risks, 3),
        _lines(r, 3, F.concat(F.lit("- Line "), F.col("line").cast("string"), F.lit(": "), "category", F.lit(" - "), "reason", F.lit("\n  - "), "text"), "file_ord", "rank"),
    )


def summary_report(summary: DataFrame) -> DataFrame:
    """One line per module, by name."""
    line = F.format_string("- %s (%s): %d procedures, %d handlers, %d dependencies", "module", "kind", "n_procedures", "n_events", "n_dependencies")
    return joined(summary, ["doc_id"], ["module"], line)


def _item(text: Column) -> Column:
    return F.concat(F.lit("- [ ] "), text)


def migration_checklist(dependencies: DataFrame, risks: DataFrame, unlinked: DataFrame, forms: DataFrame, controls: DataFrame, events: DataFrame, procedures: DataFrame, variables: DataFrame, most: int = 80) -> DataFrame:
    """Open points of a document: what to rebuild and to port, its dependencies, the first ``most`` risk markers, handlers without a control."""
    docs = procedures.select("doc_id").unionByName(dependencies.select("doc_id")).unionByName(forms.select("doc_id")).distinct()
    own = dependencies.withColumn("m", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "value")))
    r = top(risks, ["doc_id"], ["file_ord", "line", "rule_ord"], most)
    open_ = variables.where(F.lower("scope").isin("public", "global"))
    return written(
        _said(docs, 0, "# Migration Checklist", "", "## To Rebuild"),
        _counted(docs, 1, [("[ ] Forms", forms), ("[ ] Controls", controls), ("[ ] Event handlers to wire", events), ("[ ] Procedures to port", procedures), ("[ ] Public or global variables to replace by state", open_)]),
        _said(docs, 2, "", "## Dependencies"),
        _lines(own, 3, _item(F.format_string("Replace or implement %s: %s (%s).", "category", "value", "file_name")), "m"),
        _said(docs, 4, "", "## Review Items"),
        _lines(r, 5, _item(F.format_string("%s:%d %s - %s", "module", "line", "category", "reason")), "rank"),
        _said(docs, 6, "", "## Unlinked Events"),
        _lines(unlinked, 7, _item(F.format_string("%s.%s (%s.%s) needs a control.", "module", "procedure", "control_name", "event_name")), "file_ord", "proc_ord"),
    )


def migration_test_plan(events: DataFrame, procedures: DataFrame, edges: DataFrame, dependencies: DataFrame, most: int = 80) -> DataFrame:
    """Tests of a document: each handler, of every module the first ``most`` procedures that compute, use or call something, and each dependency.

    ``procedures`` with uses; ``edges`` are their calls.
    """
    docs = procedures.select("doc_id").unionByName(dependencies.select("doc_id")).distinct()
    called = edges.groupBy("doc_id", "file_ord", "proc_ord").agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    some = procedures.join(called, ["doc_id", "file_ord", "proc_ord"], "left").where((F.col("kind") == "Function") | (F.size("uses") > 0) | F.col("calls").isNotNull())
    p = top(some, ["doc_id", "file_ord"], ["proc_ord"], most)
    notes = F.concat_ws("; ", F.nullif(F.array_join("uses", ", "), F.lit("")), F.concat(F.lit("calls "), F.array_join("calls", ", ")))
    own = dependencies.withColumn("m", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "value")))
    return written(
        _said(docs, 0, "# Migration Test Plan", "", "## Smoke Tests", "- [ ] The application loads without errors.", "- [ ] Every form opens and every control shows.", "- [ ] Recovered media load or are replaced.", "", "## Event Tests"),
        _titled(events, 1),
        _lines(events, 1, _item(F.format_string("Trigger %s.%s and compare with %s.", "control_name", "event_name", "procedure")), "file_ord", "proc_ord"),
        _said(docs, 2, "", "## Procedure Tests"),
        _titled(p, 3),
        _lines(p, 3, _item(F.concat("name", F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""))), "file_ord", "proc_ord"),
        _said(docs, 4, "", "## Dependency Tests"),
        _lines(own, 5, _item(F.format_string("Validate the replacement of %s: %s (%s).", "category", "value", "file_name")), "m"),
    )


def validation_report(validation: DataFrame, links: DataFrame | None = None, controls: DataFrame | None = None, files: DataFrame | None = None, most: int = 80) -> DataFrame:
    """The counts and the score of a document as lines; given them, also its first ``most`` handlers without a control, inferred controls, properties of low confidence, and sources found by scanning."""
    names = [c for c in validation.columns if c.startswith("n_")]
    parts = [F.concat(F.lit("Overall extraction confidence: "), F.col("score").cast("string"), F.lit("%"))] + [F.concat(F.lit(f"- {n[2:].replace('_', ' ')}: "), F.col(n).cast("string")) for n in names]
    lines = [_lines(validation, 0, F.concat_ws("\n", *parts))]
    docs = validation.select("doc_id")
    if links is not None:
        lost = top(links.where("linked_control_path is null"), ["doc_id"], ["file_ord", "proc_ord"], most)
        lines += [_said(docs, 1, "", "## Unlinked Events"), _lines(lost, 2, F.concat(F.lit("- "), _event()), "rank")]
    if controls is not None:
        inferred = top(controls.where(F.contains("path", F.lit("/inferred/"))), ["doc_id"], ["path"], most)
        low = controls.select("doc_id", "path", F.explode("properties").alias("key", "value")).where(F.rlike("value", F.lit(r"(?i)\(low\)\z")))
        low = top(low, ["doc_id"], ["path", "key"], most)
        source = F.coalesce(F.try_element_at("properties", F.lit("InferredFromEvent")), F.lit("a handler's name"))
        lines += [_said(docs, 3, "", "## Inferred Controls"), _lines(inferred, 4, F.concat(F.lit("- "), "path", F.lit(": "), "type", F.lit(" from "), source), "rank")]
        lines += [_said(docs, 5, "", "## Low-Confidence Properties"), _lines(low, 6, F.concat(F.lit("- "), "path", F.lit(": "), "key", F.lit(" = "), "value"), "rank")]
    if files is not None:
        scanned = files.where(F.contains("source_path", F.lit("recovered by scan")) & F.col("kind").isin("vba", "frm"))
        lines += [_said(docs, 7, "", "## Fallback Source Files"), _lines(scanned, 8, F.concat(F.lit("- "), "name", F.lit(": "), "source_path"), 0, 0, "source_path")]
    return written(*lines)


def application_summary(m: dict[str, DataFrame], most: int = 12) -> DataFrame:
    """Overview of a document: inventory, forms with their properties and controls, embedded controls, references, modules, dependencies."""
    docs = m["documents"].select("doc_id")
    shown = F.coalesce("name", "caption", "id")
    props = top(m["form_properties"].withColumnRenamed("name", "key"), ["doc_id", "form"], ["key"], most)
    uses = m["procedures"].groupBy("doc_id", "file_ord").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("uses")))).alias("uses"))
    mods = m["modules"].join(uses, ["doc_id", "file_ord"], "left")
    own = m["dependencies"].withColumn("m", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "value")))
    form_key = lambda rows, kind: rows.withColumn("k", F.concat("form", F.lit(kind)))
    return written(
        _said(docs, 0, "# Application Migration Summary", "", "## Inventory"),
        _counted(docs, 1, [("Source files", m["source_files"]), ("Modules", m["modules"]), ("Project references", m["references"]), ("Forms", m["forms"]), ("Controls", m["controls"]), ("Document ActiveX controls", m["activex_controls"]), ("Procedures", m["procedures"]), ("Dependencies", m["dependencies"]), ("Assets", m["media"])]),
        _said(docs, 2, "", "## Forms"),
        _lines(form_key(m["forms"], "\x00"), 3, F.concat(F.lit("### "), "form"), 0, 0, "k"),
        _lines(form_key(props, "\x01"), 3, F.concat(F.lit("- "), "key", F.lit(": "), "value"), 0, 0, "k"),
        _lines(form_key(m["controls"], "\x02").withColumn("k", F.concat("k", "path")), 3, F.concat(F.lit("  - "), shown, F.lit(": "), F.coalesce("type", "prog_id", F.lit("unknown control")), F.lit(" ("), "path", F.lit(")")), 0, 0, "k"),
        _said(docs, 4, "", "## Document ActiveX Controls"),
        _lines(m["activex_controls"], 5, F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("label", "class_id", F.lit("unknown control"))), "ord"),
        _said(docs, 6, "", "## VBA Project References"),
        _lines(m["references"], 7, F.concat(F.lit("- "), F.coalesce("name", "kind"), F.lit(": "), F.coalesce("lib_id", "raw")), "ord"),
        _said(docs, 8, "", "## Modules"),
        _titled(mods, 9),
        _lines(mods, 9, F.concat(F.lit("- Kind: "), "kind", F.lit("\n- Procedures: "), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit("\n- Uses: "), F.nullif(F.array_join("uses", ", "), F.lit(""))), F.lit(""))), "file_ord", -1, "file_name"),
        _lines(m["event_links"], 9, F.concat(F.lit("  - "), _event(), _linked("")), "file_ord", "proc_ord"),
        _said(docs, 10, "", "## Dependencies"),
        _lines(own, 11, F.concat(F.lit("- "), "category", F.lit(": "), "value", F.lit(" ("), "file_name", F.lit(", "), "reason", F.lit(")")), "m"),
    )


def frontend_plan(m: dict[str, DataFrame], most: int = 80) -> DataFrame:
    """Where each part of a document goes in a rebuild: state, components, services, event wiring, adapters."""
    docs = m["documents"].select("doc_id")
    state = top(m["variables"].where(F.lower("scope").isin("public", "global")), ["doc_id"], ["file_ord", "line"], most)
    from .controls import widget

    counts = m["procedures"].groupBy("doc_id", "file_ord").agg(F.count("*").alias("n"))
    services = m["modules"].where("kind in ('standard', 'class')").join(counts, ["doc_id", "file_ord"], "left")
    first = m["dependencies"].groupBy("doc_id", "category").agg(F.min("ord").alias("ord")).withColumn("m", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    return written(
        _said(docs, 0, "# Frontend Implementation Plan", "", "Forms become views, standard modules services, class modules domain classes; workbook state becomes explicit state.", "", "## State Model Candidates"),
        _lines(state, 1, F.concat(F.lit("- "), "module", F.lit("."), "name", F.coalesce(F.concat(F.lit(": "), "type"), F.lit(""))), "rank"),
        _said(docs, 2, "", "## UI Components"),
        _lines(m["forms"].withColumn("k", F.concat("form", F.lit("\x00"))), 3, F.concat(F.lit("### "), "form", F.lit("\n- Component: `"), "form", F.lit("View`")), 0, 0, "k"),
        _lines(m["controls"].withColumn("k", F.concat("form", F.lit("\x01"), "path")), 3, F.concat(F.lit("  - "), F.coalesce("name", "caption", "id"), F.lit(": "), widget(F.col("type"), F.col("prog_id"))), 0, 0, "k"),
        _said(docs, 4, "", "## Services"),
        _lines(services, 5, F.concat(F.lit("- `"), "module", F.lit("Service`: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" procedure(s) of "), "file_name"), "file_ord"),
        _said(docs, 6, "", "## Event Wiring"),
        _titled(m["event_links"], 7),
        _lines(m["event_links"], 7, F.concat(F.lit("- "), F.coalesce("linked_control_path", "control_name"), F.lit(" "), "event_name", F.lit(" -> `"), "procedure", F.lit("`")), "file_ord", "proc_ord"),
        _said(docs, 8, "", "## Integration Adapters"),
        _lines(first, 9, F.concat(F.lit("- "), "category"), "m"),
    )


def rebuild_brief(m: dict[str, DataFrame]) -> DataFrame:
    """What someone who rebuilds a document's application needs first: reading order, inventory, handlers, warnings."""
    docs = m["documents"].select("doc_id")
    own = m["dependencies"].withColumn("m", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "value")))
    linked = m["event_links"].where("linked_control_path is not null")
    return written(
        _said(docs, 0, "# Rebuild Brief", "", "## Read Order", "1. `application-summary.md`", "2. `application-model.json`", "3. sources under `code/`", "4. `designer-summary/*.designer.json`", "5. `resources/` and `media/` where looks are unclear", "", "## Inventory"),
        _counted(docs, 1, [("Forms", m["forms"]), ("Controls", m["controls"]), ("Modules", m["modules"]), ("Procedures", m["procedures"]), ("Event handlers", m["events"]), ("Linked event handlers", linked), ("Detected dependencies", m["dependencies"]), ("VBA project references", m["references"]), ("Recovered assets", m["media"])]),
        _said(docs, 2, "", "## Event Handler Map"),
        _titled(m["event_links"], 3),
        _lines(m["event_links"], 3, F.concat(F.lit("- "), _event(), _linked(" -> unlinked")), "file_ord", "proc_ord"),
        _said(docs, 4, "", "## Dependency Warnings"),
        _lines(own, 5, F.concat(F.lit("- "), "category", F.lit(": "), "value", F.lit(" from "), "file_name", F.lit(": "), "reason"), "m"),
    )


def references_report(references: DataFrame) -> DataFrame:
    """References of a document by kind, in the order the kinds occur."""
    from .labels import guid_label

    first = references.groupBy("doc_id", "kind").agg(F.min("ord").alias("place"))
    title = F.coalesce("name", "guid", "lib_id")
    line = F.concat(F.lit("- "), title, F.coalesce(F.concat(F.lit(" ["), guid_label(F.col("guid")), F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(", version "), "version"), F.lit("")), F.coalesce(F.concat(F.lit(", "), "path"), F.lit("")))
    sections = joined(references, ["doc_id", "kind"], ["ord"], line).join(first, ["doc_id", "kind"])
    return joined(sections, ["doc_id"], ["place"], F.concat(F.lit("## "), F.initcap("kind"), F.lit(" References\n"), "text"), "\n\n")


# Fill, line, text and corner of each kind of control in a preview.
_STYLES = {
    "button": ("#eef3f4", "#8a9ca1", "#172026", 4),
    "label": ("rgba(255,255,255,0)", "rgba(255,255,255,0)", "#172026", 0),
    "textbox": ("#ffffff", "#8a9ca1", "#172026", 2),
    "combo": ("#ffffff", "#8a9ca1", "#172026", 2),
    "listbox": ("#ffffff", "#8a9ca1", "#172026", 2),
    "frame": ("rgba(255,255,255,0.52)", "#8fb9b4", "#526168", 3),
    "tabs": ("rgba(255,255,255,0.7)", "#8fb9b4", "#526168", 3),
    "image": ("#f4f7f8", "#8a9ca1", "#607178", 3),
    "checkbox": ("rgba(255,255,255,0)", "rgba(255,255,255,0)", "#172026", 0),
    "radio": ("rgba(255,255,255,0)", "rgba(255,255,255,0)", "#172026", 0),
}
_STYLE = ("rgba(217,235,232,0.88)", "#1e6b66", "#173532", 4)


def _style(kind: Column, i: int) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in _STYLES.items() for x in (k, str(v[i]))))
    return F.coalesce(F.try_element_at(table, kind), F.lit(str(_STYLE[i])))


def preview_svg(layout: DataFrame) -> DataFrame:
    """An SVG drawing of every form (doc_id, form, text) from the rows of ``controls.preview_layout``."""
    kind = F.col("kind")
    most = F.greatest(F.lit(6), F.floor(F.col("w") / 7)).cast("int")
    label = F.when(F.length("label") > most, F.concat(F.substr(F.col("label"), F.lit(1), most - 3), F.lit("..."))).otherwise(F.col("label"))
    text_y = F.col("y") + F.greatest(F.lit(15.0), F.least(F.col("h") - 6.0, F.col("h") / 2 + 4))
    text_x = F.col("x") + F.when(kind.isin("checkbox", "radio"), 24).otherwise(8)
    mark_y = F.col("y") + F.greatest(F.lit(6.0), F.col("h") / 2 - 6)
    extra = (
        F.when(kind == "radio", F.format_string('<circle cx="%s" cy="%s" r="6" fill="#ffffff" stroke="#526168"/>', F.col("x") + 13, mark_y + 6))
        .when(kind == "checkbox", F.format_string('<rect x="%s" y="%s" width="12" height="12" rx="2" fill="#ffffff" stroke="#526168"/>', F.col("x") + 7, mark_y))
        .when(kind.isin("combo", "spin"), F.format_string('<rect x="%s" y="%s" width="21" height="%s" fill="#e5ecee" stroke="#c9d5d8"/><text x="%s" y="%s" font-size="9">%s</text>', F.col("x") + F.col("w") - 22, F.col("y") + 1, F.greatest(F.lit(0), F.col("h") - 2), F.col("x") + F.col("w") - 15, text_y, F.when(kind == "spin", "+-").otherwise("v")))
        .when(kind == "image", F.format_string('<path d="M %s %s L %s %s L %s %s" fill="none" stroke="#607178"/>', F.col("x") + 8, F.col("y") + F.col("h") - 8, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("x") + F.col("w") - 8, F.col("y") + F.col("h") - 8))
        .otherwise("")
    )
    box = F.format_string('<g data-path="%s" data-kind="%s"><rect x="%s" y="%s" width="%s" height="%s" rx="%s" fill="%s" stroke="%s"/>%s<text x="%s" y="%s" font-size="11" fill="%s">%s</text></g>', escape_xml(F.col("path")), kind, "x", "y", "w", "h", _style(kind, 3), _style(kind, 0), _style(kind, 1), extra, text_x, text_y, _style(kind, 2), escape_xml(label))
    sized = layout.groupBy("doc_id", "form").agg(F.max("form_width").alias("fw"), F.max("form_height").alias("fh"))
    out = joined(layout, ["doc_id", "form"], ["control_ord", "path"], box).join(sized, ["doc_id", "form"])
    name = escape_xml(F.col("form"))
    return out.select("doc_id", "form", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s" viewBox="0 0 %s %s" role="img" aria-label="%s visual preview">\n<rect width="100%%" height="100%%" fill="#ffffff"/>\n<text x="10" y="18" font-size="11" fill="#607178">%s</text>\n%s\n</svg>\n', "fw", "fh", "fw", "fh", name, name, "text").alias("text"))


def preview_html(layout: DataFrame) -> DataFrame:
    """An HTML page of every form (doc_id, form, text) with its controls as placed boxes."""
    box = F.format_string('<div class="control %s" title="%s" style="position:absolute;left:%spx;top:%spx;width:%spx;height:%spx;border:1px solid %s;background:%s;color:%s">%s</div>', "kind", escape_html(F.col("path")), "x", "y", "w", "h", _style(F.col("kind"), 1), _style(F.col("kind"), 0), _style(F.col("kind"), 2), escape_html(F.col("label")))
    sized = layout.groupBy("doc_id", "form").agg(F.max("form_width").alias("fw"), F.max("form_height").alias("fh"))
    out = joined(layout, ["doc_id", "form"], ["control_ord", "path"], box).join(sized, ["doc_id", "form"])
    name = escape_html(F.col("form"))
    return out.select("doc_id", "form", F.format_string('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>%s visual preview</title></head>\n<body><h1>%s</h1>\n<div class="preview" style="position:relative;width:%spx;height:%spx">\n%s\n</div></body></html>\n', name, name, "fw", "fh", "text").alias("text"))
