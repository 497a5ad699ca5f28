"""Forms and controls: trees, linking with event handlers, inferred controls, layout, groups, scores.

Controls: (doc_id, form, control_ord, id, path, parent_path, name, caption, type, prog_id, properties map, left, top, width, height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_identifier
from . import rules
from .source_code import exploded


def control_tree(paths: DataFrame) -> DataFrame:
    """Every prefix of the given paths (doc_id, path), once, with parent_path and depth (1 at the top)."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    each = paths.select("doc_id", parts.alias("parts")).select("doc_id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").where("size(parts) > 0")
    at = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return each.select("doc_id", at(F.col("depth")).alias("path"), F.when(F.col("depth") > 1, at(F.col("depth") - 1)).alias("parent_path"), "depth").distinct()


def inferred_type(name: Column) -> Column:
    """Control type from a name's prefix, or from what it holds."""
    lower, out = F.lower(name), None
    for prefixes, part, label in rules.CONTROL_TYPES:
        hit = F.contains(lower, F.lit(part))
        for p in prefixes:
            hit |= F.startswith(lower, F.lit(p))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(rules.CONTROL_DEFAULT)


def _first_part(value: Column, table, default: str) -> Column:
    out = None
    for part, label in table:
        hit = F.contains(value, F.lit(part))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def widget(type_: Column, prog_id: Column) -> Column:
    return _first_part(F.lower(F.concat_ws(" ", F.coalesce(type_, F.lit("")), F.coalesce(prog_id, F.lit("")))), rules.WIDGETS, rules.WIDGET_DEFAULT)


def preview_kind(*values: Column) -> Column:
    return _first_part(F.lower(F.concat_ws(" ", *(F.coalesce(v, F.lit("")) for v in values))), rules.KINDS, rules.KIND_DEFAULT)


def _control_keys(controls: DataFrame) -> DataFrame:
    """What a handler may call a control: name, caption, id and property values, normalised."""
    said = F.concat(F.array("name", "caption", "id"), F.coalesce(F.map_values("properties"), F.array().cast("array<string>")))
    keys = F.array_distinct(F.transform(F.filter(said, lambda x: x.isNotNull() & (x != "")), normalize_identifier))
    return exploded(controls, ["*"], keys, "key")


def event_links(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Events with linked_control_path and linked_control_type: of the form with the module's name, the first control (by order, then path) that answers to the handler's."""
    keyed = _control_keys(controls).groupBy("doc_id", F.col("form").alias("module"), "key").agg(F.min_by(F.struct("path", "type"), F.struct("control_ord", "path")).alias("c"))
    out = events.withColumn("key", normalize_identifier(F.col("control_name"))).join(keyed, ["doc_id", "module", "key"], "left")
    return out.select(*events.columns, F.col("c.path").alias("linked_control_path"), F.col("c.type").alias("linked_control_type"))


def inferred_controls(events: DataFrame, controls: DataFrame, forms: DataFrame) -> DataFrame:
    """A control for every handler of a form (doc_id, form) that no control answers to, once per normalised name, from its first handler."""
    keyed = _control_keys(controls).select("doc_id", F.col("form").alias("module"), "key").distinct()
    lost = events.withColumn("key", normalize_identifier(F.col("control_name"))).join(forms.select("doc_id", F.col("form").alias("module")).distinct(), ["doc_id", "module"], "left_semi").join(keyed, ["doc_id", "module", "key"], "left_anti")
    first = lost.groupBy("doc_id", "module", "key").agg(F.min_by(F.struct("control_name", "procedure"), F.struct("file_ord", "proc_ord")).alias("e"))
    name = F.col("e.control_name")
    return first.select("doc_id", F.col("module").alias("form"), name.alias("id"), F.concat_ws("/", "module", F.lit("inferred"), name).alias("path"), name.alias("name"), inferred_type(name).alias("type"), F.col("e.procedure").alias("inferred_from"))


def preview_layout(controls: DataFrame) -> DataFrame:
    """Controls with bounds, scaled to fit 900 x 560 with their form, and the form's size.

    The form's extent is a grouped maximum joined back: the aggregate is partial, so a form with very
    many controls is no single task's burden.
    """
    placed = controls.where("left is not null and top is not null and width is not null and height is not null")
    extent = placed.groupBy("doc_id", "form").agg(F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    scale = F.least(F.lit(1.0), F.lit(900.0) / F.greatest("right", F.lit(1)), F.lit(560.0) / F.greatest("bottom", F.lit(1)))
    extent = extent.withColumn("scale", scale)
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    s = F.col("scale")
    return placed.join(extent, ["doc_id", "form"]).select(
        "doc_id",
        "form",
        "control_ord",
        "path",
        preview_kind(F.col("type"), F.col("prog_id"), F.col("caption"), F.col("name")).alias("kind"),
        F.coalesce(F.nullif("caption", F.lit("")), F.nullif("name", F.lit("")), F.col("id")).alias("label"),
        rounded(F.col("left") * s + 8).alias("x"),
        rounded(F.col("top") * s + 8).alias("y"),
        rounded(F.greatest(F.lit(36.0), F.col("width") * s)).alias("w"),
        rounded(F.greatest(F.lit(24.0), F.col("height") * s)).alias("h"),
        F.ceil(F.greatest(F.lit(360.0), F.col("right") * s + 24)).cast("long").alias("form_width"),
        F.ceil(F.greatest(F.lit(220.0), F.col("bottom") * s + 24)).cast("long").alias("form_height"),
    )


def internal_path(source_path: Column) -> Column:
    """A file's path inside its macro project, without notes on how it was found; null for files from elsewhere."""
    inner = F.regexp_extract(source_path, r"vbaProject\.bin/([\s\S]*)\z", 1)
    plain = F.regexp_replace(F.regexp_replace(inner, r"(?i)\s+@\s+0x[0-9a-f]+.*\z", ""), r"(?i)\s+\(recovered by scan\)\z", "")
    return F.when(F.contains(source_path, F.lit("vbaProject.bin/")), plain)


def display_path(source_path: Column) -> Column:
    """What a file's place is shown as: its path inside the project, control characters spelt out, or where it came from."""
    inner = F.nullif(internal_path(source_path), F.lit(""))
    return F.coalesce(F.replace(F.replace(inner, F.lit("\x01"), F.lit("0x01 ")), F.lit("\x03"), F.lit("0x03 ")), source_path)


def result_owner(name: Column, source_path: Column) -> Column:
    """Whom an extracted file belongs to: the storage it came from, the package area, or its own stem."""
    inner = F.coalesce(internal_path(source_path), F.lit(""))
    owner = F.split_part(inner, F.lit("/"), F.lit(1))
    area = F.regexp_extract(source_path, r"(?i)/(word|xl|ppt)/(media|activeX|embeddings)/", 2)
    shown = F.replace(F.replace(owner, F.lit("\x01"), F.lit("0x01 ")), F.lit("\x03"), F.lit("0x03 "))
    return (
        F.when((inner != "") & ~F.startswith(F.lower(inner), F.lit("vba/")), F.when(F.rlike(owner, F.lit("(?i)^project")), "Project metadata").otherwise(shown))
        .when(area != "", F.concat(F.lit("Office "), area, F.lit(" parts")))
        .when(name == "office-package-manifest.json", "Office package parts")
        .otherwise(F.regexp_replace(name, r"(?i)\.(bas|cls|frm|frx|png|jpg|jpeg|gif|bmp|tif|ico|cur|wmf|emf)\z", ""))
    )


def kind_rank(kind: Column) -> Column:
    out = None
    for i, k in enumerate(("frm", "vba", "media", "frx", "binary")):
        out = F.when(kind == k, i) if out is None else out.when(kind == k, i)
    return out


def result_groups(files: DataFrame) -> DataFrame:
    """Counts of each owner's code, resources, media and other files, and its place: owners of forms first, then by name."""
    kind = F.col("kind")
    code, resource, media = kind.isin("vba", "frm"), kind == "frx", kind == "media"
    out = files.withColumn("owner", result_owner(F.col("name"), F.col("source_path"))).groupBy("doc_id", "owner")
    out = out.agg(
        F.count_if(code).alias("code"),
        F.count_if(resource).alias("resources"),
        F.count_if(media).alias("media"),
        F.count_if(~(code | resource | media)).alias("other"),
        F.bool_or((kind == "frm") | resource).alias("has_form"),
    )
    place = Window.partitionBy("doc_id").orderBy(F.col("has_form").desc(), F.collate(F.col("owner"), "UNICODE"))
    return out.withColumn("place", F.row_number().over(place))


#: The typed lists of an owner: name -> kinds.
LISTS = {"code": ("vba", "frm"), "resources": ("frx",), "media": ("media",), "other": ("binary",)}


def result_lists(files: DataFrame) -> DataFrame:
    """Each owner's files (name, kind, display_path, size) as four lists, each by kind, then display path in the order of the locale, then name.

    doc_id, owner, code, resources, media, other, has_form, has_designer (a form's code or resources, not the project's own), place (owners of forms
    first, then by name). The lists are one ordered aggregate each; a list is a row's value, so an owner's must fit one.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("text")
    rows = files.select("doc_id", result_owner(F.col("name"), F.col("source_path")).alias("owner"), "name", "kind", display_path(F.col("source_path")).alias("display_path"), size.cast("long").alias("size"))
    rows = rows.withColumns({"rank": kind_rank(F.col("kind")), "item": F.to_json(F.struct("name", "kind", "display_path", "size"))})
    kinds = lambda own: ", ".join(f"'{k}'" for k in own)
    one = lambda own: F.expr(f"listagg(item, ',') WITHIN GROUP (ORDER BY rank, collate(display_path, 'UNICODE'), collate(name, 'UNICODE'), size, item) FILTER (WHERE kind IN ({kinds(own)}))")
    out = rows.groupBy("doc_id", "owner").agg(*(one(own).alias(n) for n, own in LISTS.items()), F.bool_or(F.col("kind").isin("frm", "frx")).alias("has_form"))
    read = lambda n: F.from_json(F.concat(F.lit("["), F.coalesce(n, F.lit("")), F.lit("]")), "array<struct<name:string,kind:string,display_path:string,size:long>>").alias(n)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("has_form").desc(), F.collate(F.col("owner"), "UNICODE")))
    return out.select("doc_id", "owner", *(read(n) for n in LISTS), "has_form", (F.col("has_form") & (F.col("owner") != "Project metadata")).alias("has_designer"), place.alias("place"))


def zip_path(owner: Column, kind: Column, source_path: Column, name: Column, index: Column) -> Column:
    """Path of a file in the export: owner / category / number-name; numbers are padded to three digits, never cut."""
    from ..functions.text import safe_file_name

    office = F.rlike(source_path, F.lit(r"(?i)office-package-manifest|/(word|xl|ppt)/"))
    category = F.when(kind == "media", "media").when(kind == "frx", "resources").when(kind.isin("frm", "vba"), "code").when(office, "office-package").otherwise("other")
    digits = index.cast("string")
    return F.concat(safe_file_name(owner), F.lit("/"), category, F.lit("/"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")), F.lit("-"), safe_file_name(name))


def validation(files: DataFrame, controls: DataFrame, linked: DataFrame) -> DataFrame:
    """Coverage counts and the confidence score of each document: the share of five tests passed, in percent.

    Counts come from grouped aggregates, so documents of any size cost one row per task.
    """
    kind, path = F.col("kind"), F.col("source_path")
    source = kind.isin("vba", "frm")
    f = files.groupBy("doc_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(source).alias("n_source"),
        F.count_if(source & F.contains(path, F.lit("recovered by scan"))).alias("n_fallback"),
        F.count_if(kind == "media").alias("n_media"),
        F.count_if(F.rlike(path, F.lit("(?i)/activeX/"))).alias("n_activex"),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    c = controls.groupBy("doc_id").agg(
        F.count("*").alias("n_controls"),
        F.count_if(filled("type") | filled("prog_id")).alias("n_typed"),
        F.count_if(filled("name") | filled("caption")).alias("n_named"),
        F.count_if(F.col("left").isNotNull()).alias("n_bounded"),
        F.count_if(F.contains("path", F.lit("/inferred/"))).alias("n_inferred"),
    )
    e = linked.groupBy("doc_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("linked_control_path").isNotNull()).alias("n_linked"))
    out = f.join(c, "doc_id", "left").join(e, "doc_id", "left")
    counts = [x for x in out.columns if x.startswith("n_")]
    out = out.select("doc_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in counts))
    col = F.col
    tests = [
        (col("n_source") > 0) | (col("n_media") > 0) | (col("n_activex") > 0),
        col("n_fallback") == 0,
        (col("n_events") == 0) | (col("n_linked") / col("n_events") >= 0.75),
        (col("n_controls") == 0) | (col("n_typed") / col("n_controls") >= 0.75),
        (col("n_controls") == 0) | (col("n_inferred") / col("n_controls") <= 0.5),
    ]
    tests = [F.coalesce(t, F.lit(True)) for t in tests]
    passed = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return out.withColumn("score", F.floor(100 * passed / len(tests) + 0.5).cast("long"))
