"""Registered queries over rendered office documents, from the folder to the tables of ``documents.model``, and the SQL that says what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import containers, office
from . import rendered
from . import rendered_documents as D
from .queries import QUERIES, SQL

_S = "(SELECT s_suppkey::BIGINT AS k FROM supplier)"
_BUTTON = "{D7053240-CE69-11CD-A777-00DD01143C57}"


def _query(name: str, table: str, sql: str, *columns: str):
    """Columns (expressions of SQL) of a table of the model, of every rendered document."""

    def run(spark, sf_dir):
        model = D.model(spark, sf_dir)
        return D.numbered(model[table], model["documents"]).selectExpr("file", "k", *columns)

    QUERIES[name], SQL[name] = run, sql


def _rows(*rows: str, source: str = _S) -> str:
    return " UNION ALL ".join(f"SELECT {r} FROM {source}" for r in rows)


_DOC = "'doc' || k || '.xlsm' AS file, k"


def package_entries(spark, sf_dir):
    """Entries of packages by the data source: the filter on kind is pushed, so nothing else is unpacked."""
    office.register(spark)
    found = spark.read.format("office_parts").load(D.folder(spark, sf_dir)).where("kind IN ('media', 'activex') OR path IS NULL")
    k = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    return found.select("file", k.alias("k"), F.coalesce("ord", F.lit(-1)).alias("ord"), "path", "kind", F.coalesce("method", F.lit(-1)).alias("method"), F.when(F.col("kind") == "media", F.col("content").cast("string")).alias("text"), F.coalesce(F.octet_length("content"), F.lit(-1)).cast("long").alias("size"), "error")


QUERIES["package_entries"] = package_entries
SQL["package_entries"] = _rows(
    f"{_DOC}, 2 AS ord, 'xl/media/image1.png' AS path, 'media' AS kind, 8 AS method, 'png' || k AS text, 3 + length(k::VARCHAR) AS size, NULL AS error",
    f"{_DOC}, 4, 'xl/activeX/activeX1.bin', 'activex', 8, NULL, 2560, NULL",
    "'bad' || k || '.xlsm' AS file, k, -1, NULL, NULL, -1, NULL, -1, 'no end of central directory'",
)

_query(
    "document_sources",
    "source_files",
    _rows(
        f"{_DOC}, 'Module' || k || '.bas' AS name, 'vba' AS kind, 'xl/vbaProject.bin/VBA/Module' || k || ' @ 0x3' AS place, 'Attribute VB_Name = \"Module' || k || '\"' || chr(13) || chr(10) || 'Public Sub Run' || k || '()' || chr(13) || chr(10) || '  Helper' || chr(13) || chr(10) || '  Shell \"x' || k || '\"' || chr(13) || chr(10) || 'End Sub' || chr(13) || chr(10) AS text",
        f"{_DOC}, 'Cls' || k || '.cls', 'vba', 'xl/vbaProject.bin/VBA/Cls' || k || ' @ 0x0', 'Attribute VB_Name = \"Cls' || k || '\"' || chr(13) || chr(10) || 'Sub Helper()' || chr(13) || chr(10) || '  Run' || k || chr(13) || chr(10) || 'End Sub' || chr(13) || chr(10)",
        f"{_DOC}, 'Form1.frm', 'frm', 'xl/vbaProject.bin/VBA/Form1 @ 0x5', 'Attribute VB_Name = \"Form1\"' || chr(13) || chr(10) || 'Private Sub cmdGo_Click()' || chr(13) || chr(10) || 'End Sub' || chr(13) || chr(10) || 'Private Sub lost_Click()' || chr(13) || chr(10) || 'End Sub' || chr(13) || chr(10)",
        "'mod' || k || '.bas' AS file, k, 'mod' || k || '.bas', 'vba', 'mod' || k || '.bas', 'Sub Caf' || chr(233) || k || '()' || chr(13) || chr(10) || 'End Sub'",
    ),
    "name", "kind", "regexp_replace(source_path, '^(file:|[a-z0-9]+://).*/', '') AS place", "text",
)

_LIB = r"'*\G{00020430-0000-0000-C000-000000000046}#2.' || k % 10 || '#0#C:\lib' || k || '.dll'"
_query(
    "document_references",
    "references",
    _rows(
        rf"{_DOC}, 'PROJECT' AS source, 'registered' AS kind, 'Lib ' || k AS name, {_LIB} AS lib_id, '{{00020430-0000-0000-C000-000000000046}}' AS guid, '2.' || k % 10 AS version, '*\G{{00020430-0000-0000-C000-000000000046}}' AS path, 'Reference=' || {_LIB} || '#Lib ' || k AS raw",
        rf"{_DOC}, 'dir', 'registered', 'ref' || k, {_LIB} || '#Lib ' || k, '{{00020430-0000-0000-C000-000000000046}}', '2.' || k % 10, 'C:\lib' || k || '.dll', 'record 0x000D ' || {_LIB} || '#Lib ' || k",
    ),
    "source", "kind", "name", "lib_id", "guid", "version", "path", "raw",
)

_property = lambda key, name: f"try_element_at(properties, '{key}') AS {name}"
_query(
    "document_controls",
    "controls",
    _rows(
        f"{_DOC}, 'i01' AS id, 'Form1/i01' AS path, NULL AS parent_path, 'Go ' || k AS name, 'Go ' || k AS caption, 'Microsoft Forms 2.0 CommandButton control' AS type, 'Forms.CommandButton.1' AS prog_id, 300 + k % 500 AS \"left\", 200 AS top, 1200 AS width, 400 + k % 90 AS height, 'medium' AS confidence, 'cmdGo (low)' AS said, '1200 x ' || (400 + k % 90) || ' twips @ 0x0008 (medium)' AS size, (300 + k % 500) || ', 200 twips @ 0x0008 (medium)' AS at, 3 AS streams",
        f"{_DOC}, 'i02', 'Form1/i01/i02', 'Form1/i01', 'inner' || k, 'inner' || k, NULL, NULL, -1, -1, -1, -1, NULL, 'inner' || k || ' (low)', NULL, '10, 20 twips @ 0x0008 (medium)', 1",
        f"{_DOC}, 'lost', 'Form1/inferred/lost', NULL, 'lost', NULL, 'Inferred MSForms control', NULL, -1, -1, -1, -1, NULL, NULL, NULL, NULL, 0",
    ),
    "id", "path", "parent_path", "name", "caption", "type", "prog_id", *(f"coalesce({c}, -1) AS {c}" for c in ("left", "top", "width", "height")), "confidence", _property("Decoded Name", "said"), _property("Decoded DisplayedSize", "size"), _property("Decoded SitePosition", "at"), "coalesce(size(streams), 0) AS streams",
)

_query(
    "document_form_properties",
    "form_properties",
    # a size counts below 32,000 twips and is sure below 25,000; without one the caption is the third property, not the fourth
    _rows(*(f"{_DOC}, 'Form1' AS form, {n} AS name, {v} AS value" for n, v in (("'Caption'", "'Form ' || k"), ("'ClientHeight'", "(100 + k)::VARCHAR"), ("'Name'", "'Form1'"), ("'Decoded Caption'", "'Main ' || k || ' (medium)'"), ("'FormControl PropMask'", "'0x00080400 (DisplayedSize, Caption)'"), ("'Label ' || CASE WHEN 4000 + k < 32000 THEN 3 ELSE 2 END", "'Main ' || k"))))
    + f" UNION ALL SELECT {_DOC}, 'Form1', 'Decoded DisplayedSize', (4000 + k) || ' x 3000 twips @ 0x0008 (' || CASE WHEN 4000 + k < 25000 THEN 'medium' ELSE 'low' END || ')' FROM {_S} WHERE 4000 + k < 32000",
    "form", "name", "value",
)

_query(
    "document_events",
    "event_links",
    _rows(f"{_DOC}, 'cmdGo_Click' AS procedure, 'Form1/i01' AS linked_control_path", f"{_DOC}, 'lost_Click', 'Form1/inferred/lost'"),
    "procedure", "linked_control_path",
)

_query(
    "document_media",
    "media",
    _rows(
        f"{_DOC}, 'xl-media-image1.png' AS name, 'image/png' AS mime_type, 'xl/media/image1.png' AS source_path, 3 + length(k::VARCHAR) AS size",
        f"{_DOC}, 'Form1-Form1-o-01.gif', 'image/gif', 'xl/vbaProject.bin/Form1/o / GIF image at 0x0005', 15",
        "'pic' || k || '.frx' AS file, k, 'pic' || k || '-01.gif', 'image/gif', 'pic' || k || '.frx / GIF image at 0x0002', 15",
    ),
    "name", "mime_type", "source_path", "size",
)

_query(
    "document_activex",
    "activex_controls",
    _rows(f"{_DOC}, 'activeX1' AS id, 'xl/activeX/activeX1.xml' AS xml_path, 'xl/activeX/activeX1.bin' AS bin_path, '{_BUTTON}' AS class_id, 'persistStorage' AS persistence, 'Tip ' || k AS tip, 'rId' || k AS relation, 'cfb-storage' AS format, 'high' AS confidence, 'Forms.CommandButton.1' AS prog_id, '{_BUTTON}' AS clsid, '0x00000008 (Caption)' AS mask, '2.0' AS version, 'Press ' || k AS caption"),
    "id", "xml_path", "bin_path", "class_id", "persistence", _property("tip", "tip"), _property("relationshipId", "relation"), "persistence_analysis.format AS format", "persistence_analysis.confidence AS confidence", "persistence_analysis.class.prog_id AS prog_id", "persistence_analysis.class.clsid AS clsid", _property("bin.PersistedPropMask", "mask"), _property("bin.PersistedRecordVersion", "version"), _property("bin.Caption", "caption"),
)

_FORM = [("Form1-Form1-_VBFrame.frx", "/Form1/0x03 VBFrame"), ("Form1-Form1-f.frx", "/Form1/f"), ("Form1-Form1-i01-_CompObj.frx", "/Form1/i01/0x01 CompObj"), ("Form1-Form1-i01-f.frx", "/Form1/i01/f"), ("Form1-Form1-i01-i02-o.frx", "/Form1/i01/i02/o"), ("Form1-Form1-i01-o.frx", "/Form1/i01/o"), ("Form1-Form1-o.frx", "/Form1/o")]
_FILES = [
    ("'Form1.frm'", "frm", "'Form1/code/'"), ("'Cls' || k || '.cls'", "vba", "'Cls' || k || '/code/'"), ("'Module' || k || '.bas'", "vba", "'Module' || k || '/code/'"), ("'Form1-Form1-o-01.gif'", "media", "'Form1/media/'"), ("'xl-media-image1.png'", "media", "'Office_media_parts/media/'"),
    *((f"'{n}'", "frx", "'Form1/resources/'") for n, _ in _FORM),
    ("'office-package-manifest.json'", "binary", "'Office_package_parts/office-package/'"), ("'vba-project-references.json'", "binary", "'vba-project-references.json/other/'"), ("'xl-activeX-activeX1.bin'", "binary", "'Office_activeX_parts/office-package/'"), ("'xl-activeX-activeX1.xml'", "binary", "'Office_activeX_parts/office-package/'"),
]
_query(
    "document_files",
    "files",
    _rows(
        *(f"{_DOC}, {i} AS n, {n} AS name, '{kind}' AS kind, {path} || '{i:03d}-' || {n} AS zip_path" for i, (n, kind, path) in enumerate(_FILES, 1)),
        "'mod' || k || '.bas' AS file, k, 1, 'mod' || k || '.bas', 'vba', 'mod' || k || '/code/001-mod' || k || '.bas'",
        "'pic' || k || '.frx' AS file, k, 1, 'pic' || k || '-01.gif', 'media', 'pic' || k || '-01/media/001-pic' || k || '-01.gif'",
        "'pic' || k || '.frx' AS file, k, 2, 'pic' || k || '.frx', 'frx', 'pic' || k || '/resources/002-pic' || k || '.frx'",
    ),
    "n", "name", "kind", "zip_path",
)

_query("rejected_documents", "rejected", _rows("'note' || k || '.txt' AS file, k, 'unsupported' AS format"), "format")


def zip_export(spark, sf_dir):
    """Rendered sources packed into a package per document by tasks, then read back entry by entry."""
    office.register(spark)
    folder = D.shared(spark, "export")
    files = rendered.files(spark, sf_dir).select("doc_id", "file_ord", F.col("name").alias("path"), F.encode("text", "UTF-8").alias("content"))
    containers.write_zips(files, folder).write.format("noop").mode("overwrite").save()
    found = spark.read.format("office_parts").load(folder)
    return found.select(F.regexp_extract("file", "^([0-9]+)[.]zip$", 1).cast("long").alias("doc_id"), "ord", "path", "method", "size", F.md5("content").alias("digest"))


QUERIES["zip_export"] = zip_export
SQL["zip_export"] = f"WITH {rendered.FILES_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY file_ord) - 1)::INTEGER AS ord, name AS path, 0 AS method, strlen(text)::BIGINT AS size, md5(text) AS digest FROM files"
