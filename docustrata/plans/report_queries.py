"""Reports over rendered sources, and the SQL for them: every line of a report with its section and place, put together by one ordered aggregate."""

from __future__ import annotations

from ..functions.patterns import duckdb
from ..operators import controls as C
from ..operators import reports as R
from ..operators import rules
from ..operators import source_code as S
from . import rendered
from .queries import _CALLS, _EVENTS, _G, _PROCS, _RISKS, QUERIES, SQL, _list_of
from .rendered_documents import stored


def _found() -> str:
    """All dependencies with the place of each one's first match and what was found there."""
    parts = []
    for i, (category, pattern, groups, reason) in enumerate(rules.DEPENDENCIES):
        every = [f"regexp_extract_all(text, '(?i){duckdb(pattern)}', {g})" for g in (*groups, 0)]
        value = "coalesce(" + ", ".join(f"nullif(x{j}, '')" for j in range(len(every))) + ")"
        unnested = ", ".join(f"unnest({e}) AS x{j}" for j, e in enumerate(every))
        parts.append(f"SELECT doc_id, '{category}' AS category, trim({value}) AS value, name AS file_name, (file_ord, {i}, m) AS place, '{reason}' AS reason FROM (SELECT doc_id, file_ord, name, unnest(range(len({every[-1]}))) AS m, {unnested} FROM files)")
    return "dep AS (SELECT doc_id, category, value, file_name, min(place) AS place, arg_min(reason, place) AS reason FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id, category, value, file_name)"


#: Procedures, calls, events, controls' keys, dependencies and risk markers of the rendered sources.
_ALL = f"WITH {rendered.FILES_SQL}, {rendered.CONTROLS_SQL}" + _EVENTS.replace(_PROCS, _CALLS).replace(",,", ",", 1) + _RISKS + f""", {_found()}, risk AS (
  SELECT *, {_list_of(why for _, _, why in rules.RISKS)}[rule_ord + 1] AS reason, row_number() OVER (PARTITION BY doc_id, file_ord ORDER BY line, rule_ord) AS in_file,
    row_number() OVER (PARTITION BY doc_id ORDER BY file_ord, line, rule_ord) AS in_doc FROM r
), own AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, value) AS m FROM dep),
handler AS (SELECT *, substr(name, length(control_name) + 2) AS event_name FROM ek)"""


def _report(docs: str, *lines: str, more: str = "") -> str:
    """``lines``: selects of (doc_id, k1, k2, line) or (doc_id, k3, line); a text of its own stands for one that all documents have."""
    rows = []
    for i, x in enumerate(lines):
        if x.lstrip().upper().startswith("SELECT"):
            keys = "0 AS k1, 0 AS k2, k3" if " AS k3" in x else "k1, k2, '' AS k3"
            rows.append(f"SELECT doc_id, {i} AS section, {keys}, line FROM ({x})")
        else:
            rows.append(f"SELECT doc_id, {i} AS section, 0 AS k1, 0 AS k2, '' AS k3, '{x}' AS line FROM docs")
    return f"{_ALL}{more}, docs AS ({docs}), lines AS (" + " UNION ALL ".join(rows) + ") SELECT doc_id, string_agg(line, chr(10) ORDER BY section, k1, k2, k3, line) AS text FROM lines GROUP BY doc_id"


_titled = lambda rows: f"SELECT DISTINCT doc_id, file_ord AS k1, -1 AS k2, '### ' || module AS line FROM {rows}"
_both = lambda *rows: " UNION ALL ".join(rows)

SQL["dependency_report"] = _report(
    "SELECT doc_id FROM dep UNION SELECT doc_id FROM r",
    "# Dependency Report",
    "",
    """SELECT doc_id, k AS k1, n AS k2, line FROM (
      SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS k, n, line FROM (
        SELECT doc_id, min(place) AS first, -1 AS n, '## ' || category AS line FROM dep GROUP BY doc_id, category
        UNION ALL SELECT doc_id, min(place) OVER (PARTITION BY doc_id, category), row_number() OVER (PARTITION BY doc_id, category ORDER BY place, value), '- ' || value || ' in ' || file_name || ': ' || reason FROM dep))""",
    "",
    "## Risk Markers",
    _both(_titled("risk"), "SELECT doc_id, file_ord, in_file, '- Line ' || line || ': ' || category || ' - ' || reason || chr(10) || '  - ' || trim(text) FROM risk WHERE in_file <= 60").replace("UNION ALL SELECT doc_id, file_ord, in_file", "UNION ALL SELECT doc_id, file_ord AS k1, in_file AS k2"),
)

_counts = lambda what: _both(*(f"SELECT d.doc_id, {i} AS k1, 0 AS k2, '- {name}: ' || count(x.doc_id) AS line FROM docs d LEFT JOIN ({rows}) x USING (doc_id) GROUP BY d.doc_id" for i, (name, rows) in enumerate(what)))
_COUNTS = [
    ("[ ] Forms", "SELECT DISTINCT doc_id, form FROM controls"),
    ("[ ] Controls", "SELECT doc_id FROM controls"),
    ("[ ] Event handlers to wire", "SELECT doc_id FROM ek"),
    ("[ ] Procedures to port", "SELECT doc_id FROM p"),
    ("[ ] Public or global variables to replace by state", f"SELECT doc_id FROM l WHERE regexp_matches(text, '(?i){duckdb(rules.VARIABLE)}') AND NOT regexp_matches(text, '(?i){duckdb(rules.NOT_VARIABLE)}') AND lower({_G(rules.VARIABLE, 2)}) <> 'declare' AND lower({_G(rules.VARIABLE, 1)}) IN ('public', 'global')"),
]
SQL["migration_checklist"] = _report(
    "SELECT doc_id FROM p UNION SELECT doc_id FROM dep UNION SELECT doc_id FROM controls",
    "# Migration Checklist",
    "",
    "## To Rebuild",
    _counts(_COUNTS),
    "",
    "## Dependencies",
    "SELECT doc_id, m AS k1, 0 AS k2, '- [ ] Replace or implement ' || category || ': ' || value || ' (' || file_name || ').' AS line FROM own",
    "",
    "## Review Items",
    "SELECT doc_id, in_doc AS k1, 0 AS k2, '- [ ] ' || module || ':' || line || ' ' || category || ' - ' || reason AS line FROM risk WHERE in_doc <= 80",
    "",
    "## Unlinked Events",
    "SELECT doc_id, file_ord AS k1, proc_ord AS k2, '- [ ] ' || module || '.' || name || ' (' || control_name || '.' || event_name || ') needs a control.' AS line FROM handler h WHERE NOT EXISTS (SELECT 1 FROM ck WHERE ck.doc_id = h.doc_id AND ck.form = h.module AND ck.k = h.k)",
)

_USES = "SELECT doc_id, file_ord, proc_ord, string_agg(label, ', ' ORDER BY label) AS uses FROM b, (VALUES " + ", ".join(f"('{n}', '{duckdb(p)}')" for n, p in rules.USES) + ") v(label, pattern) WHERE regexp_matches(body, pattern, 'i') GROUP BY doc_id, file_ord, proc_ord"
_TESTED = f"""(SELECT p.doc_id, p.file_ord, p.module, p.proc_ord, p.name, concat_ws('; ', u.uses, 'calls ' || c.calls) AS notes, row_number() OVER (PARTITION BY p.doc_id, p.file_ord ORDER BY p.proc_ord) AS n FROM p
  LEFT JOIN ({_USES}) u USING (doc_id, file_ord, proc_ord)
  LEFT JOIN (SELECT doc_id, file_ord, proc_ord, string_agg(DISTINCT callee, ', ' ORDER BY callee) AS calls FROM g GROUP BY doc_id, file_ord, proc_ord) c USING (doc_id, file_ord, proc_ord)
  WHERE p.kind = 'Function' OR u.uses IS NOT NULL OR c.calls IS NOT NULL)"""
SQL["migration_test_plan"] = _report(
    "SELECT doc_id FROM p UNION SELECT doc_id FROM dep",
    "# Migration Test Plan",
    "",
    "## Smoke Tests",
    "- [ ] The application loads without errors.",
    "- [ ] Every form opens and every control shows.",
    "- [ ] Recovered media load or are replaced.",
    "",
    "## Event Tests",
    _both(_titled("handler"), "SELECT doc_id, file_ord AS k1, proc_ord AS k2, '- [ ] Trigger ' || control_name || '.' || event_name || ' and compare with ' || name || '.' AS line FROM handler"),
    "",
    "## Procedure Tests",
    _both(_titled(f"{_TESTED} WHERE n <= 80"), f"SELECT doc_id, file_ord AS k1, proc_ord AS k2, '- [ ] ' || name || CASE WHEN notes <> '' THEN ' (' || notes || ')' ELSE '' END AS line FROM {_TESTED} WHERE n <= 80"),
    "",
    "## Dependency Tests",
    "SELECT doc_id, m AS k1, 0 AS k2, '- [ ] Validate the replacement of ' || category || ': ' || value || ' (' || file_name || ').' AS line FROM own",
)


#: References, embedded controls, pictures and form properties of the rendered documents, from suppliers and customers.
_TABLES = {
    "refs": """SELECT CAST(s_suppkey % 30 AS BIGINT) AS doc_id, CAST(s_suppkey AS INT) AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'project' ELSE 'control' END AS kind,
      CASE WHEN s_suppkey % 4 > 0 THEN concat('Lib', s_suppkey) END AS name, CASE WHEN s_suppkey % 5 > 0 THEN concat('lib#', s_suppkey) END AS lib_id, CASE s_suppkey % 3 WHEN 0 THEN '{{00020430-0000-0000-C000-000000000046}}' WHEN 1 THEN '{{11111111-0000-0000-C000-000000000046}}' END AS guid,
      CASE WHEN s_suppkey % 2 = 0 THEN '2.0' END AS version, CASE WHEN s_suppkey % 7 = 0 THEN concat('c:/', s_suppkey, '.dll') END AS path, concat('raw', s_suppkey) AS raw FROM {supplier}""",
    "ax": "SELECT CAST(s_suppkey % 30 AS BIGINT) AS doc_id, concat('activeX', s_suppkey) AS id, CAST(s_suppkey AS INT) AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'Some control' END AS label, CASE WHEN s_suppkey % 3 = 1 THEN '{{X}}' END AS class_id FROM {supplier} WHERE s_suppkey % 2 = 0",
    "media": "SELECT CAST(s_suppkey % 30 AS BIGINT) AS doc_id, concat('p', s_suppkey, '.png') AS name FROM {supplier} WHERE s_suppkey % 3 = 0",
    "props": "SELECT CAST((c_custkey - c_custkey % 50) / 50 AS BIGINT) AS doc_id, concat('Customer', c_custkey) AS form, k AS name, concat(k, ' of ', c_custkey) AS value FROM {customer}, (VALUES ('Caption'), ('ClientHeight'), ('Tag')) AS v(k) WHERE c_custkey % 3 = 2 AND (c_custkey % 2 = 0 OR k <> 'Tag')",
}
_MORE = "".join(f", {n} AS ({q.format(supplier='supplier', customer='customer')})" for n, q in _TABLES.items()) + f""", forms AS (SELECT DISTINCT doc_id, form FROM controls),
lk AS (SELECT h.doc_id, h.file_ord, h.proc_ord, h.module, h.name, h.control_name, h.event_name, arg_min(ck.path, ck.control_ord) AS path FROM handler h LEFT JOIN ck ON ck.doc_id = h.doc_id AND ck.form = h.module AND ck.k = h.k GROUP BY ALL),
mods AS (SELECT doc_id, file_ord, name AS file_name, regexp_replace(name, '[.](bas|cls|frm)$', '') AS module, CASE WHEN name LIKE '%.frm' THEN 'form' WHEN name LIKE '%.cls' THEN 'class' ELSE 'standard' END AS kind FROM files),
used AS ({_USES}), np AS (SELECT doc_id, file_ord, count(*) AS n FROM p GROUP BY doc_id, file_ord),
mu AS (SELECT doc_id, file_ord, string_agg(DISTINCT u, ', ' ORDER BY u) AS uses FROM (SELECT doc_id, file_ord, unnest(string_split(uses, ', ')) AS u FROM used) GROUP BY doc_id, file_ord),
vars AS (SELECT doc_id, file_ord, module, line, {_G(rules.VARIABLE, 2)} AS name, {_G(rules.VARIABLE, 3)} AS type, row_number() OVER (PARTITION BY doc_id ORDER BY file_ord, line) AS n FROM l WHERE regexp_matches(text, '(?i){duckdb(rules.VARIABLE)}') AND NOT regexp_matches(text, '(?i){duckdb(rules.NOT_VARIABLE)}') AND lower({_G(rules.VARIABLE, 2)}) <> 'declare' AND lower({_G(rules.VARIABLE, 1)}) IN ('public', 'global'))"""
_DOCS = "SELECT DISTINCT doc_id FROM files"


def model(spark, sf_dir, *once: str) -> dict:
    """The tables of ``documents.model`` that reports read, from the rendered sources. Those named ``once``, and the sources that they are made from, are made once and stored."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    table = lambda n: spark.sql(_TABLES[n], **{t: read(t) for t in ("supplier", "customer") if f"{{{t}}}" in _TABLES[n]})
    keep = lambda rows, name: stored(rows, name) if name in once else rows
    files, controls = rendered.files(spark, sf_dir), rendered.controls(spark, sf_dir)
    files = stored(files, "source_files") if once else files
    procs = S.procedure_uses(S.procedures(files, with_body=True))
    events = keep(S.events(procs), "events")
    return {
        "documents": files.select("doc_id").distinct(), "source_files": files, "modules": S.modules(files), "procedures": procs.drop("body"), "bodies": procs, "variables": S.variables(files), "events": events,
        "risk_markers": S.risk_markers(files), "dependencies": keep(S.dependencies(files), "dependencies"), "references": table("refs"), "activex_controls": table("ax"), "media": table("media"), "form_properties": table("props"),
        "controls": controls, "forms": controls.select("doc_id", "form").distinct(), "event_links": keep(C.event_links(events, controls), "event_links"), "preview": C.preview_layout(controls),
    }


def _registered(name: str, make, sql: str, *once: str) -> None:
    QUERIES[name], SQL[name] = lambda spark, sf_dir: make(model(spark, sf_dir, *once)), sql


_registered(
    "application_summary",
    R.application_summary,
    _report(
        _DOCS,
        "# Application Migration Summary",
        "",
        "## Inventory",
        _counts([("Source files", "SELECT doc_id FROM files"), ("Modules", "SELECT doc_id FROM files"), ("Project references", "SELECT doc_id FROM refs"), ("Forms", "SELECT doc_id FROM forms"), ("Controls", "SELECT doc_id FROM controls"), ("Document ActiveX controls", "SELECT doc_id FROM ax"), ("Procedures", "SELECT doc_id FROM p"), ("Dependencies", "SELECT doc_id FROM dep"), ("Assets", "SELECT doc_id FROM media")]),
        "",
        "## Forms",
        """SELECT doc_id, form || chr(1) AS k3, '### ' || form AS line FROM forms UNION ALL SELECT doc_id, form || chr(2), '- ' || name || ': ' || value FROM props
          UNION ALL SELECT doc_id, form || chr(3) || path, '  - ' || coalesce(name, caption, id) || ': ' || coalesce(type, 'unknown control') || ' (' || path || ')' FROM controls""",
        "",
        "## Document ActiveX Controls",
        "SELECT doc_id, ord AS k1, 0 AS k2, '- ' || id || ': ' || coalesce(label, class_id, 'unknown control') AS line FROM ax",
        "",
        "## VBA Project References",
        "SELECT doc_id, ord AS k1, 0 AS k2, '- ' || coalesce(name, kind) || ': ' || coalesce(lib_id, raw) AS line FROM refs",
        "",
        "## Modules",
        """SELECT doc_id, file_ord AS k1, -2 AS k2, '### ' || module AS line FROM mods
          UNION ALL SELECT m.doc_id, m.file_ord, -1, '- Kind: ' || kind || chr(10) || '- Procedures: ' || coalesce(n, 0) || coalesce(chr(10) || '- Uses: ' || uses, '') FROM mods m LEFT JOIN np USING (doc_id, file_ord) LEFT JOIN mu USING (doc_id, file_ord)
          UNION ALL SELECT doc_id, file_ord, proc_ord, '  - ' || name || ': ' || control_name || '.' || event_name || coalesce(' -> ' || path, '') FROM lk""",
        "",
        "## Dependencies",
        "SELECT doc_id, m AS k1, 0 AS k2, '- ' || category || ': ' || value || ' (' || file_name || ', ' || reason || ')' AS line FROM own",
        more=_MORE,
    ),
)

_WIDGET = "CASE type WHEN 'Forms.CommandButton.1' THEN 'button' WHEN 'Forms.TextBox.1' THEN 'text input' ELSE 'custom component' END"
_registered(
    "frontend_plan",
    R.frontend_plan,
    _report(
        _DOCS,
        "# Frontend Implementation Plan",
        "",
        "Forms become views, standard modules services, class modules domain classes; workbook state becomes explicit state.",
        "",
        "## State Model Candidates",
        "SELECT doc_id, n AS k1, 0 AS k2, '- ' || module || '.' || name || coalesce(': ' || type, '') AS line FROM vars WHERE n <= 80",
        "",
        "## UI Components",
        f"SELECT doc_id, form || chr(1) AS k3, '### ' || form || chr(10) || '- Component: `' || form || 'View`' AS line FROM forms UNION ALL SELECT doc_id, form || chr(2) || path, '  - ' || coalesce(name, caption, id) || ': ' || {_WIDGET} FROM controls",
        "",
        "## Services",
        "SELECT doc_id, file_ord AS k1, 0 AS k2, '- `' || module || 'Service`: ' || coalesce(n, 0) || ' procedure(s) of ' || file_name AS line FROM mods LEFT JOIN np USING (doc_id, file_ord) WHERE kind <> 'form'",
        "",
        "## Event Wiring",
        _both(_titled("lk"), "SELECT doc_id, file_ord AS k1, proc_ord AS k2, '- ' || coalesce(path, control_name) || ' ' || event_name || ' -> `' || name || '`' AS line FROM lk"),
        "",
        "## Integration Adapters",
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) AS k1, 0 AS k2, '- ' || category AS line FROM dep GROUP BY doc_id, category",
        more=_MORE,
    ),
    "event_links",
)

_registered(
    "rebuild_brief",
    R.rebuild_brief,
    _report(
        _DOCS,
        "# Rebuild Brief",
        "",
        "## Read Order",
        "1. `application-summary.md`",
        "2. `application-model.json`",
        "3. sources under `code/`",
        "4. `designer-summary/*.designer.json`",
        "5. `resources/` and `media/` where looks are unclear",
        "",
        "## Inventory",
        _counts([("Forms", "SELECT doc_id FROM forms"), ("Controls", "SELECT doc_id FROM controls"), ("Modules", "SELECT doc_id FROM mods"), ("Procedures", "SELECT doc_id FROM p"), ("Event handlers", "SELECT doc_id FROM lk"), ("Linked event handlers", "SELECT doc_id FROM lk WHERE path IS NOT NULL"), ("Detected dependencies", "SELECT doc_id FROM dep"), ("VBA project references", "SELECT doc_id FROM refs"), ("Recovered assets", "SELECT doc_id FROM media")]),
        "",
        "## Event Handler Map",
        _both(_titled("lk"), "SELECT doc_id, file_ord AS k1, proc_ord AS k2, '- ' || name || ': ' || control_name || '.' || event_name || coalesce(' -> ' || path, ' -> unlinked') AS line FROM lk"),
        "",
        "## Dependency Warnings",
        "SELECT doc_id, m AS k1, 0 AS k2, '- ' || category || ': ' || value || ' from ' || file_name || ': ' || reason AS line FROM own",
        more=_MORE,
    ),
    "events", "event_links", "dependencies",
)

_registered(
    "references_report",
    lambda m: R.references_report(m["references"]),
    f"""WITH refs AS ({_TABLES["refs"].format(supplier="supplier")}), k AS (
  SELECT doc_id, min(ord) AS place, '## ' || upper(kind[1]) || kind[2:] || ' References' || chr(10) || string_agg('- ' || coalesce(name, guid, lib_id) || CASE WHEN guid = '{{00020430-0000-0000-C000-000000000046}}' THEN ' [OLE Automation / stdole]' ELSE '' END || coalesce(', version ' || version, '') || coalesce(', ' || path, ''), chr(10) ORDER BY ord) AS text FROM refs GROUP BY doc_id, kind
) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text FROM k GROUP BY doc_id""",
)

#: Controls of the rendered forms as they are drawn; of kinds there are buttons, text boxes and unknown ones.
_DRAWN = f"""WITH {rendered.CONTROLS_SQL}, e AS (SELECT doc_id, form, max("left" + width) AS r, max(top + height) AS b FROM controls WHERE "left" IS NOT NULL GROUP BY doc_id, form), s AS (SELECT *, least(1.0::DOUBLE, 900.0::DOUBLE / greatest(r, 1), 560.0::DOUBLE / greatest(b, 1)) AS s FROM e),
c AS (SELECT doc_id, form, control_ord, path, CASE type WHEN 'Forms.CommandButton.1' THEN 'button' WHEN 'Forms.TextBox.1' THEN 'textbox' ELSE 'unknown' END AS kind, coalesce(caption, name) AS label, floor("left" * s + 8 + 0.5)::BIGINT AS x, floor(top * s + 8 + 0.5)::BIGINT AS y, floor(greatest(36.0::DOUBLE, width * s) + 0.5)::BIGINT AS w, floor(greatest(24.0::DOUBLE, height * s) + 0.5)::BIGINT AS h,
  ceil(greatest(360.0::DOUBLE, r * s + 24))::BIGINT AS fw, ceil(greatest(220.0::DOUBLE, b * s + 24))::BIGINT AS fh FROM controls JOIN s USING (doc_id, form) WHERE "left" IS NOT NULL),
d AS (SELECT *, CASE kind WHEN 'button' THEN ['#eef3f4', '#8a9ca1', '#172026', '4'] WHEN 'textbox' THEN ['#ffffff', '#8a9ca1', '#172026', '2'] ELSE ['rgba(217,235,232,0.88)', '#1e6b66', '#173532', '4'] END AS st FROM c)"""
_registered(
    "preview_svg",
    lambda m: R.preview_svg(m["preview"]),
    f"""{_DRAWN}, g AS (SELECT *, '<g data-path="' || path || '" data-kind="' || kind || '"><rect x="' || x || '" y="' || y || '" width="' || w || '" height="' || h || '" rx="' || st[4] || '" fill="' || st[1] || '" stroke="' || st[2] || '"/><text x="' || (x + 8) || '" y="' || (y + greatest(15.0::DOUBLE, least(h - 6.0::DOUBLE, h / 2::DOUBLE + 4))) || '" font-size="11" fill="' || st[3] || '">' ||
      CASE WHEN length(label) > greatest(6, w // 7) THEN label[1:greatest(6, w // 7) - 3] || '...' ELSE label END || '</text></g>' AS line FROM d)
    SELECT doc_id, form, '<svg xmlns="http://www.w3.org/2000/svg" width="' || max(fw) || '" height="' || max(fh) || '" viewBox="0 0 ' || max(fw) || ' ' || max(fh) || '" role="img" aria-label="' || form || ' visual preview">' || chr(10) || '<rect width="100%" height="100%" fill="#ffffff"/>' || chr(10) || '<text x="10" y="18" font-size="11" fill="#607178">' || form || '</text>' || chr(10) || string_agg(line, chr(10) ORDER BY control_ord, path, line) || chr(10) || '</svg>' || chr(10) AS text FROM g GROUP BY doc_id, form""",
)
_registered(
    "preview_html",
    lambda m: R.preview_html(m["preview"]),
    f"""{_DRAWN}, g AS (SELECT *, '<div class="control ' || kind || '" title="' || path || '" style="position:absolute;left:' || x || 'px;top:' || y || 'px;width:' || w || 'px;height:' || h || 'px;border:1px solid ' || st[2] || ';background:' || st[1] || ';color:' || st[3] || '">' || label || '</div>' AS line FROM d)
    SELECT doc_id, form, '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>' || form || ' visual preview</title></head>' || chr(10) || '<body><h1>' || form || '</h1>' || chr(10) || '<div class="preview" style="position:relative;width:' || max(fw) || 'px;height:' || max(fh) || 'px">' || chr(10) || string_agg(line, chr(10) ORDER BY control_ord, path, line) || chr(10) || '</div></body></html>' || chr(10) AS text FROM g GROUP BY doc_id, form""",
)
