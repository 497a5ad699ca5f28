import zlib

from pyspark.sql import functions as F

from docustrata.functions import binary as B
from docustrata.functions import text as T
from docustrata.operators import binary, controls, profiles, reports
from docustrata.operators import source_code as S

FILES = "doc_id long, file_ord int, name string, kind string, source_path string, text string"
TEXT = """Option Explicit
Public Declare PtrSafe Function Tick Lib "k" () As Long
Dim a, b As Long
Public Const Max As Long = 3
Dim WithEvents app As Object
Private Sub cmd_ok_Click(ByVal x As Long, y)
  Call Helper(1)
  Range("A1").Value = 2
End Sub
sub Helper(n)
Function Open_(z) As String
end function
Property Get Size() As Long
"""


def files(spark, text=TEXT, name="Sheet1.bas"):
    return spark.createDataFrame([(1, 0, name, "vba", "p", text)], FILES)


def test_procedures(spark):
    got = S.procedures(files(spark)).orderBy("proc_ord").collect()
    assert [(r.name, r.kind, r.scope, r.line_start, r.line_end, r.return_type) for r in got] == [
        ("cmd_ok_Click", "Sub", "Private", 6, 9, None),
        ("Helper", "sub", "Implicit", 10, None, None),  # open at the next start; its casing stays
        ("Open_", "Function", "Implicit", 11, 12, "String"),
        ("Size", "Property", "Implicit", 13, None, "Long"),
    ]
    assert got[0].parameters == ["ByVal x As Long", "y"]


def test_declarations(spark):
    v = {(r.name, r.type) for r in S.variables(files(spark)).collect()}
    assert v == {("a", None), ("Const", None), ("WithEvents", None)}  # the first name only
    assert [(r.name, r.scope, r.type) for r in S.constants(files(spark)).collect()] == [("Max", "Public", "Long")]
    assert [r.line for r in S.declares(files(spark)).collect()] == [2]
    assert [(r.control_name, r.event_name) for r in S.events(S.procedures(files(spark))).collect()] == [("cmd_ok", "Click")]
    assert S.modules(files(spark)).first().kind == "document"


def test_word_edges_are_ascii(spark):
    rows = S.risk_markers(files(spark, "éShell\nx Shell y\nShells\nKill \"x\"\nKill f")).collect()
    assert [(r.line, r.category) for r in sorted(rows, key=lambda r: r.line)] == [(1, "External process"), (2, "External process"), (5, "File system")]


def test_uses_dependencies_calls(spark):
    procs = S.procedures(files(spark), with_body=True)
    assert S.procedure_uses(procs).where("name = 'cmd_ok_Click'").first().uses == ["Excel object model"]  # "." after ")" is no word edge
    found = {(r.category, r.value) for r in S.dependencies(files(spark)).collect()}
    assert ("WinAPI", "PtrSafe") in found and ("Office automation", "Range(") not in found
    assert {(r.name, r.callee) for r in S.calls(procs).collect()} >= {("cmd_ok_Click", "Helper")}


def test_null_and_empty_sources(spark):
    empty = spark.createDataFrame([(1, 0, "a.bas", "vba", "p", None), (1, 1, "b.bas", "vba", "p", "")], FILES)
    assert S.procedures(empty).count() == 0 and S.risk_markers(empty).count() == 0 and S.dependencies(empty).count() == 0
    assert S.source_lines(empty).count() == 2


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.safe_file_name(F.lit("__a/b c__"))) == "a_b_c" and pick(T.safe_file_name(F.lit("//"))) == "stream"
    assert pick(T.js_trim(F.lit(" \t x﻿"))) == "x"
    assert pick(T.title_case(F.lit("fooBAR baz-qux"))) == "FooBAR Baz-Qux"
    assert pick(T.to_hex(F.lit(0x12345))) == "0x12345" and pick(T.to_hex(F.lit(10))) == "0x000A"
    assert pick(T.parse_number(F.lit(" -1.5e2px"))) == -150.0 and pick(T.parse_number(F.lit("x"))) is None
    assert pick(T.normalize_guid(F.lit("no"))) is None
    cp = bytes(range(256))
    want = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in cp)
    assert pick(B.decode_cp1252(F.lit(bytearray(cp)))) == want
    assert pick(B.read_u16(F.lit(bytearray(b"\x80\xff")), 0)) == 0xFF80 and pick(B.read_u32(F.lit(bytearray(b"\x01")), 0)) == 1
    assert pick(F.crc32(F.lit(bytearray(b"abc")))) == zlib.crc32(b"abc")


def test_binary_scans(spark):
    guid = bytes.fromhex("403205d769cecd11a77700dd01143c57")
    png = b"\x89PNG\r\n\x1a\n....IEND\xaeB`\x82"
    data = b"abc\0text!\0\0\0" + "wide".encode("utf-16-le") + b"\0\0" + guid + png + b"GIF89a" + b"x" * 10 + b";"
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "k int, content binary")
    assert {(r.encoding, r.value) for r in binary.strings(rows, "k", "content").collect()} >= {("ASCII", "text!"), ("UTF-16LE", "wide")}
    assert "{D7053240-CE69-11CD-A777-00DD01143C57}" in {r.guid for r in binary.guids(rows, "k", "content").collect()}
    assert {(r.extension, bytes(r.bytes)[:3]) for r in binary.media(rows, "k", "content").collect()} == {("png", b"\x89PN"), ("gif", b"GIF")}
    assert {r.k: round(r.entropy, 6) for r in binary.entropy(rows, "k", "content").collect()}[2] == 0.0
    form = b"\0\x04\x08\0\x02\0\x08\0zzzz"
    streams = spark.createDataFrame([(1, "F/f", bytearray(form)), (2, "F/i1/\x01CompObj", bytearray(data)), (3, None, None), (4, "o", bytearray(b"\x6c\x74\0\0\x04\0\0\0zzzz" * 30))], "k int, path string, content binary")
    got = {r.k: r for r in profiles.stream_profiles(streams, ["k"]).collect()}
    assert got[1].title == "Form/control properties stream" and got[1].kind == "Form stream" and len(got[1].notes) == 1 and dict(got[1].summary)["Zero bytes"] == "4 (33.3%)"
    assert got[2].title == "COM compound object metadata" and dict(got[2].summary)["Storage"] == "F/i1" and dict(got[2].summary)["Stream"] == "0x01 CompObj" and dict(got[2].summary)["Media candidates"] == "2"
    assert [(g.guid, g.label) for g in got[2].guids if g.label] == [("{D7053240-CE69-11CD-A777-00DD01143C57}", "Microsoft Forms 2.0 CommandButton")]
    assert got[3].size == 0 and dict(got[3].summary)["Storage"] == "(root)" and dict(got[3].summary)["MS-OFORMS"] == "No structured match" and got[3].title == "Binary form resource stream"
    assert got[4].n_signatures == 30 and len(got[4].signatures) == 24 and got[4].signatures[1].offset == 12


def test_groups_and_paths(spark):
    rows = spark.createDataFrame([(1, "m.png", "media", "b.xlsm/xl/media/m.png"), (1, "A.frm", "frm", "b.xlsm/xl/vbaProject.bin/VBA/A"), (1, "o.frx", "frx", "b.xlsm/xl/vbaProject.bin/Form1/o"), (1, "p", "frx", "x/vbaProject.bin/PROJECTwm")], "doc_id long, name string, kind string, source_path string")
    got = {r.owner: r for r in controls.result_groups(rows).collect()}
    assert set(got) == {"Office media parts", "A", "Form1", "Project metadata"}
    assert got["A"].has_form and got["Office media parts"].place == 4
    path = controls.zip_path(F.lit("O x"), F.lit("media"), F.lit("p"), F.lit("n.png"), F.lit(1234))
    assert spark.range(1).select(path).first()[0] == "O_x/media/1234-n.png"


def test_ordered_report(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "doc_id long, ord int, line string")
    assert {r.doc_id: r.text for r in reports.joined(rows, ["doc_id"], ["ord"], F.col("line")).collect()} == {1: "a\nb", 2: "c"}


def test_streaming(spark, tmp_path):
    from docustrata.streaming.sources import arriving_risks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bas").write_bytes(b"Sub A()\nShell \"x\"\nEnd Sub")
    q = arriving_risks(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("risks").start()
    q.processAllAvailable()
    q.stop()
    assert [r.category for r in spark.sql("SELECT * FROM risks").collect()] == ["External process"]


def test_embedded_controls(spark):
    from docustrata.operators import embedded

    xml = '<ax:ocx ax:classid="{D7053240-CE69-11CD-A777-00DD01143C57}" r:id="rId1" ax:persistence="persistStorage"><ax:p>x</ax:p></ax:ocx>'
    parts = spark.createDataFrame([("d", 0, "xl/activeX/activeX1.xml", bytearray(xml.encode())), ("d", 1, "xl/activeX/activeX1.bin", bytearray(b"1")), ("d", 2, "xl/activeX/activeX11.bin", bytearray(b"2")), ("d", 3, "xl/activeX/activeX2.xml", bytearray(b"<a/>"))], "doc_id string, ord int, path string, content binary")
    got = {r.id: r for r in embedded.activex_controls(parts).collect()}
    assert got["activeX1"].bin_path == "xl/activeX/activeX1.bin" and got["activeX1"].label == "Microsoft Forms 2.0 CommandButton"
    assert got["activeX1"].properties["relationshipId"] == "rId1" and got["activeX1"].properties["p"] == "x"
    assert got["activeX2"].bin_path is None and got["activeX2"].class_id is None


def test_streams_as_integers(spark):
    import struct

    from docustrata.operators import activex, embedded

    assert [(c[0], c[2]) for c in activex.colours(struct.pack("<IIII", 0x8000000F, 0, 0x00FF00, 0x7F000000))] == [(0, "0x8000000F (button face)"), (8, "0x0000FF00 (#00ff00)")] and activex.colours(b"ab") == []
    data = struct.pack("<8I", 0xFFFFFFFF, 0xFFFFFFFF, 100, 200, 4000, 3000, 0xFFFFFFFF, 0)
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"x"))], "k int, content binary")
    assert [tuple(r) for r in embedded.inferred_bounds(rows, "k", "content").collect()] == [(1, 100, 200, 4000, 3000, "medium")]
    assert spark.range(1).select(embedded.hex_dump(F.lit(bytearray(b"Az\x00" + b"b" * 14)))).first()[0].split("\n") == ["0x00000000  41 7a 00 62 62 62 62 62 62 62 62 62 62 62 62 62  Az.bbbbbbbbbbbbb", "0x00000010  62" + " " * 45 + "  b"]
    frame = spark.createDataFrame([("d", "c", "Form1/\x03VBFrame", bytearray(b'Begin {X} Form1\r\n  Caption = "Hi"\r\n  Caption = "Ho"\r\nEnd'))], "doc_id string, container string, path string, content binary")
    assert {r.name: r.value for r in embedded.frame_properties(frame).collect()} == {"Name": "Form1", "Caption": "Ho"}


def test_more_reports(spark):
    f = files(spark)
    procs = S.procedures(f, with_body=True)
    events = S.events(procs)
    text = reports.migration_checklist(S.dependencies(f), S.risk_markers(f), events, f.select("doc_id").limit(0), f.select("doc_id").limit(0), events, procs, S.variables(f)).first().text
    assert "\n- [ ] Replace or implement WinAPI: PtrSafe" in text and "cmd_ok.Click" in text and text.startswith("# Migration Checklist\n") and "- [ ] Forms: 0" in text
    plan = reports.migration_test_plan(events, S.procedure_uses(procs), S.call_edges(procs), S.dependencies(f)).first().text
    assert "\n- [ ] Trigger cmd_ok.Click" in plan and "- [ ] Validate the replacement of WinAPI: PtrSafe" in plan


def test_word_edges_of_rules():
    """A rule's expression finds what its plain form with ASCII edges does, and looks at a word's first letter before its edge."""
    import random
    import re

    from docustrata.functions.patterns import SPACE, _first_letters, spark
    from docustrata.operators import rules

    patterns = [r[1] for r in (*rules.DEPENDENCIES, *rules.RISKS, *rules.USES)] + [r"\bab?c\b", r"\b(a|)b", r"\b(a|b)?c", r"\b(a|b*)c"]
    words = [w for p in patterns for w in re.findall(r"[A-Za-z]+", p)]
    draw = random.Random(1)
    texts = ["".join(draw.choice([*words, " ", " ", "\n", "_", "é", "(", '"', ".", "1"]) + draw.choice(["", " ", "(", '"']) for _ in range(draw.randrange(1, 60))).swapcase() for _ in range(300)]
    for p in patterns:
        plain, fast = (re.compile(x, re.A | re.I) for x in (p.replace(r"\s", SPACE), spark(p)))
        assert [m.span() for t in texts for m in plain.finditer(t)] == [m.span() for t in texts for m in fast.finditer(t)], p
    assert [_first_letters(p) for p in ("(Ab|cd(e|f)|g?h)", "(a|)b", "(a|b)?c", "ab?c", "a?b", "(a|b(c|d))e", "a|b", "a(x|y)", "", "(?:a|b)")] == ["", "", "", "Aa", "", "ABab", "", "Aa", "", ""]
    assert all(spark(p).startswith("(?i)(?-i:(?=[") for _, p, *_ in rules.DEPENDENCIES)
