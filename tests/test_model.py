"""One model of a folder: designer streams, controls, references, pictures, embedded controls, reports and the export."""

import json
import struct
import zipfile

import pytest
from test_containers import compound, project

from docustrata.operators import activex, forms, labels, pictures
from docustrata.plans import artifacts, documents
from docustrata.sources import containers

GIF = b"GIF89a" + bytes(7) + b",,,;"
WRAPPED = b"lt\0\0" + struct.pack("<I", len(GIF)) + GIF
DIB = struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(24)
CLASS = bytes(12) + bytes.fromhex("403205d769cecd11a77700dd01143c57") + b"\0\0Microsoft Forms 2.0 CommandButton\0Embedded Object\0Forms.CommandButton.1\0"


def record(minor_major, mask, payload):
    return minor_major + struct.pack("<HI", 4 + len(payload), mask) + payload


def form_stream(caption=b"Sheet Tool"):
    return record(b"\0\4", 1 << 10 | 1 << 19, struct.pack("<II", 4000, 3000) + caption)


def site_stream():
    return record(b"\0\2", 1 << 0 | 1 << 2, struct.pack("<II", 1200, 900) + b"cmdGo\0\0\0")


def found(data):
    return [(at, ext, n, len(b), place) for at, ext, _, n, b, place in pictures.find_media(data)]


def test_pictures_in_their_formats():
    emf = struct.pack("<I", 1) + bytes(36) + b" EMF" + bytes(4) + struct.pack("<I", 100) + bytes(48)
    icon = struct.pack("<HHH", 0, 1, 1) + bytes(8) + struct.pack("<II", 10, 22) + b"i" * 10
    cursor = struct.pack("<HHH", 0, 2, 1) + bytes(8) + struct.pack("<II", 0, 22)
    assert found(b"AA" + GIF) == [(2, "gif", 17, 17, "GIF image at 0x0002")]
    assert found(b"\x89PNG\r\n\x1a\nIENDxIEND\xae\x42\x60\x82") == [(0, "png", 21, 21, "PNG image at 0x0000")]
    assert found(b"\xff\xd8\x00\xff\xd9") == [(0, "jpg", 5, 5, "JPEG image at 0x0000")]
    assert found(b"BM" + struct.pack("<I", 15) + bytes(9)) == [(0, "bmp", 15, 15, "BMP image at 0x0000")] and not found(b"BM" + struct.pack("<I", 14) + bytes(9))
    assert [x[1:3] for x in found(icon)] == [("ico", 32)] and [x[1:3] for x in found(cursor)] == [("cur", 22)]
    assert [m[2] for m in pictures.find_media(cursor)] == ["image/x-icon"]
    assert found(emf) == [(0, "emf", 100, 100, "EMF image at 0x0000")] and not found(emf[:48] + struct.pack("<I", 88) + bytes(48))
    assert [x[:3] for x in found(b"II*\0" + b"t" * 40 + GIF)] == [(0, "tif", 44), (44, "gif", 17)]
    assert found(b"") == [] and found(b"\x89PNG\r\n\x1a\n") == []


def test_tiff_ends_where_a_picture_begins():
    assert [x[:3] for x in found(b"MM\0*" + b"t" * 40 + b"\xff\xd8ab\xff\xd9")] == [(0, "tif", 44), (44, "jpg", 6)]
    assert found(b"MM\0*" + b"t" * 20) == []
    assert [x[:3] for x in found(b"\xd7\xcd\xc6\x9a" + bytes(30))] == [(0, "wmf", 34)]


def test_wrapped_pictures_and_bitmaps():
    rest = b"zz" + DIB + b"lt\0\0\5\0\0\0hello"
    got = pictures.find_media(b"AAAA" + WRAPPED + bytes.fromhex("0452E30B918FCE119DE300AA004BB851") + WRAPPED + rest)
    assert [(m[0], m[1], m[3], len(m[4])) for m in got] == [(4, "gif", 25, 17), (29, "gif", 41, 17), (72, "bmp", 64, 78), (136, "picture.bin", 13, 5)]
    assert got[0][4] == GIF and got[2][4][:2] == b"BM" and struct.unpack_from("<IIII", got[2][4], 2)[:3] == (78, 0, 54) and got[3][4] == b"hello"
    wmf = struct.pack("<HHHI", 1, 9, 0x300, 10) + bytes(10)
    assert pictures.find_media(b"lt\0\0" + struct.pack("<I", len(wmf)) + wmf)[0][5] == "MS-OFORMS StdPicture WMF image at 0x0000"
    assert found(b"lt\0\0\x00\0\0\0" + bytes(9)) == [] and found(b"lt\0\0\xff\0\0\0abc") == []
    marks = pictures.find_signatures(WRAPPED + b"q" + DIB + containers.OLE_MARK)
    assert marks == [(0, "MS-OFORMS StdPicture", "17 B picture payload"), (8, "GIF image", "17 B"), (26, "DIB image rebuilt as BMP", "78 B extracted/rebuilt"), (90, "Nested OLE compound file", "D0 CF 11 E0 A1 B1 1A E1")]


def test_pictures_in_nested_compound_files():
    inner = compound({"a/b": b"x" * 5000 + GIF})
    places = [m[5] for m in pictures.find_media(b"pad!" + inner)]
    assert "Nested OLE at 0x0004 / a/b / GIF image at 0x1388" in places
    assert pictures.find_media(containers.OLE_MARK + b"no compound file") == []


def test_form_records():
    kind, sure, ((at, name, size, values),) = forms.stream_records("Form/f", form_stream())
    assert (kind, sure, at, name, size) == ("Form stream", "high", 0, "FormControl", 26)
    assert dict(values)["Decoded DisplayedSize"] == "4000 x 3000 twips @ 0x0008 (medium)" and dict(values)["Decoded Caption"] == "Sheet Tool (medium)"
    assert dict(values)["PropMask"] == "0x00080400 (DisplayedSize, Caption)" and dict(values)["ExtraDataBlock candidate"] == "0x0010-0x001A"
    kind, sure, records = forms.stream_records("Form/i01/o", site_stream() + site_stream())
    assert (kind, sure, [r[:3] for r in records]) == ("Object stream", "medium", [(0, "OleSiteConcrete control", 24), (24, "Nested OleSite/control record", 24)])
    assert dict(records[0][3])["Decoded SitePosition"] == "1200, 900 twips @ 0x0008 (medium)" and dict(records[0][3])["Decoded Name"] == "cmdGo (low)"
    assert forms.stream_records("Form/x", bytes(17))[2][1][:3] == (8, "PageProperties / extended data candidate", 8)
    assert forms.stream_records("Form/\x01CompObj", CLASS)[1] == "high" and forms.stream_records("Form/\x03VBFrame", b"Begin x")[0] == "VBFrame metadata"
    assert forms.stream_records("Form/f", b"\1\4" + bytes(20)) is None and forms.stream_records("Form/other", CLASS) is None and forms.stream_records("Form/o", b"") is None
    assert len(forms.stream_records("o", site_stream() * 50)[2]) == forms.RECORDS


def test_sizes_and_positions():
    pack = lambda *n: struct.pack(f"<{len(n)}I", *n)
    assert forms.form_sizes(pack(200, 300, 5, 26000, 200), 0, 20) == [(0, 200, 300, "medium"), (12, 26000, 200, "low")]
    assert [c[1:3] for c in forms.form_sizes(pack(26000, 200, 27000), 0, 12)] == [(200, 27000), (26000, 200)]
    assert forms.site_position(pack(0, 0, 1, 2), 0, 16)[:3] == (4, 0, 1) and forms.site_position(pack(20000, 16000, 90000), 0, 12) == (0, 20000, 16000, "low")
    assert forms.site_position(b"", 0, 0) is None


@pytest.mark.parametrize("text", ["Go", "Forms.Label.1", "{D7053240-CE69-11CD-A777-00DD01143C57}", "x{d7053240-ce69-11cd-a777-00dd01143c57}y", "Tahoma", "0x12", "a b (low)", "-----", "it's", "é", "a\nb", ""])
def test_labels_in_tasks_are_those_of_columns(spark, text):
    from pyspark.sql import functions as F

    from docustrata.functions.text import is_human_label

    assert spark.range(1).select(is_human_label(F.lit(text))).first()[0] == labels.is_human(text)


def test_persistence_of_embedded_controls():
    got = activex.persistence(compound({"\x01CompObj": CLASS, "contents": record(b"\0\2", 1 << 3 | 1 << 5, b"\x0f\0\0\x80Press me\0\0\0\0Arial\0\0\0")}))
    assert got["format"] == "cfb-storage" and got["class"]["prog_id"] == "Forms.CommandButton.1" and got["class"]["clsid"] == "{D7053240-CE69-11CD-A777-00DD01143C57}"
    values = {p[0]: p[1] for p in got["properties"]}
    assert values["PersistedPropMask"] == "0x00000028 (Caption, Font)" and values["Caption"] == "Press me" and values["FontName"] == "Arial" and values["SystemColor"] == "0x8000000F (button face)"
    assert activex.persistence(b"")["format"] == "empty" and activex.persistence(b"abcdefgh")["format"] == "raw-stream" and activex.persistence(containers.OLE_MARK + b"x")["format"] == "unknown" and activex.persistence(None) is None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    streams = dict(containers.CompoundFile(project()).streams())
    streams |= {"Form/f": form_stream(), "Form/o": b"zzzz" + WRAPPED, "Form/i01/o": site_stream(), "Form/i01/\x01CompObj": CLASS, "Form/i01/i02/f": form_stream(b"Inner One"), "Form/\x03VBFrame": b'Begin {X} Form\r\n  Caption = "Hi"\r\nEnd'}
    with zipfile.ZipFile(top / "book.xlsm", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/vbaProject.bin", compound(streams))
        z.writestr("xl/media/image1.png", b"png")
        z.writestr("xl/activeX/activeX1.xml", '<ax:ocx ax:classid="{D7053240-CE69-11CD-A777-00DD01143C57}" r:id="rId1"/>')
        z.writestr("xl/activeX/activeX1.bin", compound({"\x01CompObj": CLASS, "contents": form_stream()}))
    (top / "a.frx").write_bytes(b"xx" + GIF)
    (top / "Tool.frm").write_bytes(b"Private Sub cmdGo_Click()\r\nHelper\r\nEnd Sub\r\nSub Helper()\r\n' TODO: x\r\nEnd Sub\0\0")
    return top


@pytest.fixture(scope="module")
def model(spark, folder, tmp_path_factory):
    return documents.model(spark, str(folder), str(tmp_path_factory.mktemp("scratch")))


def test_model_of_forms(model):
    controls = {r.path: r for r in model["controls"].collect()}
    assert set(controls) == {"Form/i01", "Form/i01/i02", "Tool/inferred/cmdGo"}
    outer = controls["Form/i01"]
    assert (outer.type, outer.prog_id, outer.parent_path, outer.name) == ("Microsoft Forms 2.0 CommandButton control", "Forms.CommandButton.1", None, "cmdGo")
    assert outer.properties["Decoded SitePosition"] == "1200, 900 twips @ 0x0008 (medium)" and len(outer.streams) == 2
    assert controls["Form/i01/i02"].parent_path == "Form/i01" and controls["Form/i01/i02"].caption == "Inner One"
    assert controls["Tool/inferred/cmdGo"].properties["InferredFromEvent"] == "cmdGo_Click"
    link = {r.procedure: r.linked_control_path for r in model["event_links"].collect()}
    assert link["cmdGo_Click"] == "Tool/inferred/cmdGo"
    assert {(r.form, r.name): r.value for r in model["form_properties"].collect()}["Form", "Caption"] == "Hi"
    assert {r.form for r in model["forms"].collect()} == {"Form", "Tool"}


def test_model_of_files(model):
    media = {r.name: r for r in model["media"].collect()}
    assert bytes(media["a-01.gif"].content) == GIF and "Form-Form-o-01.gif" in media and media["xl-media-image1.png"].size == 3
    files = {r.name: r for r in model["files"].collect()}
    assert files["xl-media-image1.png"].zip_path.startswith("Office_media_parts/media/") and files["a.frx"].source_path == "a.frx" and files["a-01.gif"].source_path.startswith("a.frx / ")
    assert json.loads(bytes(files["vba-project-references.json"].content))[0]["source"] == "PROJECT"
    assert {p["path"] for p in json.loads(bytes(files["office-package-manifest.json"].content))} == {"xl/media/image1.png", "xl/activeX/activeX1.xml", "xl/activeX/activeX1.bin"}
    assert not files["Tool.frm"].content.endswith(b"\0")
    own = model["activex_controls"].first()
    assert own.label == "Microsoft Forms 2.0 CommandButton" and own.persistence_analysis.format == "cfb-storage" and own.properties["bin.UserType"] == "Microsoft Forms 2.0 CommandButton" and own.source_files == [own.xml_path, own.bin_path]
    assert "VBA reference" in {r.category for r in model["dependencies"].collect()}
    assert {dict(r.summary)["Media candidates"] for r in model["profiles"].collect()} == {"0", "1"}


def test_export_and_reports(spark, model, tmp_path):
    rows = containers.write_zips(artifacts.export_entries(model), str(tmp_path / "out")).collect()
    assert len(rows) == 3
    held: dict[str, str] = {}
    for r in rows:
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and len(z.namelist()) == r.entries == len(set(z.namelist()))
            for n in z.namelist():
                held[n] = held.get(n, "") + z.read(n).decode("utf-8", "replace")
                if n.endswith(".json") and "frx" not in n:
                    json.loads(z.read(n))
    chunk = held["procedure-chunks/Tool/001-cmdGo_Click.vba"]
    assert "' Calls: Helper\n" in chunk and "Helper\nEnd Sub" in chunk
    graph = held["call-graph.md"]
    assert "Edges: 1" in graph and 'n_Tool_cmdGo_Click["Tool.cmdGo_Click"] --> n_Tool_Helper["Tool.Helper"]' in graph and '  n_Tool_Helper["Tool.Helper"]\n' in graph
    assert "cmdGo_Click (calls Helper)" in held["migration-test-plan.md"]  # a procedure that only calls
    assert "- Line 5: TODO - Developer note" in held["dependency-report.md"]
    assert "Tool/inferred/cmdGo: Inferred command button from cmdGo_Click" in held["validation-report.md"]
    assert "OLE Automation" in held["vba-project-references.md"] and "`ToolView`" in held["frontend-implementation-plan.md"] and "## Event Handler Map" in held["llm-rebuild-brief.md"]
    assert "### Tool" in held["application-summary.md"] and "Decoded Caption" in held["Form/designer-summary/Form.designer.json"]


def test_previews(spark):
    from docustrata.operators import controls, reports

    rows = spark.createDataFrame([("d", "F<1>", 0, "i1", "F/i1", None, 'Say "hi"', "Forms.CheckBox.1", None, 100, 100, 2000, 500), ("d", "F<1>", 1, "i2", "F/i2", "pic", None, "Image", None, 100, 900, 2000, 500)], "doc_id string, form string, control_ord int, id string, path string, name string, caption string, type string, prog_id string, left long, top long, width long, height long")
    layout = controls.preview_layout(rows)
    svg, html = reports.preview_svg(layout).first().text, reports.preview_html(layout).first().text
    assert svg.startswith("<svg") and "F&lt;1&gt; visual preview" in svg and 'data-kind="checkbox"' in svg and "Say &quot;hi&quot;" in svg and "<path" in svg
    assert 'class="control checkbox"' in html and html.count("position:absolute") == 2


def test_last_resort_sources(spark):
    from test_containers import ovba

    from docustrata.sources import macros

    data = [("d", "c", 0, "odd/stream", bytearray(b"xx" + ovba(b'Attribute VB_Name = "T"\r\nSub A()\r\nEnd Sub')))]
    rows = spark.createDataFrame(data, "doc_id string, container string, ord int, path string, content binary")
    assert macros.module_sources(rows).count() == 0  # a form stream is a file, so nothing is searched for
    rows = spark.createDataFrame([("d", "c", 0, "vba/odd", data[0][4])], rows.schema)
    assert [(r.name, r.text.split("\r\n")[1]) for r in macros.module_sources(rows).collect()] == [("odd.bas", "Sub A()")]
