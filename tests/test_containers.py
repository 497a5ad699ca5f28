import io
import struct
import zipfile

import pyarrow as pa
import pytest

from docustrata.plans import documents
from docustrata.sources import containers, macros


def ovba(text: bytes) -> bytes:
    """A container of literal tokens only."""
    out = b"\x01"
    for at in range(0, len(text), 3640):
        part = text[at : at + 3640]
        body = b"".join(b"\x00" + part[i : i + 8] for i in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(body) + 2 - 3)) + body
    return out


def record(kind: int, payload: bytes) -> bytes:
    return struct.pack("<HI", kind, len(payload)) + payload


def dir_stream(modules, references=b"") -> bytes:
    out = references + record(0x0F, struct.pack("<H", len(modules))) + record(0x13, b"\0\0")
    for name, offset, kind in modules:
        b = name.encode()
        for k, p in ((0x19, b), (0x47, name.encode("utf-16-le")), (0x1A, b), (0x32, name.encode("utf-16-le")), (0x1C, b""), (0x48, b""), (0x31, struct.pack("<I", offset)), (0x1E, b"\0" * 4), (0x2C, b"\0\0"), (kind, b""), (0x2B, b"")):
            out += record(k, p)
    return ovba(out)


def compound(streams: dict[str, bytes]) -> bytes:
    """A version 3 compound file; streams under 4096 bytes go to the mini stream."""
    entries = [["Root Entry", 5, -1, b""]]
    folders: dict[str, int] = {"": 0}
    children: dict[int, list[int]] = {0: []}
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        if folder not in folders:
            folders[folder] = len(entries)
            children[0].append(len(entries))
            children[len(entries)] = []
            entries.append([folder, 1, -1, b""])
        children[folders[folder]].append(len(entries))
        entries.append([name, 2, -1, data])
    mini, mini_fat, sectors, fat = b"", [], [], []

    def chain(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        for i, p in enumerate(parts):
            sectors.append(p)
            fat.append(first + i + 1 if i + 1 < len(parts) else 0xFFFFFFFE)
        return first if parts else 0xFFFFFFFE

    starts = {}
    for i, (_, kind, _, data) in enumerate(entries):
        if kind != 2 or not data:
            continue
        if len(data) >= 4096:
            starts[i] = chain(data)
        else:
            first = len(mini_fat)
            n = -(-len(data) // 64)
            mini += data.ljust(n * 64, b"\0")
            mini_fat += [first + j + 1 for j in range(n - 1)] + [0xFFFFFFFE]
            starts[i] = first
    starts[0] = chain(mini)
    small = chain(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-4 * len(mini_fat) // 512) * 512, b"\xff")) if mini_fat else 0xFFFFFFFE
    rights, child = {}, {}
    for folder, own in children.items():
        child[folder] = own[0] if own else 0xFFFFFFFF
        for a, b in zip(own, own[1:]):
            rights[a] = b
    table = b""
    for i, (name, kind, _, data) in enumerate(entries):
        encoded = name.encode("utf-16-le") + b"\0\0"
        size = len(mini) if kind == 5 else len(data)
        table += encoded.ljust(64, b"\0") + struct.pack("<HBBIII", len(encoded), kind, 1, 0xFFFFFFFF, rights.get(i, 0xFFFFFFFF), child.get(i, 0xFFFFFFFF)) + b"\0" * 36 + struct.pack("<IQ", starts.get(i, 0xFFFFFFFE), size)
    directory = chain(table)
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    assert len(fat) <= 128
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    header = containers_magic() + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIII", 0, 1, directory, 0, 4096) + struct.pack("<IIII", small, 1, 0xFFFFFFFE, 0) + struct.pack("<I", at)
    return header.ljust(512, b"\xff") + b"".join(sectors)


def containers_magic() -> bytes:
    return bytes.fromhex("D0CF11E0A1B11AE1")


SOURCE = b'Attribute VB_Name = "Module1"\r\nPublic Sub Run_Click()\r\n  Shell "x"\r\nEnd Sub\r\n'


def project() -> bytes:
    text = b'Module=Module1\r\nClass=Thing\r\nDocument=Sheet1/&H00000000\r\nReference=*\\G{00020430-0000-0000-C000-000000000046}#2.0#0#C:\\x\\stdole2.tlb#OLE Automation\r\n'
    return compound({"PROJECT": text, "VBA/dir": dir_stream([("Module1", 7, 0x21)]), "VBA/Module1": b"junk..." + ovba(SOURCE), "VBA/Thing": b"\0\0" + ovba(b'Attribute VB_Name = "Thing"\r\nSub A()\r\nEnd Sub'), "Form/o": b"z" * 5000})


def test_published_decompression_example():
    packed = bytes.fromhex("01 2F B0 00 23 61 61 61 62 63 64 65 82 66 00 70 61 67 68 69 6A 01 38 08 61 6B 6C 00 30 6D 6E 6F 70 06 71 02 70 04 10 72 73 74 75 76 10 77 78 79 7A 00 3C")
    assert macros.decompress(packed) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"


def test_literals_raw_chunks_and_damage():
    assert macros.decompress(ovba(SOURCE * 100)) == SOURCE * 100
    raw = b"\x01" + struct.pack("<H", 0x3000 | (4096 + 2 - 3)) + b"q" * 4096
    assert macros.decompress(raw) == b"q" * 4096
    assert macros.decompress(ovba(b"abc") + b"\x00\x00") == b"abc"  # a bad signature ends it
    with pytest.raises(ValueError):
        macros.decompress(b"\x02")


def test_compound_streams():
    found = dict(containers.CompoundFile(project()).streams())
    assert list(found) == ["PROJECT", "VBA/dir", "VBA/Module1", "VBA/Thing", "Form/o"]
    assert found["Form/o"] == b"z" * 5000 and found["VBA/Module1"].startswith(b"junk...")


def test_dir_modules_and_damage():
    data = macros.decompress(dir_stream([("A", 5, 0x21), ("B", 9, 0x22)]))
    assert macros.dir_modules(data) == [("A", "A", 5, 0x21), ("B", "B", 9, 0x22)]
    assert macros.dir_modules(data[:-8]) == []
    assert macros.dir_modules(b"") == []


def test_dir_references():
    lib = rb"*\G{00020430-0000-0000-C000-000000000046}#2.0#0#C:\x\stdole2.tlb#OLE Automation"
    records = record(0x16, b"stdole") + struct.pack("<HI", 0x3E, 12) + "stdole".encode("utf-16-le") + record(0x0D, struct.pack("<I", len(lib)) + lib + b"\0" * 6)
    assert macros.dir_references(macros.decompress(dir_stream([("A", 0, 0x21)], records))) == [("registered", "stdole", lib.decode(), f"record 0x000D {lib.decode()}")]
    lone = record(0x16, b"ctl") + record(0x33, lib) + record(0x99, b"?") + record(0x0E, b"")
    assert macros.dir_references(macros.decompress(dir_stream([("A", 0, 0x21)], lone))) == [("control", "ctl", lib.decode(), f"record 0x0033 {lib.decode()}")]


def test_model_of_a_folder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsm", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/vbaProject.bin", project())
        z.writestr("xl/media/image1.png", b"png")
        z.writestr("xl/workbook.xml", "<x/>")
    (tmp_path / "loose.bas").write_bytes("Sub Café_Click()\r\nSub B()\r\n' TODO\r\nEnd Sub".encode("cp1252"))
    (tmp_path / "bad.xlsm").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "other.txt").write_bytes(b"hello")
    m = documents.model(spark, str(tmp_path))
    got = {(r.name, r.kind): r for r in m["source_files"].collect()}
    assert got["Module1.bas", "vba"].text == SOURCE.decode().rstrip("\0")
    assert got["Module1.bas", "vba"].source_path == "xl/vbaProject.bin/VBA/Module1 @ 0x7"
    assert got["Thing.cls", "vba"].source_path.endswith("(recovered by scan)")
    assert got["loose.bas", "vba"].text.startswith("Sub Café")
    assert {r.file_name for r in m["rejected"].collect()} == {"other.txt"}
    parts = {r.path: r for r in m["package_parts"].collect()}
    assert parts["xl/media/image1.png"].mime_type == "image/png" and parts["xl/workbook.xml"].content is None
    assert parts[None].error
    assert {r.category for r in m["risk_markers"].collect()} == {"External process", "Global state", "TODO"}  # "Public Sub" counts as global state
    refs = macros.project_references(m["streams"].where("path = 'PROJECT'")).collect()
    assert [(r.kind, r.guid, r.version) for r in refs] == [("registered", "{00020430-0000-0000-C000-000000000046}", "2.0")]


def test_folder_is_read_once(spark, tmp_path):
    """With a scratch folder no table goes back to the many small files, and the same tables come from addresses as from their folder."""
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / f"in/a b{i}.bas").write_bytes(b"Sub X()\r\nEnd Sub")
    (tmp_path / "in/other.txt").write_bytes(b"hello")
    m = documents.model(spark, str(tmp_path / "in"), str(tmp_path / "scratch"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not [name for name in ("documents", "rejected", "source_files", "resources", "files") if "binaryFile" in plan(m[name])]
    at = containers.addressed_documents(spark.createDataFrame([(f"file://{p}",) for p in (tmp_path / "in").iterdir()], "path string"))
    found = documents.model(spark, at)
    for name, columns in (("documents", ["file_name", "format"]), ("source_files", ["name", "text"]), ("rejected", ["file_name"])):
        assert sorted(found[name].select(*columns).collect()) == sorted(m[name].select(*columns).collect())


def test_decoders_hand_on_whole_batches():
    """Rows of many containers come in one batch, a damaged one's error among them; none gives no batch."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(50)]), pa.array([project() if i != 7 else b"x" for i in range(50)])], ["doc_id", "content"])
    got = list(containers._rows(lambda b: ((i, p, None, None, len(x), x, None) for i, (p, x) in enumerate(containers.CompoundFile(b).streams())))([batch, batch]))
    each = len(dict(containers.CompoundFile(project()).streams()))
    assert len(got) == 1 and len(got[0]) == 2 * (49 * each + 1) and got[0].column("error").drop_null().to_pylist() == ["no compound file header"] * 2
    dirs = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["v"] * 3), pa.array([dir_stream([("A", 5, 0x21), ("B", 9, 0x22)]), b"", dir_stream([("C", 0, 0x21)])])], ["doc_id", "container", "content"])
    rows = list(macros._decoded(macros.dir_modules, ["name", "stream_name", "text_offset", "module_type_id"], [pa.string(), pa.string(), pa.int64(), pa.int32()])([dirs]))
    assert len(rows) == 1 and [(r["doc_id"], r["ord"], r["name"]) for r in rows[0].to_pylist()] == [("a", 0, "A"), ("a", 1, "B"), ("c", 0, "C")]


def test_zip_sink(spark, tmp_path):
    files = spark.createDataFrame([("d", 0, "a.txt", bytearray(b"1")), ("d", 1, "a.txt", bytearray(b"2"))], "doc_id string, file_ord int, path string, content binary")
    row = containers.write_zips(files, str(tmp_path / "out")).first()
    with zipfile.ZipFile(row.path) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"1", "a.txt~2": b"2"} and z.testzip() is None


def test_unsupported_method():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("a", b"x")
    assert [(r[1], r[5], r[6]) for r in containers.zip_parts(data.getvalue(), lambda p: True)] == [("a", None, "unsupported method 12")]
