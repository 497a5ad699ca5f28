"""The data sources over folders, packages read by ranges, and table functions in SQL."""

import io
import os
import struct
import zipfile

import pytest

from docustrata.functions import table_functions
from docustrata.sources import containers, office, packages

from test_containers import SOURCE, compound, dir_stream, ovba, project


def package(parts: dict[str, bytes], method=zipfile.ZIP_DEFLATED, comment=b"") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in parts.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_packages_are_read_by_ranges():
    parts = {f"xl/media/i{i}.png": os.urandom(5000) for i in range(50)} | {"xl/wörk.xml": b"<x/>", "empty": b""}
    data = package(parts, comment=b"c" * 60000)
    asked = []
    read = lambda at, n: asked.append((at, n)) or data[at : at + n]
    found = packages.entries(read, len(data))
    assert [e.name for e in found] == list(parts)
    assert {e.name: packages.unpack(read, e, 1 << 20) for e in found} == parts
    asked.clear()
    assert packages.unpack(read, found[7], 1 << 20) == parts["xl/media/i7.png"]
    assert sum(n for _, n in asked) < 5200  # its header and its bytes


def test_damaged_packages():
    data = package({"a": b"x" * 1000, "b": b"y"})
    read = packages.reader(data)
    (a, b) = packages.entries(read, len(data))
    for bad in (b"", b"PK\x03\x04broken", data[:-22]):
        with pytest.raises(packages.BadPackage):
            packages.entries(packages.reader(bad), len(bad))
    with pytest.raises(packages.BadPackage, match="too large"):
        packages.unpack(read, a, 999)
    lying = packages.Entry("a", 8, a.compressed_size, 10, a.offset)
    with pytest.raises(packages.BadPackage, match="too large"):
        packages.unpack(read, lying, 999)  # what is unpacked counts, not what is stated
    with pytest.raises(packages.BadPackage):
        packages.unpack(read, packages.Entry("a", 8, a.compressed_size - 3, 1000, a.offset), 1 << 20)
    with pytest.raises(packages.BadPackage, match="local header"):
        packages.unpack(read, packages.Entry("a", 0, 1, 1, 5), 1 << 20)
    cut = data.replace(b"PK\x01\x02", b"XX\x01\x02", 1)
    assert packages.entries(packages.reader(cut), len(cut)) == []


def test_large_package_fields():
    """Sizes in the extra field, and an end record that points to the one for large packages."""
    body = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 3, 3, 1, 0) + b"n" + b"abc"
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(body))
    data = body + central + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, len(body) + len(central), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (e,) = packages.entries(packages.reader(data), len(data))
    assert (e.size, e.offset) == (3, 0) and packages.unpack(packages.reader(data), e, 9) == b"abc"


def test_partitions_are_even():
    files = [("big", 1000), *((f"f{i}", 10 + i) for i in range(100))]
    got = office.dealt(files, 500)
    sizes = [sum(s for _, s in p.files) for p in got]
    assert len(got) == 14 and sorted(f for p in got for f in p.files) == sorted(files)
    assert max(sizes) == 1000 and max(sorted(sizes)[:-1]) - min(sizes) < 110
    assert office.dealt([], 500) == [] and len(office.dealt([("a", 0)], 500)) == 1


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"b{i}.xlsm").write_bytes(package({"xl/vbaProject.bin": project(), f"xl/media/image{i}.png": b"p" * 700, "xl/workbook.xml": b"<x/>" * 50, "xl/activeX/a1.bin": b"q" * 90}))
    (tmp_path / "old.xls").write_bytes(compound({"PROJECT": b"Module=M", "VBA/M": b"..." + ovba(SOURCE), "Form/f": b"f" * 5000}))
    (tmp_path / "bad.xlsm").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "other.txt").write_bytes(b"hello")
    (tmp_path / "none").write_bytes(b"")
    return tmp_path


def test_parts_as_a_source(spark, folder):
    office.register(spark)
    every = spark.read.format("office_parts").load(str(folder))
    rows = every.collect()
    docs = containers.raw_documents(spark, str(folder))
    want = {(r.path, bytes(r.content)) for r in containers.package_parts(docs.where("format = 'zip'")).where("content is not null").collect()}
    assert {(r.path, bytes(r.content)) for r in rows if r.content is not None} == want and len(rows) == 25
    assert [(r.file, r.path) for r in rows if r.error] == [("bad.xlsm", None)]
    assert {r.kind: r.path for r in rows if r.path and r.file == "b3.xlsm"} == {"binary": "xl/vbaProject.bin", "media": "xl/media/image3.png", "xml": "xl/workbook.xml", "activex": "xl/activeX/a1.bin"}


@pytest.mark.parametrize("test,parts,unpacked", [("kind = 'media'", 6, 700), ("path = 'xl/activeX/a1.bin'", 6, 90), ("kind in ('media', 'activex')", 12, 790), ("path like '%.png'", 6, 700), ("path like 'xl/act%'", 6, 90), ("path like '%image4%'", 1, 700), ("file = 'b2.xlsm' and kind = 'media'", 1, 700)])
def test_pushed_filters_leave_other_parts_packed(spark, folder, test, parts, unpacked):
    office.register(spark)
    df = spark.read.format("office_parts").option("maxPartitionBytes", "1").load(str(folder)).where(test)
    plan = df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert len(rows) == parts and all(len(r.content) == r.size for r in rows)
    assert max(r.unpacked for r in rows) <= unpacked, plan  # a partition a file: nothing else was unpacked


def test_what_the_reader_takes_of_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    class Schema:
        def fieldNames(self):
            return ["path"]

    r = office.OfficeReader(Schema(), {"path": "x"}, False)
    taken, left = [EqualTo(("kind",), "media"), StringContains(("path",), "a")], [GreaterThan(("size",), 5), EqualTo(("error",), "x")]
    assert list(r.pushFilters(taken + left)) == left and r.pushed == taken


def test_schema_without_content_unpacks_nothing(spark, folder):
    office.register(spark)
    got = spark.read.format("office_parts").schema("doc_id string, path string, size long, unpacked long").load(str(folder)).where("path is not null").collect()
    assert len(got) == 24 and {r.unpacked for r in got} == {0} and sum(r.size for r in got if r.path.endswith(".png")) == 4200


def test_streams_as_a_source(spark, folder):
    office.register(spark)
    df = spark.read.format("office_streams").load(str(folder))
    rows = df.collect()
    assert {(r.container, r.path) for r in rows if r.file == "old.xls"} == {("old.xls", p) for p in ("PROJECT", "VBA/M", "Form/f")}
    assert sum(r.path == "VBA/Module1" for r in rows) == 6 and [r.error is not None for r in rows if r.path is None] == [True]
    only = df.where("kind = 'designer'").collect()
    assert {r.path for r in only} == {"Form/f", "Form/o"} and all(len(r.content) == 5000 for r in only)
    sizes = spark.read.format("office_streams").schema("file string, path string, size long").load(str(folder)).where("path = 'PROJECT'").collect()
    assert len(sizes) == 7 and min(r.size for r in sizes) == 8


def test_table_functions(spark):
    names = table_functions.register(spark)
    assert len(names) == 20
    long = b"\0" * 3 + b"Order 12" + b"\0" * 3 + "Täxt wide".replace("ä", "a").encode("utf-16-le")
    data = [("a", long), ("b", None), ("c", b""), ("d", package({"x": b"1"})), ("e", compound({"VBA/M": b"m" * 70})), ("f", dir_stream([("A", 5, 0x21)])), ("g", ovba(SOURCE)), ("h", b"PK\x05\x06"), ("i", b"\x01\x00")]
    t = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in data], "doc_id string, content binary")
    for name in names[::2]:
        columns, _ = table_functions.FUNCTIONS[name]
        arg = ", 'Form/f'" if name == "oforms" else ""
        lateral = spark.sql(f"SELECT t.doc_id, s.* FROM {{t}} t, LATERAL {name}(t.content{arg}) s", t=t)
        more = ", 'Form/f' AS stream" if name == "oforms" else ""
        batched = spark.sql(f"SELECT * FROM {name}_of(TABLE(SELECT doc_id, content{more} FROM {{t}}))", t=t)
        dealt = spark.sql(f"SELECT * FROM {name}_of(TABLE(SELECT doc_id, content{more} FROM {{t}}) PARTITION BY doc_id)", t=t)
        key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
        one = key(lateral.collect())
        assert one == key(batched.collect()) == key(dealt.collect()), name
        assert lateral.columns[1:] == [c.split()[0] for c in columns.split(", ")]
        assert "Exchange" not in batched._jdf.queryExecution().executedPlan().toString()
        assert len(one) == {"zip_entries": 1, "cfb_streams": 1, "ovba_text": 3, "dir_modules": 1}.get(name, len(one))


def test_packages_are_written_front_to_back(spark, tmp_path):
    """What is written reads back, by this library and by another; colliding names are numbered; a task holds no whole export."""
    import datetime

    files = [("d1", i, f"f/{i % 30}.txt", os.urandom(i * 37 % 900)) for i in range(100)] + [("d2", 0, "wörk.xml", b"<x/>"), ("d2", 1, "empty", None)]
    df = spark.createDataFrame([(d, i, p, None if b is None else bytearray(b)) for d, i, p, b in files], "doc_id string, file_ord int, path string, content binary").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        rows = {r.doc_id: r for r in containers.write_zips(df, str(tmp_path / "out"), datetime.datetime(2024, 5, 17, 13, 31, 58)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: r.entries for k, r in rows.items()} == {"d1": 100, "d2": 2} and sorted(os.listdir(tmp_path / "out")) == ["d1.zip", "d2.zip"]
    for d, r in rows.items():
        own = [f for f in files if f[0] == d]
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and [z.read(n) for n in z.namelist()] == [f[3] or b"" for f in own] and r.size == os.path.getsize(r.path)
            assert all(i.compress_type == 0 and i.flag_bits == 0x0800 and i.date_time == (2024, 5, 17, 13, 31, 58) for i in z.infolist())
    with zipfile.ZipFile(rows["d1"].path) as z:
        assert z.namelist()[31] == "f/1.txt~2" and z.namelist()[99] == "f/9.txt~4"


def test_batched_functions_hand_on_few_tables():
    """One table for many contents, and no table of more than ROWS rows however many one content gives."""
    import pyarrow as pa

    make = table_functions._batched(*table_functions.FUNCTIONS["strings"], False).func
    rows = lambda *contents: pa.RecordBatch.from_arrays([pa.array(range(len(contents))), pa.array(contents, pa.binary())], ["k", "content"])
    got = list(make().eval(rows(*[b"word"] * 1000)))
    assert len(got) == 1 and got[0].column("key").to_pylist() == [str(i) for i in range(1000)]
    got = list(make().eval(rows(b"word\0" * 10_000, b"last")))
    assert [t.num_rows for t in got] == [4096, 4096, 1809] and got[-1].to_pylist()[-1] == {"key": "1", "encoding": "ASCII", "offset": 0, "value": "last"}
    assert [t.num_rows for t in make().eval(rows(*[b"x" * (3 << 20)] * 3))] == [2, 1]


@pytest.mark.parametrize("name, function", [("extended_streams", "oforms"), ("form_records_in_bytes", "oforms"), ("nested_pictures", "recover_media"), ("streams_in_bytes", "cfb_streams"), ("modules_in_bytes", "dir_modules"), ("picture_formats", "recover_media")])
def test_queries_over_bytes_take_whole_batches(spark, name, function):
    from docustrata.plans.byte_queries import QUERIES

    # a session of its own: no other query has registered the functions
    plan = QUERIES[name](spark.newSession(), "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f"{function}_of(" in plan and f" {function}(" not in plan


def test_shared_folders_are_addresses(tmp_path):
    """Executors of a cluster write below the checkpoint folder, so it is named with its file system."""
    from types import SimpleNamespace

    from docustrata.plans import rendered_documents as D

    for top, want in ((str(tmp_path), f"file://{tmp_path}"), (f"file:{tmp_path}", f"file://{tmp_path}"), (f"file://{tmp_path}", f"file://{tmp_path}"), ("hdfs://h/x", "hdfs://h/x")):
        session = SimpleNamespace(conf={"spark.checkpoint.dir": top}, sparkContext=SimpleNamespace(master="spark://h:7077"))
        assert D.shared(session, "export").startswith(f"{want}/export-")


def test_form_sizes_of_large_keys(spark, tmp_path):
    """Suppliers whose form is too wide to be sure of, or to be one at all."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docustrata.plans.document_queries import QUERIES, SQL

    keys = [1, 999, 20_999, 21_000, 27_999, 28_000, 60_000, 360_000]
    pq.write_table(pa.table({"s_suppkey": keys}), tmp_path / "supplier.parquet")
    got = sorted(map(tuple, QUERIES["document_form_properties"](spark, str(tmp_path)).select("k", "file", "form", "name", "value").collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    assert got == sorted(duck.sql(f"SELECT k, file, form, name, value FROM ({SQL['document_form_properties']})").fetchall())
    assert sum("low" in v for _, _, _, n, v in got if n == "Decoded DisplayedSize") == 2 and len(got) == 7 * 8 - 3


@pytest.mark.parametrize("name, function", [("streams_in_bytes", "cfb_streams"), ("nested_pictures", "recover_media"), ("media_in_bytes", "recover_media"), ("picture_formats", "recover_media"), ("guids_in_bytes", "guids"), ("modules_in_bytes", "dir_modules"), ("references_in_bytes", "dir_references"), ("form_records_in_bytes", "oforms"), ("extended_streams", "oforms"), ("record_texts", "strings")])
def test_queries_over_bytes_hold_no_contents(spark, name, function):
    """Spark queues the whole input of a batched table function until its task ends; these queries map their batches."""
    from docustrata.plans import byte_queries, structure_queries  # noqa: F401
    from docustrata.plans.queries import QUERIES

    plan = QUERIES[name](spark.newSession(), "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" not in plan and f"MapInArrow {function}_of(" in plan


def test_rows_found_in_a_table(spark):
    """As the SQL form gives them, but keys keep their type, a null one too."""
    table_functions.register(spark)
    data = [(1, b"\0Order 12\0" * 3000), (2, None), (3, b""), (4, package({"x": b"1"})), (None, compound({"VBA/M": b"m" * 70})), (6, dir_stream([("A", 5, 0x21)])), (7, ovba(SOURCE)), (8, b"PK\x05\x06"), (9, b"\x01\x00"), (10, compound({"A": b"x" * 9000})[:1500])]
    t = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in data], "k long, content binary").coalesce(1)
    for name, (columns, _) in table_functions.FUNCTIONS.items():
        own = t.selectExpr("*", "'Form/f' AS stream") if name == "oforms" else t
        got = table_functions.found(own, name)
        want = spark.sql(f"SELECT * FROM {name}_of(TABLE(SELECT * FROM {{t}}))", t=own)
        assert got.dtypes[0] == ("key", "bigint") and got.dtypes[1:] == want.dtypes[1:]
        assert sorted(str((str(k), *r)) for k, *r in got.collect()) == sorted(str(tuple(r)) for r in want.collect()), name


def test_tables_of_compound_files_stay_bytes():
    """A table of a large file is not spread into a list of numbers; chains end, and end where they come back to themselves."""
    import struct

    from docustrata.sources.containers import CompoundFile

    data = compound({"A": b"a" * 9000, "B": b"b" * 70})
    file = CompoundFile(data)
    assert isinstance(file.next, bytes) and isinstance(file.small_next, bytes)
    assert dict(file.streams()) == {"A": b"a" * 9000, "B": b"b" * 70}
    first = next(e[5] for e in file.entries if e and e[0] == "A")
    (table,) = struct.unpack_from("<I", data, 76)
    back = bytearray(data)
    struct.pack_into("<I", back, (table + 1) * 512 + 4 * (first + 1), first)
    assert dict(CompoundFile(bytes(back)).streams()) == {"A": b"a" * 1024, "B": b"b" * 70}
