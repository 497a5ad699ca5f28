"""Trees, intervals, ordered lists, phrases and chunked scans against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docustrata.operators import binary, chunks, controls, intervals, source_code, trees
from docustrata.sources import office


def plain_tree(nodes):
    """(position, depth, parent, below) by walking: nodes are path -> (order, parent)."""
    parent = {p: q if q in nodes else None for p, (_, q) in nodes.items()}
    for p in nodes:
        seen, at = [], p
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is not None:
            parent[min(seen[seen.index(at) :], key=lambda x: (nodes[x][0], x))] = None
    children = {}
    for p, q in parent.items():
        children.setdefault(q, []).append(p)
    out, place = {}, 0

    def walk(p, depth):
        nonlocal place
        mine, place = place, place + 1
        for c in sorted(children.get(p, []), key=lambda x: (nodes[x][0], x)):
            walk(c, depth + 1)
        out[p] = (mine, depth, parent[p], place - mine - 1)

    for p in sorted(children.get(None, []), key=lambda x: (nodes[x][0], x)):
        walk(p, 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_preorder(spark, seed):
    r = random.Random(seed)
    forms = []
    for form in range(5):
        n = r.choice([1, 4, 30])
        forms.append({f"p{i}": (r.randint(0, 9), r.choice([None, "gone", *(f"p{r.randrange(n)}" for _ in range(4))])) for i in range(n)})
    forms.append({f"d{i}": (i, f"d{i - 1}") for i in range(40)} | {"s": (1, "s")})  # a long chain, a node that is its own parent
    rows = [("doc", f, p, q, o, "x") for f, nodes in enumerate(forms) for p, (o, q) in nodes.items()]
    df = spark.createDataFrame(rows, "doc_id string, form int, path string, parent_path string, control_ord int, own string")
    tree = trees.preorder(df, ["doc_id", "form"])
    got = {(t.form, t.path): (t.position, t.depth, t.parent_path, t.n_below) for t in tree.collect()}
    assert got == {(f, p): v for f, nodes in enumerate(forms) for p, v in plain_tree(nodes).items()}
    assert trees.preorder(df.limit(0), ["doc_id", "form"]).count() == 0
    below = {(b.form, b.root, b.path) for b in trees.below(tree, df, ["doc_id", "form"]).collect()}
    for f, nodes in enumerate(forms):
        for p in nodes:
            chain, at = {p}, got[f, p][2]
            while at:
                chain.add(at)
                at = got[f, at][2]
            assert {root for g, root, q in below if (g, q) == (f, p)} == chain


def test_interval_join(spark):
    r = random.Random(4)
    points = [(k, r.randint(0, 600), f"v{i}") for i in range(300) for k in [r.choice("ab")]]
    spans = [(k, i, a, a + r.choice([-3, 0, 1, 5, 128, 129, 500])) for i in range(60) for k in [r.choice("abc")] for a in [r.randint(0, 600)]] + [("a", 60, None, 5)]
    p = spark.createDataFrame(points, "k string, offset long, value string")
    s = spark.createDataFrame(spans, "k string, i int, start long, end long")
    got = sorted((x.i, x.value) for x in intervals.interval_join(p, s, ["k"]).collect())
    assert got == sorted((i, v) for k, o, v in points for q, i, a, b in spans if k == q and a is not None and a <= o < b)
    assert "CartesianProduct" not in (plan := intervals.interval_join(p, s, ["k"])._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_record_texts_are_those_of_the_decoder(spark):
    """The relation gives what the decoding of a stream lists of its strings."""
    from docustrata.operators import forms

    r = random.Random(2)
    streams = []
    for n in range(40):
        data = b""
        for _ in range(r.randint(1, 4)):
            body = b"".join(r.choice([b"text%03d\0" % r.randint(0, 99), b"\0" * r.randint(1, 9), "wide".encode("utf-16-le") + b"\0\0"]) for _ in range(r.randint(0, 20)))
            data += b"\0\x02" + (4 + len(body)).to_bytes(2, "little") + r.randint(0, 255).to_bytes(4, "little") + body
        streams.append((n, data + b"behind\0" * r.randint(0, 20)))
    want, records, strings = [], [], []
    for n, data in streams:
        found = forms.stream_records("F/o", data)
        strings += [(n, e, o, v) for e, o, v in binary.find_strings(data)]
        for i, (at, _, size, properties) in enumerate(found[2]):
            records.append((n, i, at, size, len(data)))
            want += [(n, i, m.group(1), int(m.group(2), 16)) for name, _ in properties if (m := re.fullmatch(r"(Record|StreamData) string @ 0x([0-9A-F]+)", name))]
    got = intervals.record_texts(spark.createDataFrame(records, "k int, record_ord int, offset long, size long, stream_size long"), spark.createDataFrame(strings, "k int, encoding string, offset long, value string"), ["k"])
    assert sorted((x.k, x.record_ord, x.place, x.offset) for x in got.collect()) == sorted(want) and len(want) > 200


@pytest.mark.parametrize("bits,texts", [(0, 3), (1, 0), (7, 9), (5, 2), (3, 3)])
def test_ordinal_properties(spark, bits, texts):
    names = {0: "a", 1: "b", 3: "c", 4: "d", 5: "e", 6: "f", 9: "g"}
    mask = sum(1 << b for b in list(names)[:bits])
    masks = spark.createDataFrame([("k", mask), ("other", 1)], "k string, mask long")
    own = spark.createDataFrame([("k", 10 * i, f"t{i % 2}") for i in range(texts)], "k string, offset long, value string")
    taken = intervals.ordinal_properties(masks, own, ["k"], names)
    n = min(bits, texts)
    assert sorted((x.name, x.offset) for x in taken.collect()) == [(list(names.values())[i], 10 * i) for i in range(n)]
    assert sorted(x.offset for x in intervals.left_over(own, taken, ["k"]).collect()) == [10 * i for i in range(n, texts)]


def test_lists_of_an_owner(spark):
    files = [("b.bas", "vba", "x/b", 1), ("A.bas", "vba", "x/A", 2), ("f.frm", "frm", "d/vbaProject.bin/F/z", 3), ("r", "frx", "d/vbaProject.bin/F/\x03VBFrame", 4), ("q", "frx", "d/vbaProject.bin/F/a @ 0x1F", 5), ("m.png", "media", "d/xl/media/m.png", 6), ("p", "binary", "d/vbaProject.bin/PROJECTwm", 7)]
    df = spark.createDataFrame([("d", *f) for f in files], "doc_id string, name string, kind string, source_path string, size long")
    got = {r.owner: r for r in controls.result_lists(df).collect()}
    assert [x.display_path for x in got["F"].resources] == ["F/0x03 VBFrame", "F/a"] and got["F"].has_designer and got["F"].place == 1
    assert [x.name for x in got["F"].code] == ["f.frm"] and got["F"].media == [] and got["A"].place < got["b"].place
    assert got["Project metadata"].other[0].size == 7 and not got["Project metadata"].has_designer and [x.name for x in got["Office media parts"].media] == ["m.png"]
    assert controls.result_lists(df.limit(0)).count() == 0


def test_phrases(spark):
    names = ["Sheet 1-a", "a.b", "(x)", "--", "wörter z", "one", "x" * 50 + " " * 40 + "y", "é", "", "a$1", "A.B.c", "--a", "b--"]
    texts = ["see SHEET 1-A, then", "Sheet 1-ab", "xSheet 1-a", "Sheet  1-a", "a.b.c", "f(x)g", "f (x)g", "(x)", "a--b", "a --b", "c--a", "b--c", "WöRTER z", "one", "onE two", "none", "x" * 50 + " " * 40 + "Y", "x" * 50 + " " * 41 + "y", "aéb", "A$1", "", None]
    t = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "doc_id string, i int, text string")
    p = spark.createDataFrame([("d", n) for n in names] + [("e", "one")], "doc_id string, name string")
    out = source_code.phrase_matches(t, p, "doc_id", "text", "name", ["i"])
    want = {(i, n) for i, x in enumerate(texts) for n in names if n and re.search(rf"(?ai)(?:(?<=\w)(?!\w)|(?<!\w)(?=\w)){re.escape(n)}(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", x or "")}
    assert {(r.i, r.name) for r in out.collect()} == want and len(want) >= 12
    plan = source_code.module_references(spark.createDataFrame([("d", "a b.bas", "x")], "doc_id string, name string, text string"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"\(\d+\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan._jdf.queryExecution().explainString(mode))
    assert len(moved) > 3 and not any("text#" in m for m in moved)


def blobs():
    r = np.random.default_rng(8)
    out = [b"", b"abc", b"abcd", r.integers(0, 256, 20000, np.uint8).tobytes(), b"A" * 300, "wide text ".encode("utf-16-le") * 40, bytes(500), b"\xff" * 100]
    guid = bytes.fromhex("0102030405060758" "90a0b0c0d0e0f001")
    out.append(b"\0" * 55 + guid + b"\0" * 57 + guid * 9 + b"\x41" * 3 + guid)
    out.append(bytes([0x55, 0x85] * 700))  # everything overlaps
    out.append(b"x" * 61 + b"\0" + b"four" + b"\0" * 61 + b"ab\0" + b"z" * 64 + b"\x01" + b"tail")
    out.append(r.choice(np.frombuffer(b"\x00\x41\x85\x20\x58", np.uint8), 9000).tobytes())
    return out


@pytest.mark.parametrize("size", [32, 64, 4096, 1 << 20])
def test_chunked_scans(spark, size):
    data = blobs()
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)] + [(99, None)], "k int, content binary").repartition(3)
    cut = chunks.chunked(rows, "k", "content", size).repartition(5)
    want = {(i, e, o, v) for i, b in enumerate(data) for e, o, v in binary.find_strings(b)}
    assert {(r.key, r.encoding, r.offset, r.value) for r in chunks.chunk_strings(cut).collect()} == want
    guids = sorted((i, o, g) for i, b in enumerate(data) for o, g in binary.find_guids(b))
    assert sorted((r.key, r.offset, r.guid) for r in chunks.chunk_guids(cut).collect()) == guids and len(guids) > 300
    whole = {r.k: (r.size, round(r.entropy, 9), r.zero_bytes) for r in binary.byte_profile(rows, "k", "content").collect() if r.size}
    assert {r.key: (r.size, round(r.entropy, 9), r.zero_bytes) for r in chunks.chunk_profile(cut).collect()} == whole


def test_files_in_chunks(spark, tmp_path):
    data = blobs()
    for i, b in enumerate(data):
        (tmp_path / f"f{i}").write_bytes(b)
    office.register(spark)
    df = spark.read.format("byte_chunks").option("chunkBytes", "64").option("maxPartitionBytes", "1000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    cut = df.select(F.col("file").alias("key"), "start", "content")
    want = {(f"f{i}", o, v) for i, b in enumerate(data) for _, o, v in binary.find_strings(b)}
    assert {(r.key, r.offset, r.value) for r in chunks.chunk_strings(cut).collect()} == want
    assert df.where("file = 'f3'").count() == -(-20000 // 64)
    with pytest.raises(ValueError):
        chunks.chunked(df, "file", "content", 63)


def test_starts_of_pictures_are_those_of_one_pattern():
    """Every format by itself finds what the alternation does, in its order."""
    from docustrata.operators import pictures as P

    def plain(data):
        at = 0
        while m := P._START.search(data, at):
            at = m.start()
            got = P._FORMATS[m.lastgroup](data, at, False)
            if got:
                yield at, got
            at += max(got.length, 1) if got else 1

    r = random.Random(5)
    parts = [b"\0", b"\0\0\1\0", b"\0\0\2\0", b"BM", b"GIF89a", b"\xff\xd8", b"\xff\xd9", b"II*\0", b"MM\0*", b"\x28\0\0\0", b"\1\0\0\0", b" EMF", b";", P._WRAPPER, P._PNG, P._PNG_END, P._PICTURE_CLASS, b"\1\0", b"x", b"\n", b"\xd7\xcd\xc6\x9a", b"\x14\0\0\0"]
    for _ in range(3000):
        data = b"".join(r.choices(parts, k=r.randint(0, 60)))
        assert list(P._found(data)) == list(plain(data))


def test_wide_strings_at_odd_offsets_are_none():
    """A run of two-byte characters counts at even offsets only, also where one stands at an odd one."""
    wide = "word".encode("utf-16-le")
    assert binary.find_strings(b"\1" + wide) == [] and binary.find_strings(b"\1\1" + wide) == [("UTF-16LE", 2, "word")]
    assert binary.find_strings(b"\1" + wide + b"\1" + wide) == [("UTF-16LE", 10, "word")]


def test_postings_of_a_long_text(spark):
    """The words of a text are listed once, not once a word: 60,000 words take well under the minutes that took."""
    import time

    words = [f"w{i}" for i in range(60_000)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    since = time.time()
    got = df.select(F.explode(source_code.postings(F.col("t"))).alias("p")).select("p.*").where("pos in (0, 1, 59999)").collect()
    assert [tuple(r) for r in sorted(got)] == [(0, "w0", "", " ", False, True), (1, "w1", " ", " ", True, True), (59_999, "w59999", " ", "", True, False)]
    assert time.time() - since < 30


def test_names_are_not_broadcast(spark):
    """Names and phrases grow with the texts, so neither is sent to the driver."""
    files = spark.createDataFrame([(1, "a b.bas", "x c"), (1, "c.bas", "a b"), (1, "(.bas", "z(z")], "doc_id long, name string, text string")
    df = source_code.module_references(files)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(1, "a b", "c"), (1, "c", "a b")]


def test_strings_by_mask_are_both_lists(spark):
    """The values of properties and what is left over, as the two operators give them."""
    names = {0: "Name", 1: "Tag", 3: "Tip"}
    masks = spark.createDataFrame([(k, k) for k in range(12)], "k int, mask long")
    own = spark.createDataFrame([(k, 10 * i, f"v{i}") for k in range(14) for i in range(k % 5)], "k int, offset long, value string")
    taken = intervals.ordinal_properties(masks, own, ["k"], names)
    rest = intervals.left_over(own, taken, ["k"]).selectExpr("k", "cast(null as int) as bit", "cast(null as string) as name", "offset", "value")
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(intervals.strings_by_mask(masks, own, ["k"], names)) == rows(taken.unionByName(rest))


def test_exploded_lists_are_made_once(spark):
    """Before an inner explode Spark puts a filter on the list's size, which makes the list, and what it is made from, again for each element."""
    from docustrata.operators import controls as C
    from docustrata.operators import forms
    from docustrata.operators import source_code as S

    files = spark.createDataFrame([("d", 0, "Form1.frm", "frm", "p", "Sub A_Click()\nShell 1\nEnd Sub\nSub B()\nA_Click\nEnd Sub")], "doc_id string, file_ord int, name string, kind string, source_path string, text string")
    procs = S.procedures(files, with_body=True)
    streams = spark.createDataFrame([("d", "c", 0, "Form1/i01/f", b"\0\x04" + bytes(40))], "doc_id string, container string, ord int, path string, content binary")
    controls = forms.controls(streams, forms.form_streams(streams))
    for df in (procs, S.events(procs), S.dependencies(files), S.risk_markers(files), S.calls(procs), C.event_links(S.events(procs), controls)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and not [line for line in plan.split("\n") if "Filter" in line and "(size(" in line and "transform(" in line]
    assert [(r["name"], r["line_start"], r["line_end"]) for r in procs.orderBy("proc_ord").collect()] == [("A_Click", 1, 3), ("B", 4, 6)]
    assert [r["path"] for r in controls.collect()] == ["Form1/i01"]


def test_merged_sorts_once(spark):
    """The sorted entries are one value: not sorted again for each entry that looks at its neighbours."""
    from docustrata.operators import merges

    rows = spark.createDataFrame([(1, [("a", "1"), ("b", "2"), ("a", "3"), (None, "4")])], "id int, e array<struct<name:string,value:string>>")
    got = rows.select(merges.merged(rows["e"]).alias("m"))
    assert list(got.first()["m"].items()) == [("a", "3"), ("b", "2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().replace("sort_array", "array_sort")
    assert plan.count("array_sort(") == 2


def test_texts_and_values_in_the_row(spark):
    """What the joins of records, strings and masks give, where a stream's strings lie in its row; none without a record."""
    from docustrata.functions import table_functions
    from docustrata.operators import forms

    r, streams = random.Random(6), []
    for n in range(60):
        data = b"\1" * r.randint(0, 3)
        for _ in range(r.randint(0, 4)):
            body = b"".join(r.choice([b"text%03d\0" % r.randint(0, 99), b"\0" * r.randint(1, 9), "wide".encode("utf-16-le") + b"\0\0"]) for _ in range(r.randint(0, 30)))
            data += b"\0\x02" + (4 + len(body)).to_bytes(2, "little") + r.randint(0, 255).to_bytes(4, "little") + body
        streams.append((n, bytearray(data + b"behind\0" * r.randint(0, 20))))
    t = spark.createDataFrame([*streams, (60, None), (61, bytearray())], "key long, content binary")
    rows = table_functions.lists(t, ["object_records", "strings"]).withColumn("first", F.get("object_records", F.lit(0)))
    got = intervals.values_by_mask(rows, ["key"], F.col("first.mask"), intervals.texts_of_record(F.col("first"), F.col("strings")), forms._STRING_BITS)
    first = table_functions.found(t, "object_records").where("record_ord = 0")
    mine = intervals.record_texts(first, table_functions.found(t, "strings"), ["key"])
    want = intervals.strings_by_mask(first, mine, ["key"], forms._STRING_BITS)
    listed = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert listed(got) == listed(want) and got.columns == want.columns and got.count() > 300 and rows.count() == 62
    for n, data in streams:  # headers alone tell the records that decoding gives
        decoded = [(o, size, int(dict(p)["PropMask"][2:10], 16)) for o, _, size, p in (forms.stream_records("F/o", bytes(data)) or (0, 0, []))[2]]
        assert forms.object_records(bytes(data)) == decoded


def test_mask_values_shuffle_keys_only(spark):
    """Records and strings of a stream are found and matched in its row: one shuffle, of keys, no join and no window."""
    from docustrata.plans import structure_queries

    plan = structure_queries.mask_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Window" not in plan and "UDTF" not in plan


def shuffled_rows(spark, df) -> int:
    """Rows that a run of a query writes for its shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_words_that_no_name_resembles_stay(spark):
    """Of 9,000 words only those that may be names are shuffled, and no place of a word where no name is a phrase."""
    text = " ".join(f"{a}{b}{c}x{i}" for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstu" for c in "abcdefghijklmnopqrstu"))
    files = spark.createDataFrame([("d", "Mod1.bas", text + " MOD2"), ("d", "Mod2.bas", "mod1 mod22 mod3"), ("e", "Mod3.bas", "mod1")], "doc_id string, name string, text string")
    df = source_code.module_references(files)
    assert sorted(map(tuple, df.collect())) == [("d", "Mod1", "Mod2"), ("d", "Mod2", "Mod1")]
    assert len(set(text.split())) > 8000 and shuffled_rows(spark, df) < 100
    odd = spark.createDataFrame([("d", "(-).bas", text + " a(-)b"), ("d", "two words.bas", "x(-)y"), ("d", "z.bas", text + " Two WORDS")], "doc_id string, name string, text string")
    df = source_code.module_references(odd)
    assert sorted(map(tuple, df.collect())) == [("d", "two words", "(-)"), ("d", "z", "two words")] and shuffled_rows(spark, df) < 2000


def test_sketch_passes_its_words(spark):
    """Each word of a sketch passes, others of the same letters do, and few of the rest; a sketch of nothing is null."""
    words = [f"name{i}_{'abcdefgh'[i % 8]}" for i in range(500)]
    kept = spark.createDataFrame([(w,) for w in words], "w string")
    known = source_code.sketch(kept, "w")
    passed = lambda rows: rows.where(source_code.in_sketch(F.col("w"), known)).count()
    assert passed(kept) == 500 and passed(spark.range(2000).selectExpr("concat('w', translate(md5(string(id)), '0123456789', 'ghijklmnop')) as w")) < 20
    assert passed(spark.createDataFrame([("name99999_c",), ("name_c",)], "w string")) == 2
    assert kept.limit(1).select(source_code.sketch(kept.where("false"), "w").isNull()).first()[0]


def test_sources_are_rendered_behind_the_shuffle(spark, tmp_path):
    """Keys are shuffled, not texts; those of a customer without a number, and of none, are rendered as before."""
    from docustrata.plans import rendered

    spark.createDataFrame([(7, 17), (7, 34), (7, 5), (None, 17), (None, 3), (8, None), (9, 250_000)], "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    df = rendered.files(spark, str(tmp_path))
    assert "partial_collect_list(o_orderkey" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.name): r.text for r in df.collect()}
    orders = spark.read.parquet(str(tmp_path / "orders.parquet"))
    part = {(r.o_custkey, r.o_orderkey): r.part for r in orders.select("*", F.expr(rendered.PART).alias("part")).collect()}
    assert got == {(0, "Customer7.cls"): "\n".join(part[7, k] for k in (5, 17, 34)), (None, None): part[None, 3], (0, "Customer8.frm"): "", (0, "Customer9_2.bas"): part[9, 250_000]}
