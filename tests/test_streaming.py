"""Relations of documents whose files come one after another, against those of a batch."""

import time

from pyspark.sql import functions as F

from docustrata.operators import source_code as S
from docustrata.streaming import relations

FILES = {
    "A.bas": "Public Sub Start()\n  Helper 1\n  B.Run\nEnd Sub\nSub Alone()\nEnd Sub\n",
    "B.cls": 'Sub Run()\n  Set x = CreateObject("Scripting.FileSystemObject")\n  Start\nEnd Sub\n',
    "C.bas": "Sub helper(n)\n  a.Start: Alone\nEnd Sub\n",
}


def batch(spark, files):
    df = spark.createDataFrame([("d", i, n, "vba", n, t) for i, (n, t) in enumerate(files.items())], "doc_id string, file_ord int, name string, kind string, source_path string, text string")
    calls = S.calls(S.procedures(df, with_body=True)).select(F.lit("call"), "file_name", "name", "callee")
    refs = S.module_references(df).join(df.select(S.module_name(F.col("name")).alias("module"), F.col("name").alias("n")), "module").select(F.lit("reference"), "n", "module", "reference")
    deps = S.dependencies(df).select(F.lit("dependency"), "file_name", "category", "value")
    return {tuple(r) for r in calls.union(refs).union(deps).collect()}


def test_relations_are_those_of_a_batch(spark):
    df = spark.createDataFrame([("d", i, n, "vba", n, t) for i, (n, t) in enumerate(FILES.items())], "doc_id string, file_ord int, name string, kind string, source_path string, text string")
    import json

    facts = {r.name: json.loads(r.facts) for r in relations.file_facts(df).collect()}
    got = relations.relations(facts)
    assert set(got) == batch(spark, FILES) and len(got) == len(set(got)) and {r[0] for r in got} == {"call", "reference", "dependency"}
    assert relations.relations({}) == []


def test_files_of_a_document_come_one_after_another(spark, tmp_path):
    source = tmp_path / "in"
    (source / "doc1").mkdir(parents=True)
    (source / "doc2").mkdir()
    (source / "doc2" / "Lone.bas").write_text("' nothing")
    (source / "doc1" / "A.bas").write_text(FILES["A.bas"])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = relations.arriving_relations(spark, str(source), quiet=2.0).writeStream.format("memory").queryName("arrived").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        def wait(documents, versions):
            for _ in range(90):
                rows = spark.sql("SELECT * FROM arrived").collect()
                top = {}
                for r in rows:
                    top[r.doc_id] = max(top.get(r.doc_id, 0), r.version)
                if len(top) == documents and max(top.values()) >= versions:
                    return rows
                assert query.exception() is None
                time.sleep(1)
            raise AssertionError(rows)

        first = wait(2, 1)
        assert [r.relation for r in first] == [None, None]  # neither says anything yet
        (source / "doc1" / "B.cls").write_text(FILES["B.cls"])
        second = wait(2, 2)
        (source / "doc1" / "C.bas").write_text(FILES["C.bas"])
        last = wait(2, 3)
        latest = lambda rows, v: {(r.relation, r.file_name, r.source, r.target) for r in rows if r.version == v and r.relation}
        assert latest(second, 2) == batch(spark, {n: FILES[n] for n in ("A.bas", "B.cls")})
        assert latest(last, 3) == batch(spark, FILES)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
