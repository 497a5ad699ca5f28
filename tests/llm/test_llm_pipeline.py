"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from docustrata.llm import minhash, registry
from docustrata.llm.session import stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
        if name == "near_dedup":
            assert minhash.near_duplicates(docs, words=5).where("not kept").count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, data).select("doc_id").collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    clean = [r.doc_id in kept for r in labels if r.quality and not r.toxic]
    toxic = [r.doc_id in kept for r in labels if r.quality and r.toxic]
    assert sum(clean) >= 0.9 * len(clean) and sum(toxic) <= 0.5 * len(toxic)


def test_stages_with_odd_rows(spark):
    """Nulls in any column, repeated rows, empty texts and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, long_, "en", "a", 9), (3, long_, "en", "a", 9), (4, long_ + " more", None, "b", None), (None, long_ + " token=abcdefghijklmnop", "en", "a", 1)]
    for table, expected in ((spark.createDataFrame(rows, schema), True), (spark.createDataFrame([], schema), False)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stored(stage(spark, table, DATA), name)
            assert out.columns == corpus_pipeline.COLUMNS
            n = out.count()
            assert (n > 0) == expected
            if name in ("substrings", "secrets"):
                assert n == table.count() and out.where("text is null").count() == 0
            if name == "near_dedup" and expected:
                kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
                assert sum(k[1] == 3 for k in kept) == 2 and not any(k[1] == 4 for k in kept)  # repeated rows stay together, near ones go
            if name == "secrets" and expected:
                assert out.where("text like '%abcdefghijklmnop%'").count() == 0
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
        assert (pieces.count() >= table.count()) and (pieces.count() > 0) == expected
        graded = stored(corpus_pipeline.quality_stage(spark, table, DATA), "quality")
        assert graded.columns == corpus_pipeline.COLUMNS and graded.count() <= table.count()


def test_near_duplicates_stage_ignores_other_columns(spark):
    """Columns that the stage uses inside itself may be in the corpus as well."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, i long, text_hash long, gone_id long, gone_hash long, digest binary"
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "a", 1, 7, 8, 9, 10, None), (2, text, "en", "b", 1, 7, 8, 9, 10, None), (None, text, "en", "b", 1, 1, 1, 1, 1, None), (4, "other words", "en", "b", 1, 1, 1, 1, 1, None)]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, schema), DATA)
    assert out.columns == corpus_pipeline.COLUMNS and sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_every_operator_is_registered():
    names = list(registry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 14 and set(registry.oracle_sql()) <= set(names)
