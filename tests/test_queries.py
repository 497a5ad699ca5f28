"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from docustrata.plans import byte_queries, document_queries, report_queries, structure_queries  # noqa: F401 (add their queries)
from docustrata.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_source_queries_do_not_shuffle_lines(spark):
    """Per-file analysis stays in the row: a plan over stored files has no exchange."""
    from docustrata.operators import source_code as S

    files = spark.createDataFrame([(1, 0, "a.bas", "vba", "p", "Sub A()\nEnd Sub")], "doc_id long, file_ord int, name string, kind string, source_path string, text string")
    for df in (S.procedures(files), S.risk_markers(files), S.variables(files), S.events(S.procedures(files))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_call_graph_finds_calls_once(spark):
    """The report reads its edges in three places; the bodies' words are not made and shuffled for each."""
    assert "regexp_extract_all" not in QUERIES["call_graph_report"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rebuild_brief", "dependency_report", "frontend_plan", "migration_test_plan"])
def test_reports_render_sources_once(spark, name):
    """What a report reads in several places is stored: its plan reads sources and does not render them in each place."""
    assert "kernel32" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


#: Texts that are absent, empty, one byte, one byte many times, and of a line's length, with bytes that are not printed.
ODD_TEXTS = [(1, None), (2, ""), (3, "a"), (4, "bbbbbbbb"), (5, "0123456789abcdef"), (6, "\0é€\x7f\n" * 40), (7, "ab" * 64), (8, " ")]


def odd_documents(spark, tmp_path, name):
    """Rows of a query over odd texts, and those of its SQL, as they are printed: zeros have a sign."""
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    return sorted(map(repr, got)), sorted(map(repr, c.sql(SQL[name]).fetchall()))


def test_hex_dump_of_odd_texts(spark, tmp_path):
    got, want = odd_documents(spark, tmp_path, "hex_dump")
    assert got == want and len(got) == 6


def test_text_entropy_of_odd_texts(spark, tmp_path):
    got, want = odd_documents(spark, tmp_path, "text_entropy")
    assert got == want and len(got) == 6
