"""Source files and controls rendered from the tables ``orders`` and ``customer`` by SQL that Spark and DuckDB both run.

The given tables hold no macro source; this gives the source operators one module per customer and block of order keys,
with a procedure per order, so modules stay small however large the tables are, and whoever holds most of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "CAST(o_orderkey AS STRING)"
#: Lines of one order, with LF between them.
PART = f"""
CASE WHEN o_orderkey % 11 = 0 THEN 'Private Declare PtrSafe Function GetTick' || {_K} || ' Lib "kernel32" () As Long' || chr(10) ELSE '' END
|| CASE WHEN o_orderkey % 13 = 0 THEN 'Public gCount' || {_K} || ' As Long' || chr(10) ELSE '' END
|| CASE o_orderkey % 5
  WHEN 0 THEN 'Public Function calc' || {_K} || '(a As Long, ByVal b As String) As Double'
  WHEN 1 THEN '  Private Sub cmd' || {_K} || '_Click()'
  WHEN 2 THEN 'Sub txt' || {_K} || '_Change(ByVal v)'
  WHEN 3 THEN 'Property Get item' || {_K} || '() As Variant'
  ELSE 'Friend Static Sub run' || {_K} || '(x, y , z)' END || chr(10)
|| CASE WHEN o_orderkey % 4 = 0 THEN '    Const K' || {_K} || ' As Integer = ' || CAST(o_orderkey % 100 AS STRING) ELSE '    Dim n' || {_K} || ' As Long' END || chr(10)
|| CASE o_orderkey % 7
  WHEN 0 THEN '    On Error Resume Next'
  WHEN 1 THEN '    Set o = CreateObject("Scripting.FileSystemObject")'
  WHEN 2 THEN '    Range("A1").Value = ' || {_K}
  WHEN 3 THEN '    '' TODO: check order ' || {_K}
  WHEN 4 THEN '    Shell "cmd /c dir"'
  WHEN 5 THEN '    Kill x' || {_K}
  ELSE '    Set c = New ADODB.Connection: c.Open "x" For y' END || chr(10)
|| '    cmd' || CAST((o_orderkey * 5 + 1) % 6000 AS STRING) || '_Click' || chr(10)
|| CASE WHEN o_orderkey % 17 = 0 THEN '    Customer' || CAST((o_custkey * 3) % 150 AS STRING) || '.Refresh' || chr(10) ELSE '' END
|| CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 5 IN (0) THEN 'End Function' WHEN o_orderkey % 5 IN (3) THEN 'End Property' ELSE 'End Sub' END
"""
#: Order keys of one module.
BLOCK = 100_000
_BLOCK = f"(o_orderkey - o_orderkey % {BLOCK}) / {BLOCK}"
_MODULE = "'Customer' || CAST(o_custkey AS STRING) || CASE WHEN block > 0 THEN '_' || CAST(block AS STRING) ELSE '' END"
_NAME = _MODULE + """ || CASE o_custkey % 3 WHEN 0 THEN '.bas' WHEN 1 THEN '.cls' ELSE '.frm' END"""
_KIND = "CASE o_custkey % 3 WHEN 2 THEN 'frm' ELSE 'vba' END"
_PATH = "CASE o_custkey % 4 WHEN 0 THEN 'book.xlsm/xl/vbaProject.bin/VBA/m' WHEN 1 THEN 'book.xlsm/xl/vbaProject.bin/Form' WHEN 2 THEN 'book.xlsm/xl/vbaProject.bin/VBA/x (recovered by scan)' ELSE 'loose/x' END || CAST(o_custkey % 10 AS STRING)"
#: Customers of one document; what parts the numbers of a customer's modules.
PER_DOC, FAR = 50, 10**9

#: For DuckDB: common table expressions before a query.
FILES_SQL = f"""
parts AS (SELECT o_custkey, CAST({_BLOCK} AS BIGINT) AS block, o_orderkey, {PART} AS part FROM orders),
files AS (
  SELECT o_custkey // {PER_DOC} AS doc_id, o_custkey + block * {FAR} AS file_ord, {_NAME} AS name, {_KIND} AS kind, {_PATH} AS source_path,
    string_agg(part, chr(10) ORDER BY o_orderkey) AS text
  FROM parts GROUP BY o_custkey, block
)"""

_CONTROL = """o_custkey % 3 = 2 AND o_orderkey % 5 IN (1, 2) AND o_orderkey % 2 = 0"""
_CONTROL_COLUMNS = f"""
  'Customer' || CAST(o_custkey AS STRING) AS form, o_orderkey AS control_ord,
  'i' || CAST(o_orderkey AS STRING) AS id, 'Customer' || CAST(o_custkey AS STRING) || '/i' || CAST(o_orderkey AS STRING) AS path,
  CASE WHEN o_orderkey % 5 = 1 THEN 'CMD' ELSE 'txt' END || CAST(o_orderkey AS STRING) || ' (low)' AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Caption ' || CAST(o_orderkey AS STRING) END AS caption,
  CASE WHEN o_orderkey % 5 = 1 THEN 'Forms.CommandButton.1' WHEN o_orderkey % 4 = 0 THEN 'Forms.TextBox.1' END AS type,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 37) % 9000 END AS "left", (o_orderkey * 91) % 7000 AS top, 300 + o_orderkey % 1700 AS width, 200 + o_orderkey % 500 AS height"""
CONTROLS_SQL = f"controls AS (SELECT o_custkey // {PER_DOC} AS doc_id, {_CONTROL_COLUMNS} FROM orders WHERE {_CONTROL})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_ord, name, kind, source_path, text: one file per customer with orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.expr(f"CAST({_BLOCK} AS BIGINT)").alias("block"), "o_orderkey")
    # keys are shuffled, and rendered where they have come together
    text = F.expr(f"array_join(transform(sort_array(collect_list(o_orderkey)), o_orderkey -> {PART}), chr(10))")
    got = orders.groupBy("o_custkey", "block").agg(text.alias("text"))
    return got.select(F.expr(f"o_custkey DIV {PER_DOC}").alias("doc_id"), F.expr(f"o_custkey + block * {FAR}").alias("file_ord"), F.expr(_NAME).alias("name"), F.expr(_KIND).alias("kind"), F.expr(_PATH).alias("source_path"), "text")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(_CONTROL)
    columns = _CONTROL_COLUMNS.replace('"left"', "`left`")
    return orders.selectExpr(f"o_custkey DIV {PER_DOC} AS doc_id", *_split(columns)).withColumn("prog_id", F.lit(None).cast("string")).withColumn("properties", F.lit(None).cast("map<string,string>"))


def _split(columns: str) -> list[str]:
    """The items of a select list: parted by commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]
