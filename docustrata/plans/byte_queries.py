"""Registered queries over bytes that Spark renders from ``orders``: table functions, called from SQL or (``of``) on whole tables.

``k`` is an order's key. Each content is written as hexadecimal text by SQL; the SQL for DuckDB states what must be found in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import table_functions
from .queries import _FORM_VALUES, _PICTURE, QUERIES, SQL


def _le(n: str, size: int) -> str:
    """Little-endian bytes of a number as hexadecimal digits."""
    return " || ".join(f"lpad(hex(cast(floor({n} / {256**i}) as bigint) % 256), 2, '0')" for i in range(size))


def _utf16(text: str) -> str:
    return f"regexp_replace(hex({text}), '(..)', '$100')"


def _record(kind: int, payload: str) -> str:
    """A record of a ``dir`` stream: id, size, payload."""
    return f"{_le(str(kind), 2)} || {_le(f'(length({payload}) / 2)', 4)} || {payload}"


def _raw_container(data: str) -> str:
    """A compressed container of one chunk that is not compressed."""
    return f"'01' || {_le(f'(12288 + length({data}) / 2 - 1)', 2)} || {data}"


def _bytes(content: str | list[str]):
    """Bytes of hexadecimal text. Of a list each item is read by itself, so that what is alike in all rows is read when the query is planned."""
    return F.unhex(F.expr(content)) if isinstance(content, str) else F.concat(*(F.unhex(F.expr(c)) for c in content))


def _query(name: str, sql: str, select: str, steps: dict[str, str] | None = None, of: str | None = None, **columns: str | list[str]):
    """``steps``: named texts that later columns build on. ``select``: SQL over ``{t}``, the rendered rows, or what function ``of`` finds in them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table_functions.register(spark)
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "k")
        for n, v in (steps or {}).items():
            rows = rows.withColumn(n, F.expr(v))
        rows = rows.select("k", *(_bytes(v).alias(n) if n.startswith("content") else F.expr(v).alias(n) for n, v in columns.items()))
        return spark.sql(select, t=table_functions.found(rows, of) if of else rows)

    QUERIES[name], SQL[name] = run, sql


_K = "(SELECT o_orderkey AS k FROM orders)"

_query(
    "strings_in_bytes",
    f"""SELECT k AS o_orderkey, s[1] AS encoding, s[2]::BIGINT AS "offset", s[3] AS value FROM (SELECT k, unnest(list_filter([
      ['ASCII', (k % 7)::VARCHAR, 'Order ' || k], CASE WHEN (k % 7 + length('Order ' || k)) % 2 = 0 THEN ['UTF-16LE', (k % 7 + length('Order ' || k) + 2)::VARCHAR, lpad(k::VARCHAR, 7, '0')] END,
      ['ASCII', (k % 7 + length('Order ' || k) + 20)::VARCHAR, repeat('z', 4 + k % 3)]], lambda x: x IS NOT NULL)) AS s FROM {_K})""",
    "SELECT t.k AS o_orderkey, s.* FROM {t} t, LATERAL strings(t.content) s",
    content=f"repeat('00', cast(k % 7 as int)) || hex('Order ' || k) || '0000' || {_utf16("lpad(k, 7, '0')")} || '00000000' || hex(repeat('z', cast(4 + k % 3 as int))) || '01' || hex('abc')",
)

_GUID = lambda h: f"'{{' || upper(concat_ws('-', substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2), substr({h}, 11, 2) || substr({h}, 9, 2), substr({h}, 15, 2) || substr({h}, 13, 2), substr({h}, 17, 4), substr({h}, 21, 12))) || '}}'"
_G = "hex(lpad(k, 8, '0')) || lpad(hex(128 + k % 64), 2, '0') || hex(lpad(k * 7 % 10000000, 7, '0'))"
#: One GUID, or two on end, between bytes that hold none.
GUID_CONTENT = f"repeat('41', cast(k % 5 as int)) || {_G} || case when k % 2 = 0 then {_G} else '' end || case when k % 3 = 0 then repeat('00', 20) else repeat('FF', 20) end"
_query(
    "guids_in_bytes",
    f"""WITH g AS (SELECT k, hex(lpad(k::VARCHAR, 8, '0')) || lpad(hex(128 + k % 64), 2, '0') || hex(lpad((k * 7 % 10000000)::VARCHAR, 7, '0')) AS h FROM {_K})
    SELECT k AS o_orderkey, (k % 5)::BIGINT AS "offset", {_GUID("h")} AS guid FROM g UNION ALL SELECT k, k % 5 + 16, {_GUID("h")} FROM g WHERE k % 2 = 0""",
    "SELECT cast(key AS BIGINT) AS o_orderkey, offset, guid FROM {t}",
    of="guids",
    content=GUID_CONTENT,
)

_N = "(14 + k % 50)"
_query(
    "signatures_in_bytes",
    f"""SELECT k AS o_orderkey, (k % 13 + s[1]::BIGINT)::BIGINT AS "offset", s[2] AS label, s[3] AS detail FROM (SELECT k, unnest(CASE k % 8
      WHEN 0 THEN [['0', 'GIF image', {_N} || ' B']] WHEN 1 THEN [['0', 'BMP image', (34 + k % 50) || ' B']]
      WHEN 2 THEN [['0', 'MS-OFORMS StdPicture', {_N} || ' B picture payload'], ['8', 'GIF image', {_N} || ' B']]
      WHEN 3 THEN [['0', 'MS-OFORMS StdPicture', (1 + k % 90) || ' B picture payload']]
      WHEN 4 THEN [['0', 'MS-OFORMS GuidAndPicture MS-OFORMS StdPicture GIF image', {_N} || ' B extracted/rebuilt']]
      WHEN 5 THEN [['0', 'DIB image rebuilt as BMP', '78 B extracted/rebuilt']] WHEN 6 THEN [['0', 'PNG image', (16 + k % 90) || ' B']] END) AS s FROM {_K})""",
    "SELECT t.k AS o_orderkey, s.* FROM {t} t, LATERAL signatures(t.content) s",
    content=f"repeat('41', cast(k % 13 AS INT)) || {_PICTURE} || '4141'",
)

_query(
    "media_in_bytes",
    SQL["picture_scan"],
    "SELECT cast(key AS BIGINT) AS o_orderkey, offset, extension, mime_type, length, cast(octet_length(bytes) AS BIGINT) AS n_bytes, place FROM {t}",
    of="recover_media",
    content=f"repeat('41', cast(k % 13 AS INT)) || {_PICTURE} || '4141'",
)

_query(
    "source_in_bytes",
    f"""SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 10 + length(k::VARCHAR) + k % 20 WHEN k % 3 = 1 THEN 6 + k % 40 END::BIGINT AS n_bytes,
      CASE WHEN k % 3 = 0 THEN 'Sub x' || k || '()''' || chr(233) || chr(8364) ELSE substr(repeat(lpad((k % 1000)::VARCHAR, 3, '0'), 20), 1, (6 + k % 40)::INTEGER) END AS text FROM {_K} WHERE k % 3 < 2""",
    "SELECT t.k AS o_orderkey, s.* FROM {t} t, LATERAL ovba_text(t.content) s",
    # a chunk as it is, with NULs behind it; three literals and a copy of them; no container
    {"plain": "hex('Sub x' || k || '()''') || 'E980' || repeat('00', cast(k % 20 as int))", "body": f"'08' || hex(lpad(k % 1000, 3, '0')) || {_le('(2 * 4096 + k % 40)', 2)}"},
    content=f"case k % 3 when 0 then {_raw_container('plain')} when 1 then '01' || {_le('(45056 + length(body) / 2 - 1)', 2)} || body else '02' || plain end",
)

#: Two modules of a ``dir`` stream (the second a class) and, before them, a registered and a project reference.
_MODULE = lambda name, offset, kind: " || ".join(_record(i, p) for i, p in ((0x19, f"hex({name})"), (0x1A, f"hex({name} || 's')"), (0x32, _utf16(f"({name} || 's')")), (0x1C, "''"), (0x48, "''"), (0x31, _le(offset, 4)), (0x1E, "'00000000'"), (0x2C, "'0000'"), (kind, "''"), (0x2B, "''")))
_LIBRARY = r"'*\\G{00020430-0000-0000-C000-0000' || lpad(k, 8, '0') || '}#2.' || k % 10 || '#0#C:/x.dll#Some library'"
_DIR = {
    "lib": f"hex({_LIBRARY})",
    "refs": f"{_record(0x16, 'hex(concat(\'lib\', k))')} || {_record(0x0D, '(' + _le('(length(lib) / 2)', 4) + ' || lib || \'000000000000\')')} || case when k % 2 = 0 then {_record(0x16, 'hex(\'other\')')} || {_record(0x0E, '(' + _le('5', 4) + ' || hex(\'a.xls\') || ' + _le('8', 4) + ' || hex(\'..\\a.xls\'))'.replace(chr(92), chr(92) * 2))} else '' end",
    "mods": f"{_record(0x0F, '\'0200\'')} || {_record(0x13, '\'0000\'')} || {_MODULE('concat(\'Mod\', k)', '(k * 3)', 0x21)} || {_MODULE('concat(\'Cls\', k)', '(k % 1000)', 0x22)}",
}
_query(
    "modules_in_bytes",
    f"SELECT k AS o_orderkey, 0 AS ord, 'Mod' || k AS name, 'Mod' || k || 's' AS stream_name, (k * 3)::BIGINT AS text_offset, 33 AS module_type_id FROM {_K} UNION ALL SELECT k, 1, 'Cls' || k, 'Cls' || k || 's', k % 1000, 34 FROM {_K}",
    "SELECT cast(key AS BIGINT) AS o_orderkey, ord, name, stream_name, text_offset, module_type_id FROM {t}",
    _DIR | {"all": "refs || mods"},
    of="dir_modules",
    content=_raw_container('`all`'),
)
_query(
    "references_in_bytes",
    rf"""SELECT *, CASE kind WHEN 'registered' THEN 'record 0x000D ' ELSE 'record 0x000E ' END || lib_id AS raw FROM (SELECT k AS o_orderkey, 0 AS ord, 'registered' AS kind, 'lib' || k AS name, '*\G{{00020430-0000-0000-C000-0000' || lpad(k::VARCHAR, 8, '0') || '}}#2.' || k % 10 || '#0#C:/x.dll#Some library' AS lib_id FROM {_K}
    UNION ALL SELECT k, 1, 'project', 'other', '..\a.xls' FROM {_K} WHERE k % 2 = 0)""",
    "SELECT cast(key AS BIGINT) AS o_orderkey, ord, kind, name, lib_id, raw FROM {t}",
    _DIR | {"all": "refs || mods"},
    of="dir_references",
    content=_raw_container('`all`'),
)

_TEXT = "hex('Order ' || k)"
_LEN = "length('Order ' || k)"
_LOCAL = lambda name, method, packed, n: f"'504B030414000000' || {_le(method, 2)} || '0000000000000000' || {_le(packed, 4)} || {_le(n, 4)} || {_le(f'length({name})', 2)} || '0000' || hex({name})"
_CENTRAL = lambda name, method, packed, n, at: f"'504B0102140014000000' || {_le(method, 2)} || '0000000000000000' || {_le(packed, 4)} || {_le(n, 4)} || {_le(f'length({name})', 2)} || repeat('00', 12) || {_le(at, 4)} || hex({name})"
#: A package of two entries: one stored, one deflated (a block that is not compressed).
PACKAGE = {
    "n1": "concat('xl/media/f', k, '.png')",
    "n2": "concat('xl/activeX/g', k, '.bin')",
    "e1": f"{_LOCAL('n1', '0', _LEN, _LEN)} || {_TEXT}",
    "e2": f"{_LOCAL('n2', '8', f'({_LEN} + 5)', _LEN)} || '01' || {_le(_LEN, 2)} || {_le(f'(65535 - {_LEN})', 2)} || {_TEXT}",
    "dir": f"{_CENTRAL('n1', '0', _LEN, _LEN, '0')} || {_CENTRAL('n2', '8', f'({_LEN} + 5)', _LEN, '(length(e1) / 2)')}",
}
PACKAGE_CONTENT = f"e1 || e2 || dir || '504B05060000000002000200' || {_le('(length(dir) / 2)', 4)} || {_le('((length(e1) + length(e2)) / 2)', 4)} || '0000'"
_query(
    "entries_in_bytes",
    f"""SELECT k AS o_orderkey, 0 AS ord, 'xl/media/f' || k || '.png' AS name, 0 AS method, {_LEN}::BIGINT AS compressed_size, {_LEN}::BIGINT AS size, 0::BIGINT AS local_offset FROM {_K}
    UNION ALL SELECT k, 1, 'xl/activeX/g' || k || '.bin', 8, {_LEN} + 5, {_LEN}, 30 + length('xl/media/f' || k || '.png') + {_LEN} FROM {_K}""",
    "SELECT t.k AS o_orderkey, s.* FROM {t} t, LATERAL zip_entries(t.content) s",
    PACKAGE,
    content=PACKAGE_CONTENT,
)

_ENTRY = lambda name, kind, child, first, size: f"{_utf16(name)} || repeat('00', cast(64 - 2 * length({name}) as int)) || {_le(f'(2 * length({name}) + 2)', 2)} || '{kind}01FFFFFFFFFFFFFFFF{child}' || repeat('00', 36) || '{first}' || {_le(size, 8)}"
#: A compound file of a storage with one stream: header, table, directory, small table, small streams.
COMPOUND = [
    "'D0CF11E0A1B11AE1' || repeat('00', 16) || '3E000300FEFF09000600000000000000' || '00000000' || '01000000' || '01000000' || '00000000' || '00100000' || '02000000' || '01000000' || 'FEFFFFFF' || '00000000' || '00000000' || repeat('FF', 432)",
    "'FDFFFFFFFEFFFFFFFEFFFFFFFEFFFFFF' || repeat('FF', 496)",
    _ENTRY("'Root Entry'", "05", "01000000", "03000000", "512"),
    _ENTRY("'VBA'", "01", "02000000", "FEFFFFFF", "0"),
    _ENTRY("concat('m', k)", "02", "FFFFFFFF", "00000000", _LEN),
    "repeat('00', 128)",
    "'FEFFFFFF' || repeat('FF', 508)",
    _TEXT,
    f"repeat('00', cast(512 - length({_TEXT}) / 2 as int))",
]
_query(
    "streams_in_bytes",
    f"SELECT k AS o_orderkey, 0 AS ord, 'VBA/m' || k AS path, {_LEN}::BIGINT AS size, 'Order ' || k AS text FROM {_K}",
    "SELECT cast(key AS BIGINT) AS o_orderkey, ord, path, size, cast(content AS STRING) AS text FROM {t}",
    of="cfb_streams",
    content=COMPOUND,
)

_CAPTION = "concat('Form ', k)"
FORM_CONTENT = f"'0004' || {_le(f'(12 + length({_CAPTION}))', 2)} || '00040800' || {_le('(200 + k % 20000)', 4)} || {_le('(150 + k % 9000)', 4)} || hex({_CAPTION})"
_query(
    "form_records_in_bytes",
    f"SELECT k AS o_orderkey, i::INTEGER AS prop_ord, v[i + 1][1] AS name, v[i + 1][2] AS value FROM (SELECT k, {_FORM_VALUES} AS v FROM {_K}), range(8) r(i)",
    "SELECT cast(key AS BIGINT) AS o_orderkey, prop_ord, name, value FROM {t}",
    of="oforms",
    content=FORM_CONTENT,
    stream="'Form/f'",
)

_M = "(40 + k % 60)"
_PICTURES = f"""case k % 7
  when 0 then '000001000100' || '1010000001002000' || {_le('(k % 60 + 5)', 4)} || '16000000' || repeat('2C', cast(k % 60 + 5 as int))
  when 1 then '000002000100' || '1010000001002000' || {_le('(k % 60 + 5)', 4)} || '16000000' || repeat('2C', cast(k % 60 + 5 as int))
  when 2 then 'FFD8' || repeat('2C', cast({_M} as int)) || 'FFD9'
  when 3 then '49492A00' || repeat('2C', cast({_M} as int))
  when 4 then 'D7CDC69A' || repeat('2C', cast({_M} as int))
  when 5 then '01000000' || repeat('00', 36) || '20454D46' || '2C2C2C2C' || {_le('(100 + k % 60)', 4)} || repeat('2C', cast(48 + k % 60 as int))
  else '6C740000' || {_le('20', 4)} || '010009000003' || {_le('10', 4)} || repeat('00', 10) end"""
_query(
    "picture_formats",
    f"""SELECT k AS o_orderkey, (k % 11)::BIGINT AS "offset", x[1] AS extension, x[2] AS mime_type, x[3]::BIGINT AS length, x[4] AS label FROM (SELECT k, CASE k % 7
      WHEN 0 THEN ['ico', 'image/x-icon', (27 + k % 60)::VARCHAR, 'ICO icon'] WHEN 1 THEN ['cur', 'image/x-icon', (27 + k % 60)::VARCHAR, 'CUR cursor'] WHEN 2 THEN ['jpg', 'image/jpeg', (44 + k % 60)::VARCHAR, 'JPEG image']
      WHEN 3 THEN ['tif', 'image/tiff', (47 + k % 60)::VARCHAR, 'TIFF image'] WHEN 4 THEN ['wmf', 'image/wmf', (47 + k % 60)::VARCHAR, 'Placeable WMF image'] WHEN 5 THEN ['emf', 'image/emf', (100 + k % 60)::VARCHAR, 'EMF image']
      ELSE ['wmf', 'image/wmf', '28', 'MS-OFORMS StdPicture WMF image'] END AS x FROM {_K})""",
    "SELECT cast(key AS BIGINT) AS o_orderkey, offset, extension, mime_type, length, regexp_replace(place, ' at 0x[0-9A-F]+$', '') AS label FROM {t}",
    of="recover_media",
    content=f"repeat('41', cast(k % 11 as int)) || {_PICTURES} || '414141'",
)

_query(
    "nested_pictures",
    f"""SELECT k AS o_orderkey, (k % 5)::BIGINT AS "offset", 'gif' AS extension, 'Nested OLE at 0x000' || k % 5 || ' / VBA/m' || k || ' / GIF image at 0x0002' AS place FROM {_K} UNION ALL
    SELECT k, k % 5 + 2050, 'gif', 'GIF image at 0x' || lpad(hex(k % 5 + 2050), 4, '0') FROM {_K}""",
    "SELECT cast(key AS BIGINT) AS o_orderkey, offset, extension, place FROM {t}",
    of="recover_media",
    content=["repeat('41', cast(k % 5 as int))", *(c.replace(_TEXT, "hex('xxGIF89a') || repeat('00', 7) || '2C3B'").replace(_LEN, "17") for c in COMPOUND)],
)

_EXTENDED = "SELECT cast(key AS BIGINT) AS o_orderkey, kind, record_ord, offset, size, name, value FROM {t}"
_query(
    "extended_streams",
    f"""SELECT k AS o_orderkey, kind, record_ord, "offset", size, name, value FROM (
      SELECT k, 'Extended stream' AS kind, i::INTEGER AS record_ord, 8 * i AS "offset", 8 AS size, p[1] AS name, p[2] AS value FROM (SELECT k, i, unnest([['Value1', '0x' || lpad(hex(k + i), 8, '0')], ['Value2', '0x' || lpad(hex(i * 3), 8, '0')]]) AS p FROM {_K}, range(3) r(i) WHERE i < k % 3 + 1)
      UNION ALL SELECT k, 'COM compound object', 0, 0, 12 + length('Form ' || k) + 1 + 20, 'ASCII string @ 0x000C', 'Form ' || k FROM {_K}
      UNION ALL SELECT k, 'COM compound object', 0, 0, 12 + length('Form ' || k) + 1 + 20, 'ASCII string @ 0x' || lpad(hex(13 + length('Form ' || k)), 4, '0'), 'Microsoft Forms 2.00' FROM {_K})""",
    _EXTENDED,
    of="oforms",
    content=" || ".join(f"case when k % 3 >= {i} then {_le(f'(k + {i})', 4)} || {_le(str(3 * i), 4)} else '' end" for i in range(3)),
    stream="'Form/x'",
)
_plain_extended = QUERIES["extended_streams"]


def _both_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended streams, and class streams beside them."""
    table_functions.register(spark)
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")).repartition(spark.sparkContext.defaultParallelism, "k")
    content = "repeat('00', 12) || hex(concat('Form ', k)) || '00' || hex('Microsoft Forms 2.00')"
    rows = keys.select("k", F.lit("Form/\x01CompObj").alias("stream"), F.unhex(F.expr(content)).alias("content"))
    more = spark.sql(_EXTENDED, t=table_functions.found(rows.select("k", "content", "stream"), "oforms"))
    return _plain_extended(spark, sf_dir).unionByName(more)


QUERIES["extended_streams"] = _both_extended
