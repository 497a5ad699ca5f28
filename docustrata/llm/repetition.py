"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

For each length the characters (code points of words) inside n-grams that occur at least twice in the
same text are measured, and the characters of lines equal to an earlier line. Nothing is shuffled:
each row is judged by itself, inside the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, covered, mix, powers, texts

#: n-gram length -> largest share of word characters inside duplicated n-grams of that length, in percent.
LIMITS = {3: 60, 5: 35, 7: 30, 10: 25}
#: Largest share of word characters in lines that repeat an earlier one, and of symbols to words, in percent.
LINE_LIMIT, SYMBOL_LIMIT = 30, 10
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GOLD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _twice(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which hashes occur at least twice in their row."""
    key = mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _lines(w: Words, data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: the lines with a word that equal an earlier line, and their word characters."""
    rows = len(offsets) - 1
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1, offsets[1:]]))
    begin, end = cut[:-1], cut[1:]
    row = np.searchsorted(offsets, begin, "right") - 1
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10))
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    has = b > a
    begin, end, row, a, b = begin[has], end[has], row[has], a[has], b[has]
    if not len(begin):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    _, down = powers(len(data) + 1)
    h = mix((w.sums[end] - w.sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    key = mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    total = np.concatenate([[0], np.cumsum(chars)])
    return np.bincount(row[later], minlength=rows), np.bincount(row[later], weights=(total[b] - total[a])[later], minlength=rows).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts by row."""
    rows = len(offsets) - 1
    w = Words(data, offsets)
    row = w.rows()
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = begun[w.end] - begun[w.start]
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    by = lambda x: np.bincount(row, weights=x, minlength=rows).astype(np.int64)
    out = {"n_words": np.diff(w.first).astype(np.int64), "word_chars": by(chars), "n_symbols": (signs[offsets[1:]] - signs[offsets[:-1]]).astype(np.int64)}
    out["n_dup_lines"], out["dup_line_chars"] = _lines(w, data, offsets, chars)
    for n in LIMITS:
        h, at = w.windows(n)
        hit = covered(at[_twice(h, row[at])], n, len(row)) if len(h) else np.zeros(len(row), bool)
        out[f"dup_chars_{n}"] = by(chars * hit)
        if n == 3:
            out["n_repeat_words"] = by(hit)
    return out


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LIMITS)]


def _measured(batches):
    for batch in batches:
        for a, b, data, offsets in texts(batch.column("text")):
            m = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(m[c], pa.int64()) for c in _COLUMNS)], ["doc_id", *_COLUMNS])


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition counts and a verdict for each input row.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (words in
    3-word windows found twice or more), dup_line_chars, dup_chars_N for each N of LIMITS, base_failed
    (under 50 words, or more than half of them in repeated 3-word windows) and kept: not base_failed, and
    within every limit of LIMITS, LINE_LIMIT and SYMBOL_LIMIT.

    A null or empty text has zero counts and fails. Repeated rows, null ids and ties are ordinary rows;
    other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    fine = ~F.col("base_failed") & (100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")) & (100 * F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words"))
    for n, most in LIMITS.items():
        fine &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return out.withColumn("kept", fine)


def op6_repetition(spark, sf_dir: str) -> DataFrame:
    """Per document: the base counts, base_failed and kept, then the coverage by n-gram length."""
    out = repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *(c for c in out.columns if c not in first))


_D = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, u.x AS x, row_number() OVER (PARTITION BY doc_id, u.x) AS k, length(regexp_replace(u.x, '[\x20\x09-\x0D]+', '', 'g')) AS c
  FROM (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x: {'x': x})) AS u FROM d)
), dl AS (
  SELECT doc_id, count(*)::BIGINT AS n_dup_lines, sum(c)::BIGINT AS dup_line_chars FROM l WHERE c > 0 AND k > 1 GROUP BY doc_id
)
"""


def _covered_sql(n: int) -> str:
    return f"""
, s{n} AS (
  SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})
), r{n} AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM s{n}) WHERE c > 1
), g{n} AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM r{n}
), c{n} AS (
  SELECT g.doc_id, count(*)::BIGINT AS words, sum(length(d.w[g.k]))::BIGINT AS chars FROM g{n} g JOIN d USING (doc_id) GROUP BY g.doc_id
)"""


ORACLE_SQL = (
    _D
    + "".join(map(_covered_sql, LIMITS))
    + """
, m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(c3.words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
"""
    + ", ".join(f"coalesce(c{n}.chars, 0) AS dup_chars_{n}" for n in LIMITS)
    + " FROM d LEFT JOIN dl USING (doc_id) "
    + " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in LIMITS)
    + f"""
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND 100 * n_symbols <= {SYMBOL_LIMIT} * n_words
"""
    + "".join(f" AND 100 * dup_chars_{n} <= {most} * word_chars" for n, most in LIMITS.items())
    + " AS kept FROM m"
)
