"""Document fingerprints by one-permutation MinHash with optimal densification, packed to low-order bits.

Every word shingle is hashed once; the high bits choose its bin, and a bin keeps its smallest value (Li, Owen and Zhang
2012). An empty bin takes the value of the first filled one in its own fixed random order of bins (optimal densification,
Shrivastava 2017; the order is a permutation, so a filled bin is always met). Of each value the low bits are kept
(Li and Koenig 2010), hashed with the bin's number first, so that a value copied into many bins agrees by chance in each of them
separately. Two different values agree in b bits with probability 2**-b, which the likeness takes out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _shingles
from .session import stored
from .words import Words, mix, texts

#: Words of a shingle, bins (a power of two), bits kept of each.
SHINGLE, BINS, BITS = 5, 512, 4
#: Bytes of text in a range of documents, and ranges at most (larger ones then: a task reads its range as a stream); code points of text that are fingerprinted at once.
RANGE, RANGES, AT_ONCE = 1 << 25, 1 << 13, 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


@functools.cache
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Row i: the bins in the order in which bin i asks them when it is empty; and each bin's place in that order."""
    key = mix(np.arange(bins * bins, dtype=np.uint64) * _GOLD + np.uint64(1)).reshape(bins, bins)
    order = np.argsort(key, axis=1, kind="stable").astype(np.int32)
    return order, np.argsort(order, axis=1, kind="stable").astype(np.int32)


def densified(values: np.ndarray) -> np.ndarray:
    """Rows of bin values, at least one filled in each row: empty ones (all bits set) take the first filled bin's in their order."""
    values = values.copy()
    bins = values.shape[1]
    order, place = _orders(bins)
    empty = values == _NONE
    filled = bins - empty.sum(axis=1)
    few = filled * filled < bins
    for row in np.flatnonzero(few & (filled < bins)):  # few filled bins: ask each of them for its place
        own = np.flatnonzero(~empty[row])
        asks = np.flatnonzero(empty[row])
        values[row, asks] = values[row, own[np.argmin(place[asks][:, own], axis=1)]]
    row, asks = np.nonzero(empty & ~few[:, None])
    step = 0
    while len(row):  # many: go through the order, a few steps on average
        other = order[asks, step]
        good = ~empty[row, other]
        values[row[good], asks[good]] = values[row[good], other[good]]
        row, asks, step = row[~good], asks[~good], step + 1
    return values


def codes(h: np.ndarray, row: np.ndarray, rows: int, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of shingle hashes and their rows: which rows have any, and the low bits of every bin of those."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    x = mix(h + _GOLD)
    has = np.zeros(rows, bool)
    has[row] = True
    at = np.cumsum(has) - 1
    out = np.full(int(has.sum()) * bins, _NONE)
    np.minimum.at(out, at[row] * bins + (x >> shift).astype(np.int64), x & ((np.uint64(1) << shift) - np.uint64(1)))
    full = densified(out.reshape(-1, bins))
    return has, (mix(full + np.arange(bins, dtype=np.uint64) * _GOLD) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, bits: int = BITS) -> list[str]:
    """Rows of codes as lowercase hex, high bit first."""
    each = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return [r.tobytes().hex() for r in np.packbits(each.reshape(len(low), -1), axis=1)]


def likeness(x: np.ndarray | None, y: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated share of common shingles, from 0 to 1: agreement less what chance gives. Two texts without words are alike."""
    if x is None or y is None:
        return 1.0 if x is y else 0.0
    chance = 2.0**-bits
    return max(0.0, (float((x == y).mean()) - chance) / (1 - chance))


def _fingerprints(values: list[str], n: int, bins: int, bits: int) -> list[np.ndarray | None]:
    """Each text's codes; none without words."""
    out: list[np.ndarray | None] = []
    for _, _, data, offsets in texts(pa.array(values, pa.large_string()), AT_ONCE):
        h, row = _shingles(Words(data, offsets, lower=True), n)
        has, low = codes(h, row, len(offsets) - 1, bins, bits)
        rest = iter(low)
        out += [next(rest) if k else None for k in has]
    return out


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _range_end(batches, size: int):
    """Runs of rows (range, guest, doc_id, text) of about ``size`` code points, each with the row after it."""
    held: list[tuple] = []
    n = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held, n = [], 0
            if held and held[-1][1]:
                continue  # a guest that is repeated
            held.append(row)
            n += len(row[3])
            if n > size and len(held) > 1:
                yield held
                held = held[-1:]
                n = len(row[3])
    if held:
        yield held


def _neighbours(n: int, bins: int, bits: int):
    """Documents in order, ranges closed by a guest that is the next one's first document."""

    def run(batches):
        last: tuple | None = None
        for rows in _range_end(batches, AT_ONCE):
            if len(rows) < 2:
                continue
            known = [last[1]] if last is not None and last[0] == rows[0] else []
            own = known + _fingerprints([r[3] for r in rows[len(known) :]], n, bins, bits)
            last = (rows[-1], own[-1])
            changed = [edited(a[3], b[3]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            other = _fingerprints(changed, n, bins, bits)
            text = [dict(zip([i for i, f in enumerate(x) if f is not None], packed(np.stack([f for f in x if f is not None]), bits), strict=True)) if any(f is not None for f in x) else {} for x in (own, other)]
            k = range(len(changed))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows[:-1]], pa.int64()),
                    pa.array([len(r[3]) for r in rows[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([text[0].get(i, "") for i in k]),
                    pa.array([text[1].get(i, "") for i in k]),
                    pa.array([likeness(own[i], other[i], bits) for i in k]),
                    pa.array([likeness(own[i], own[i + 1], bits) for i in k]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def _range_of(cuts: list[tuple[bool, int, int]], key):
    """The last cut that is not beyond the key, by a binary search inside one expression."""
    table = F.array(*(F.struct(F.lit(a).alias("known"), F.lit(b).cast("long").alias("doc_id"), F.lit(c).cast("long").alias("h")) for a, b, c in cuts))
    steps = [1 << b for b in range((len(cuts) - 1).bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0), F.get(table, F.lit(0))
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(F.get(table, i + s) <= key, i + s).otherwise(i))
    return at, table


def fingerprints(docs: DataFrame, words: int = SHINGLE, bins: int = BINS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, in which the next document's beginning replaces the last quarter.

    One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (``bins`` codes of ``bits`` bits in hex),
    near_edited, near_next (likeness to the edited text's and to the next document's fingerprint). Documents follow each
    other by id, those of one id by a hash of the text, null ids first; the last one's next is the first. ASCII letters
    count in lower case; a text of fewer words than a shingle is one shingle.

    A null text is empty. A text without words has an empty fingerprint, like (1.0) another such and unlike (0.0) all
    others. Rows that repeat an id and a text are each other's next but for one, and one task reads them. A single
    document is its own next. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = stored(base.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h", F.octet_length("text").cast("long").alias("size")), "keys")
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    ranges = min(n, RANGES, max(-(-size // RANGE), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = keys.repartitionByRange(ranges, "known", "doc_id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("known", "doc_id", "h")).alias("k"))
    cuts = sorted(tuple(r.k) for r in first.collect())  # one a range
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("h").alias("h"))
    at, table = _range_of(cuts, key)
    dealt = base.withColumn("key", key).withColumn("range", at)
    guest = F.when(F.col("key") == (F.get(table, F.col("range")) if len(cuts) > 1 else table), F.pmod(F.col("range") - 1, F.lit(len(cuts))))
    places = F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(True).alias("guest")))))
    rows = dealt.select("doc_id", "h", "text", F.explode(places).alias("p")).select("p.range", "p.guest", "doc_id", "h", "text")
    rows = rows.repartition(len(cuts), "range").sortWithinPartitions("range", "guest", "doc_id", "h")
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("range", "guest", "doc_id", "text").mapInArrow(_neighbours(words, bins, bits), result)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
