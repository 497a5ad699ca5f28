"""MinHash near-dedup: fast similarity sketches, banding and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup 2017) throws every shingle into one of ``t`` bins per round;
round i adds i to the value, so a bin keeps the earliest round that reached it, and rounds t..2t-1 aim at
one bin each: every coordinate fills, with concentration as for t independent hash functions.

Texts with the same shingles form a class. Classes meet in bands of the sketch; each class is first
compared with the smallest class of every bucket, which joins a group of copies without listing its
pairs. Classes that are still apart from their bucket's smallest after that are compared with all of the
bucket, so no pair that shares a bucket goes unchecked. A bitmap of each set bounds the
intersection from above inside the joins: of two sets, at least as many members are not shared as there are bits set in one
bitmap only. Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import components, stored
from .words import Words, mix, texts

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M64 = (1 << 64) - 1
#: Bits of the bitmap of a set; classes of a bucket that one task compares with others of the bucket.
BITS, BLOCK = 1024, 4096


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and their rows, by row; a row of 1 to n-1 words has its whole sequence as one."""
    h, at = w.windows(n)
    rows = w.rows()
    row = rows[at] if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(w.first)
    for k in range(1, n):
        if (own := np.flatnonzero(sizes == k)).size:
            x, a = w.windows(k)
            pick = np.isin(rows[a], own)
            h = np.concatenate([h, mix(x[pick] + np.uint64(k))])
            row = np.concatenate([row, rows[a][pick]])
    return h, row


def _sets(w: Words, n: int) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted."""
    h, row = _shingles(w, n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return np.split(h, np.searchsorted(row, np.arange(1, len(w.first) - 1)))


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: len(sets) x t values."""
    out = np.full(len(sets) * t, np.uint64(2**64 - 1))
    base = np.repeat(np.arange(len(sets)) * t, [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(h):
            break
        x = mix(h + np.uint64((i + 1) * int(_GOLD) & _M64))
        value = (np.uint64(i) << np.uint64(48)) | (x & np.uint64((1 << 48) - 1))
        bins = ((x >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, base + bins, value)
        if i >= t or i < 8 or i % 4 == 0:
            open_ = (out.reshape(-1, t) == np.uint64(2**64 - 1)).any(axis=1)
            left = open_[base // t]
            if not left.all():
                h, base = h[left], base[left]
    return out.reshape(-1, t)


def _bands(values: np.ndarray, rows: int) -> np.ndarray:
    s = values.reshape(len(values), -1, rows)
    key = np.broadcast_to(np.arange(s.shape[1], dtype=np.uint64) * _GOLD, s.shape[:2])
    for j in range(rows):
        key = mix(key + s[:, :, j] * _GOLD + np.uint64(j + 1))
    return key.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, bool)
    out[(mix(s ^ _GOLD) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).view(np.int64)


def _signs(values: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate of the sketches, as rows of four 64-bit integers and more."""
    bits = (values & np.uint64(1)).astype(bool)
    width = -(-bits.shape[1] // 64) * 64
    return np.packbits(np.pad(bits, ((0, 0), (0, width - bits.shape[1]))), axis=1).view(np.int64)


def _sized(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _may_link(n, m, x, y, percent: int):
    """Whether two sets of n and m members with bitmaps x and y can reach the similarity: what they share is at most n less the bits of x only."""
    lacking = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda t, c: t + c)
    enough = lambda k, p, q: (100 + percent) * (k - lacking(p, q)) >= percent * (n + m)
    return enough(n, x, y) & enough(m, y, x)


def _signs_agree(x, y, t: int, percent: int):
    """Whether two rows of signs disagree no more often than six standard deviations over what the similarity gives (chance under 1e-7)."""
    q = (1 - percent / 100) / 2
    most = math.floor(t * q + 6 * math.sqrt(t * q * (1 - q)))
    apart = None
    for a, b in zip(x, y, strict=True):
        one = F.bit_count(a.bitwiseXOR(b))
        apart = one if apart is None else apart + one
    return apart <= most


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                sets = _sets(Words(data, offsets, lower=True), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, signs = [None] * len(sets), [None] * len(sets)
                if full:
                    values = sketch([sets[i] for i in full], bands * rows)
                    for i, k, g in zip(full, _bands(values, rows), _signs(values), strict=True):
                        keys[i], signs[i] = k, g
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([_bitmap(s) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "digest", "bands", "bits", "signs"],
                )

    return run


def _full_sets(n: int):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in texts(batch.column("text")):
                sets = _sets(Words(data, offsets, lower=True), n)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "members"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups texts linked by 100 * intersection >= percent * union of their distinct word shingles.

    ASCII letters are lower-cased. One row for each input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable), kept (doc_id = component_id), digest (of the shingle set), text_hash (xxhash64 of the text). With the
    default bands a pair at exactly 0.8 is missed with probability 3e-6, one at 0.85 with 1e-9.

    A null or wordless text has no shingles, links with nothing and is its own component. Rows that
    repeat an id and text are each returned; of rows that share the smallest id, all count as kept.
    A null id is never the smallest; a group of null ids only has a null component and is kept.
    An empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signatures(words, bands, rows), "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, bits array<long>, signs array<long>"), "signatures")
    full = sig.where("n_shingles > 0")
    least = full.groupBy("digest").agg(F.min("doc_id").alias("i")).withColumnRenamed("digest", "d")
    # of each class the row with the smallest id; rows may repeat, so once more by digest
    own = full.join(least, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    cls = stored(own.groupBy("digest").agg(*(F.any_value(c).alias(c) for c in ("n_shingles", "bands", "bits", "signs"))), "classes")
    bits = cls.select("digest", F.col("n_shingles").alias("n"), "bits")
    posts = cls.select("digest", F.explode("bands").alias("band"))
    heads = posts.groupBy("band").agg(F.min("digest").alias("head"), F.count("*").alias("c")).where("c > 1").select("band", "head")
    met = stored(posts.join(heads, "band"), "met")
    star = met.where("digest <> head").select(F.col("digest").alias("a"), F.col("head").alias("b")).distinct()
    star = star.join(bits.select(F.col("digest").alias("a"), F.col("n"), F.col("bits").alias("x")), "a")
    star = star.join(bits.select(F.col("digest").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    star = stored(star.where(_sized(F.col("n"), F.col("m"), percent) & _may_link(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)).select("a", "b"), "star")
    links = stored(_verified(base, sig, star, words, percent), "links")
    label = components(links)
    # classes that are not in the component of their bucket's smallest, against all of the bucket
    named = met.join(label.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = named.join(label.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head", "left").withColumn("major", F.col("root") == F.coalesce("head_root", "head"))
    mixed = named.groupBy("band").agg(F.count_if(~F.col("major")).alias("n_apart"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("n_apart > 0").select("band", "blocks", F.ceil(F.col("n_apart") / BLOCK).cast("int").alias("rows"))
    words_ = -(-bands * rows // 64)
    wide = cls.select("digest", F.col("n_shingles").alias("n"), "bits", "bands", *(F.get("signs", F.lit(i)).alias(f"s{i}") for i in range(words_)))
    apart = stored(named.join(mixed, "band").join(wide, "digest").select("band", "blocks", "rows", "digest", "root", "major", "n", "bits", "bands", *(f"s{i}" for i in range(words_))), "apart")
    # a bucket and its classes that are apart are both dealt in blocks, and each pair of blocks meets by itself: no task has more than
    # BLOCK classes of either side, however large the bucket
    dealt = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.where("not major").withColumn("row", dealt("rows")).select("band", "row", every("blocks").alias("block"), F.col("digest").alias("a"), F.col("root").alias("p"), "n", F.col("bits").alias("x"), F.col("bands").alias("u"), *(F.col(f"s{i}").alias(f"g{i}") for i in range(words_)))
    right = apart.withColumn("block2", dealt("blocks")).select(F.col("band").alias("band2"), every("rows").alias("row2"), "block2", F.col("digest").alias("b"), F.col("root").alias("q"), F.col("n").alias("m"), F.col("bits").alias("y"), F.col("bands").alias("v"), "major", *(f"s{i}" for i in range(words_)))
    # cheap tests first; a pair is taken in the first band that it shares
    first = F.get(F.filter(F.zip_with("u", "v", lambda c, d: F.when(c == d, c)), lambda c: c.isNotNull()), F.lit(0)) == F.col("band")
    n, m = F.col("n"), F.col("m")
    same = _signs_agree([F.col(f"g{i}") for i in range(words_)], [F.col(f"s{i}") for i in range(words_)], bands * rows, percent)
    rest = left.join(right, (F.col("band") == F.col("band2")) & (F.col("block") == F.col("block2")) & (F.col("row") == F.col("row2")) & (F.col("p") != F.col("q")) & (F.col("major") | (F.col("a") > F.col("b"))) & _sized(n, m, percent) & same & first & _may_link(n, m, F.col("x"), F.col("y"), percent))
    rest = stored(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "rest")
    more = _verified(base, sig, rest, words, percent)
    label = components(stored(links.unionByName(more), "links"))
    root = sig.join(label, sig.digest == label.node, "left").select("doc_id", "text_hash", "n_shingles", "digest", "root")
    smallest = root.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    single = full.groupBy("digest").agg(F.min("doc_id").alias("own"))
    out = root.join(smallest, "root", "left").join(single, "digest", "left")
    least = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "own"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"), "digest", "text_hash")


def _verified(base: DataFrame, sig: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    ids = sig.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("i")).select("i").distinct()
    sets = base.join(ids, F.col("doc_id").eqNullSafe(F.col("i")), "left_semi").select("text").mapInArrow(_full_sets(words), "digest binary, members binary")
    sets = stored(sets.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value("members").alias("members")), "sets")
    left = sets.select(F.col("digest").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept for shingles of four words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS x FROM d WHERE len(w) > 0
  )
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS reach FROM d
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach
), c AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
