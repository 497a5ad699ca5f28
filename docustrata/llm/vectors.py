"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors lexicographically by 64 concatenated random hashes (signs of projections) and compares
every vector with the next ones in that order, a bounded window. Pairs that pass the exact
cosine are united within the task; only the edges of the resulting trees leave it, so a large group of
copies costs a row a vector. How far the order's prefixes reach beyond a vector's window tells the chance that a
pass misses a pair of it; passes go on with the vectors whose chance is still too high, until comparing all of those is
cheaper. Links are then counted exactly inside each component, block by block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import components, stored

#: Vectors ahead that each one is compared with in a pass; chance that all passes miss a pair at the threshold; passes sorted in one job; rows of a block of links, and of all pairs.
WINDOW, MISS, AT_ONCE, BLOCK, PAIRS = 64, 1e-4, 8, 512, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _units(kind: str):
    """Vectors as bytes of ``kind``, as they are, and a digest of each one's direction; null where a vector links with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            n = len(column)
            digest, unit = np.full(n, None, object), np.full(n, None, object)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                x = flat[offsets[rows][:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[good], x[good]
                if len(rows):
                    digest[rows] = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in _unit(x)]
                    unit[rows] = [v.tobytes() for v in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "digest", "unit"])

    return run


def _matrix(column, kind: str) -> np.ndarray:
    """Unit vectors as doubles."""
    return _unit(np.stack([np.frombuffer(x.as_buffer(), kind) for x in column]))


def _keyed(passes: list[int], seed: int, kind: str):
    """One row per vector and pass, with its sort key."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            size = np.array([len(x.as_buffer()) for x in batch.column("unit")])
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                x = _matrix(part.column("unit"), kind)
                for p in passes:
                    if (p, n) not in planes:
                        planes[p, n] = np.random.default_rng([seed, p, int(n)]).normal(size=(x.shape[1], 64))
                    key = np.packbits(x @ planes[p, n] > 0, axis=1).view(">i8").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(np.full(len(x), n, np.int32)), pa.array(key), part.column("digest"), part.column("unit")], ["pass", "size", "key", "digest", "unit"])

    return run


def _shared(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Leading bits that two arrays of keys have in common."""
    x = np.ascontiguousarray(key ^ other).view(np.uint64)
    n = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        clear = x < np.uint64(1 << (64 - step))
        n[clear] += step
        x = np.where(clear, x << np.uint64(step), x)
    return np.where(key == other, 64, n)


def _log_miss(group: np.ndarray, key: np.ndarray, window: int, same: float) -> np.ndarray:
    """Of rows in order, but the first and last ``window``: log of the chance that a pair at the threshold is not met.

    A pair that shares one bit more than a vector does with the window's ends on both sides is met, any pair where the
    group ends inside the window. Nothing is promised where all 64 bits are shared.
    """
    shared = np.where((group[:, window:] == group[:, :-window]).all(axis=0), _shared(key[:-window], key[window:]), -1)
    bits = np.maximum(shared[window:], shared[:-window])
    return np.where(bits < 64, np.log1p(-np.minimum(same ** (bits + 1.0), 1 - 1e-9)), 0.0)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a bipartite table of links, each row and column spread once."""
    rows, columns, out = near.any(axis=1), near.any(axis=0), []
    while rows.any():
        first = int(np.argmax(rows))
        rows[first] = False
        todo = [(0, first)]
        while todo:
            side, i = todo.pop()
            left = columns if side == 0 else rows
            new = np.flatnonzero((near[i] if side == 0 else near[:, i]) & left)
            left[new] = False
            out += [(i, j) if side == 0 else (j, i) for j in new.tolist()]
            todo += [(1 - side, j) for j in new.tolist()]
    return out


def _all_pairs(least: float, kind: str):
    """Edges of a spanning forest of the verified pairs between two blocks."""

    def run(table: pa.Table) -> pa.Table:
        u, v = [], []
        side, first, second = (table.column(c).to_numpy() for c in ("block", "first", "second"))
        digest = table.column("digest").to_pylist()
        i, j = np.flatnonzero(side == first), np.flatnonzero(side == second)
        if len(i) and len(j):
            x = _matrix(table.column("unit"), kind)
            right = x[j].T
            near = np.concatenate([x[i[at : at + 256]] @ right >= least for at in range(0, len(i), 256)])
            if first[0] == second[0]:
                np.fill_diagonal(near, False)
            for a, b in _forest(near):
                u.append(digest[i[a]])
                v.append(digest[j[b]])
        return pa.table({"a": pa.array(u, pa.binary()), "b": pa.array(v, pa.binary())})

    return run


def _trees(window: int, least: float, same: float, kind: str):
    """Edges of a spanning forest of the verified pairs among neighbours in sort order; rows without b hold a vector's log chance of a miss."""

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            begun = 0 if held is None else len(held)
            order = np.stack([table.column(c).to_numpy() for c in ("pass", "size")])
            digest = table.column("digest").to_pylist()
            parent = list(range(len(table)))

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            out = []
            cuts = [0, *(np.flatnonzero((order[:, 1:] != order[:, :-1]).any(axis=0)) + 1), len(table)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x = _matrix(table.column("unit").slice(a, b - a), kind)
                for at in range(0, b - a, 256):
                    rows, ahead = x[at : at + 256], x[at : at + 256 + window]
                    i, j = np.nonzero(rows @ ahead.T >= least)
                    for p, q in zip(i + at + a, j + at + a, strict=True):
                        if p < q <= p + window and q >= begun and (s := root(p)) != (t := root(q)):
                            parent[max(s, t)] = min(s, t)
                            out.append((digest[p], digest[q], 0.0))
            if len(table) > 2 * window:  # the ends of a range are left out: nothing is promised there
                chance = _log_miss(order, table.column("key").to_numpy(), window, same)
                out += zip(digest[window:-window], [None] * len(chance), chance.tolist(), strict=True)
            if out:
                u, v, w = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(w, pa.float64())], ["a", "b", "chance"])
            held = table.slice(max(0, len(table) - 2 * window))

    return run


def _degrees(least: float, kind: str):
    """Of one pair of blocks: how many other vectors each one links with."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int]] = []
        root = np.array(table.column("root").to_pylist(), object)
        side = table.column("block").to_numpy()
        first, second = table.column("first").to_numpy(), table.column("second").to_numpy()
        digest = np.array(table.column("digest").to_pylist(), object)
        copies = table.column("copies").to_numpy()
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            x = _matrix(table.column("unit").take(pa.array(own)), kind)
            i, j = side[own] == first[own], side[own] == second[own]
            near = x[i] @ x[j].T >= least
            if first[own[0]] == second[own[0]]:
                np.fill_diagonal(near, False)
                out += zip(digest[own], near @ copies[own], strict=True)
            else:
                out += zip(digest[own][i], near @ copies[own][j], strict=True)
                out += zip(digest[own][j], near.T @ copies[own][i], strict=True)
        return pa.table({"digest": pa.array([d for d, _ in out], pa.binary()), "n": pa.array([int(n) for _, n in out], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, window: int = WINDOW, miss: float = MISS, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors with a cosine of ``least`` or more, in double precision.

    One row per input row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id). Passes go on for every vector until, by the density
    measured around it, a pair at the threshold is missed with probability ``miss`` at most; nothing below the
    threshold is linked.
    Equal directions are one class and count as often as they occur. Counting a component of m classes
    takes m * m / BLOCK rows: exact counts of a group's links are quadratic by nature.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
    vectors of different lengths with each other. Rows that repeat an id are ordinary rows. A null id is
    never the smallest. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    # single-precision vectors travel as they are, half the bytes; they are made unit vectors in double precision wherever they are compared
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    all_ = stored(base.mapInArrow(_units(kind), "vec_id long, digest binary, unit binary"), "units")
    cls = stored(all_.where("digest is not null").groupBy("digest").agg(F.any_value("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")
    count = cls.count()
    same, enough, passes, left = 1 - math.acos(least) / math.pi, math.log(miss), 0, count
    edges = spark.createDataFrame([], "a binary, b binary")
    size = F.octet_length("unit").alias("size")
    state = cls.select("digest", F.lit(0.0).alias("chance"))
    while left:
        rest = cls.select("digest", "unit") if left == count else cls.select("digest", "unit").join(state, "digest", "left_semi")
        keyed = rest.mapInArrow(_keyed(list(range(passes, passes + AT_ONCE)), seed, kind), "pass int, size int, key long, digest binary, unit binary")
        parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), left * AT_ONCE // 4096), 1)
        found = keyed.repartitionByRange(parts, "pass", "size", "key", "digest").sortWithinPartitions("pass", "size", "key", "digest").mapInArrow(_trees(window, least, same, kind), "a binary, b binary, chance double")
        found = stored(found, "edges")
        passes += AT_ONCE
        edges = edges.unionByName(found.where("b is not null").select("a", "b"))
        gained = found.where("b is null").groupBy("a").agg(F.sum("chance").alias("gained"))
        state = stored(state.join(gained, F.col("digest") == F.col("a"), "left").select("digest", (F.col("chance") + F.coalesce("gained", F.lit(0.0))).alias("chance")).where(F.col("chance") > enough), "open")
        left, got = state.agg(F.count("*"), F.avg("chance")).first()
        if left and left <= max(4 * PAIRS, 1024 * (passes * (enough / min(got, -1e-9) - 1))):  # passes to come at this pace, a thousand comparisons' time each
            blocks = math.ceil(left / PAIRS)
            rest = cls.join(state, "digest", "left_semi").select("digest", "unit", size, F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int").alias("block"))
            pair = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("digest", "unit", "size", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
            edges = edges.unionByName(stored(pair.groupBy("size", "first", "second").applyInArrow(_all_pairs(least, kind), "a binary, b binary"), "edges"))
            left = 0
    label = components(edges)
    sized = label.groupBy("root").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    member = label.join(sized, "root").join(cls, F.col("node") == F.col("digest")).select("root", "digest", "unit", "copies", "blocks", F.pmod(F.xxhash64("digest"), "blocks").cast("int").alias("block"))
    pair = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    group = F.when(F.col("blocks") > 1, F.xxhash64("root", "first", "second")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(64, count // 4096))))
    pair = pair.withColumn("g", group).withColumn("many", F.col("blocks") > 1)
    linked = pair.select("g", "many", "root", "digest", "unit", "copies", "block", "first", "second").groupBy("g", "many", "first", "second").applyInArrow(_degrees(least, kind), "digest binary, n long")
    linked = linked.groupBy("digest").agg(F.sum("n").alias("others"))
    top = label.join(cls.select("digest", "least"), label.node == F.col("digest")).groupBy("root").agg(F.min("least").alias("smallest"))
    named = label.join(top, "root").select(F.col("node").alias("digest"), "smallest")
    out = all_.select("vec_id", "digest").join(cls.select("digest", "copies", "least"), "digest", "left").join(linked, "digest", "left").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_vectors(spark, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept at a cosine of 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id, vec_id AS reach FROM v
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(reach) AS component_id, r.vec_id = min(reach) AS kept
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""
