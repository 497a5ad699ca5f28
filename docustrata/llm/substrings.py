"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Each document is dealt to a group of bounded size by a hash of its id and text.
2. Every task hashes all windows of its texts and sends, for each range of hash values, one
   sorted run of (hash, group) pairs; a hash met again in the same task and group is sent twice at most.
3. Each range is merged by itself: hashes seen at least twice go back to the groups that hold them.
4. Each group hashes its texts again, marks the words under a returned hash and merges them into
   maximal intervals. Its hashes come first, then its texts in batches, so a group of any size fits a task.

A frequent window costs a task one or two entries per group, however often it occurs, so no key is hot;
ranges and groups grow in number with the input, not in size. Nothing passes through the driver
but the byte count of the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored
from .words import Words, covered, texts

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>, kept_sha256 string"
#: Hash pairs merged at a time by a task that counts, bytes of text per group, and pairs held by a task that hashes.
RANGE_PAIRS, GROUP_BYTES, RUN_PAIRS = 1 << 20, 2 << 20, 3 << 20
#: Tasks of one job, at most; ranges and groups beyond it follow one another in a task.
MOST_TASKS = 1 << 16


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, highest first: sorted integers then compress well."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind.newbyteorder(">")).ravel().astype(kind)


def _window_runs(n: int, ranges: int):
    """Sorted runs of (hash, group) for each range of hashes."""

    def cut(held):
        h, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        third = again.copy()
        third[1:] &= again[:-1]
        h, g = h[~third], g[~third]
        part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        at = np.searchsorted(part, np.arange(ranges + 1).astype(np.uint64))
        for r in np.flatnonzero(np.diff(at)):
            a, b = at[r], at[r + 1]
            yield int(r), _planes(h[a:b]), _planes(g[a:b])

    def emit(rows):
        k, h, g = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.binary()), pa.array(g, pa.binary())], ["range", "hashes", "groups"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False).astype(np.uint32)
            for a, b, data, offsets in texts(batch.column("text")):
                w = Words(data, offsets)
                h, at = w.windows(n)
                if len(h):
                    held.append((h, group[a:b][w.rows()[at]]))
                    count += len(h)
                if count >= RUN_PAIRS:
                    yield emit(list(cut(held)))
                    held, count = [], 0
        if held:
            yield emit(list(cut(held)))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one range: the hashes that occur at least twice, by the group that holds them."""
    h = np.concatenate([_unplanes(x.as_py(), np.uint64) for x in table.column("hashes")])
    g = np.concatenate([_unplanes(x.as_py(), np.uint32) for x in table.column("groups")])
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    h, g = h[twice], g[twice]
    order = np.lexsort((h, g))
    h, g = h[order], g[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g = h[fresh], g[fresh]
    own, at = np.unique(g, return_index=True)
    return pa.table({"group": pa.array(own.astype(np.int32)), "hashes": pa.array([x.tobytes() for x in np.split(h, at[1:])] if len(own) else [], pa.binary())})


def _cut(n: int, with_text: bool, batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of one group without the words under a window whose hash is in ``gone`` (sorted)."""
    out = {k: [] for k in ("n_words", "n_removed", "kept_text", "spans", "kept_sha256")}
    for _, _, data, offsets in texts(batch.column("text")):
        w = Words(data, offsets)
        h, at = w.windows(n)
        if len(gone) and len(h):
            found = np.minimum(np.searchsorted(gone, h), len(gone) - 1)
            marked = covered(at[gone[found] == h], n, len(w.hash))
        else:
            marked = np.zeros(len(w.hash), bool)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            a, b = w.first[i], w.first[i + 1]
            drop = marked[a:b]
            words = raw[offsets[i] : offsets[i + 1]].split()
            edge = np.flatnonzero(np.diff(drop.view(np.int8), prepend=0, append=0))
            kept = words
            text = raw[offsets[i] : offsets[i + 1]]
            if len(edge):
                kept = [x for x, y in zip(words, drop.tolist(), strict=True) if not y]
                pieces, done = [], offsets[i]
                for s, e in edge.reshape(-1, 2):
                    pieces.append(raw[done : w.start[a + s]])
                    done = w.start[a + e] if a + e < b else offsets[i + 1]
                text = b"".join([*pieces, raw[done : offsets[i + 1]]])
            out["n_words"].append(int(b - a))
            out["n_removed"].append(int(drop.sum()))
            out["kept_text"].append(text if with_text else None)
            out["spans"].append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
    kept_text = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
    spans = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    rest = [c for c in batch.schema.names if c.startswith("_keep_")]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), kept_text, spans, pa.array(out["kept_sha256"], pa.string()), *(batch.column(c) for c in rest)],
        names=["doc_id", "n_words", "n_removed", "kept_text", "spans", "kept_sha256", *rest],
    )


def _removal(n: int, with_text: bool):
    """Rows sorted by group, each group's hashes before its texts: a task holds the hashes of one group and one batch of texts, however many rows the group has."""

    def run(batches):
        now, held, gone = None, [], None
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            a_text = batch.column("a_text").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(group) != 0) | (a_text[1:] != a_text[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)], strict=True):
                if a == b:
                    continue
                if group[a] != now:
                    now, held, gone = group[a], [], None
                part = batch.slice(a, b - a)
                if a_text[a]:
                    if gone is None:
                        gone, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *held])), []
                    yield _cut(n, with_text, part, gone)
                else:
                    held.extend(np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("hashes"))

    return run


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Marks every word under a window of ``window`` words that also starts anywhere else, in the same text or another.

    Windows are judged on the input. One row for each input row: doc_id, n_words, n_removed,
    kept_text (the text without the removed words, other white space as it was; null unless
    ``with_text``), spans (maximal removed intervals, as word numbers), kept_sha256 (of the kept words
    joined by one space), and the columns named in ``keep``, unchanged.

    A null text has no words, and its kept_text is empty. Null or repeated ids are ordinary rows; two
    equal rows repeat each other. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, size // GROUP_BYTES)
    ranges = max(16, size // 6 // RANGE_PAIRS)
    dealt = base.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    runs = dealt.select("text", "group").mapInArrow(_window_runs(window, ranges), "range int, hashes binary, groups binary")
    back = stored(runs.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(_repeated, "group int, hashes binary"), "repeats")
    schema = SCHEMA + "".join(f", `_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    tasks = min(max(8, groups // 4), MOST_TASKS)  # four groups each, whatever the session's number of partitions
    none = lambda c: F.lit(None).cast(dealt.schema[c].dataType).alias(c)
    own = [c for c in dealt.columns if c != "group"]
    hashes = back.select("group", F.lit(False).alias("a_text"), *map(none, own), "hashes")
    whole = dealt.select("group", F.lit(True).alias("a_text"), *own, F.lit(None).cast("binary").alias("hashes"))
    out = hashes.unionAll(whole).repartition(tasks, "group").sortWithinPartitions("group", "a_text").mapInArrow(_removal(window, with_text), schema)
    return out.withColumnsRenamed({f"_keep_{c}": f"{c}" for c in keep if c not in ("doc_id",)})


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 for windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM s
), r AS (
  SELECT doc_id, i FROM h WHERE x IN (SELECT x FROM h GROUP BY x HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r
), l AS (
  SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.w, list_filter(list_transform(d.w, lambda x, j: CASE WHEN list_contains(l.ks, j) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept
  FROM d JOIN l USING (doc_id)
  UNION ALL SELECT doc_id, w, w FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
