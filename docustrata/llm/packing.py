"""Mixture-controlled packing: deficit round-robin over source queues.

The texts of each source form a queue of tokens. A window grants every queue its target share of tokens; what
rounding withholds is carried to the next window, so after t windows a queue has been served
floor(N(t) * W(k)) - floor(N(t) * W(k - 1)) tokens, W being running sums of the shares: within one token of its
target in every window and at any time. The place of a token follows from its number in its queue alone: deficits pass
from window to window and from partition to partition without any task waiting for another or holding a queue.

Sources of less than a SMALLEST-th share are too many to be listed in a task, and would be cut to crumbs. They
share a queue of units of one quantum, in the order in which each one's unit is due, (unit + 1/2) / weight; the
shared queue takes whole units, carries its own deficit under one unit, and what it leaves of a window (N) is dealt to the others.

Where a queue can't fill its share any more the others go on in proportion. What then is left, less than one window's
share of each queue, follows one another and is cut into sequences whose lengths are powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stored
from .words import runs

_kept: dict[str, "_Encoder"] = {}
_MARK = re.compile(rb"(?<=[a-z0-9])([.,;:!?])(?=[\x20\x09-\x0D]|$)")


# classes of bytes: a letter or digit below U+0100 or part of one, white space, one of the marks, w what may be neither, x anything else
_CLASS = bytearray(b"x" * 256)
for _b in range(256):
    if chr(_b).isalnum() and _b < 0x80 or 0x80 <= _b <= 0xBF and _b not in (0x97, 0xB7) or _b == 0xC3:
        _CLASS[_b] = ord("a")
    elif _b in b" \t\n\x0b\x0c\r":
        _CLASS[_b] = ord(" ")
    elif _b in b".,":
        _CLASS[_b] = ord(".")
    elif _b >= 0x80:
        _CLASS[_b] = ord("w")
_CLASS = bytes(_CLASS)


def _parted(t: bytes) -> list[bytes]:
    """Chunks of a text at white space and before marks that end a word.

    Letter case is lost anyway, and a mark after a letter or digit is a piece of its own. Neither holds in
    what may be a special token. A plain replacement does where marks follow letters below U+0100 only.
    """
    if b"<|" in t:
        return t.split()
    t, kinds = t.lower(), t.translate(_CLASS)
    if b"w" in kinds or b"x." in kinds or b".." in kinds:
        return _MARK.sub(rb" \1", t).split()
    return t.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").split()


#: What the chunked way relies on, as the tokenizer's file states it: letter case and white space are lost, pieces are runs of one class.
_NORMALISED = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of chunks a worker remembers before it starts anew, an entry counting ENTRY besides its text and ids; bytes of text encoded at once.
REMEMBERED, ENTRY, AT_ONCE = 64 << 20, 180, 1 << 20


def parts_at_space(path: str) -> bool:
    """Whether the tokenizer's file says that its pieces, in lower case, never reach over white space or from a letter to a mark."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split, model = pieces[0], spec["model"]
    plain = split.get("type") == "Split" and split.get("pattern") == {"Regex": _PIECES} and split.get("behavior") == "Removed" and split.get("invert")
    level = len(pieces) == 2 and pieces[1].get("type") == "ByteLevel" and not pieces[1].get("add_prefix_space") and not pieces[1].get("use_regex")
    ids = [*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]
    marked = all(t["content"].startswith("<|") for t in spec["added_tokens"])
    return bool(kinds == _NORMALISED and plain and level and marked and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and max(ids) < 1 << 16)


class _Encoder:
    """Ids of texts as little-endian integers of ``kind``.

    Where the tokenizer parts at white space, each distinct chunk is encoded once per worker, up to a bound in
    bytes. Plain words (letters below U+0130) go to the tokenizer many at a time: each is one piece of
    the splitting pattern, and its last token is the only one that carries the mark of a word's end. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunked = parts_at_space(path)
        self.kind = "<u2" if self.chunked else "<u4"
        self.remembered, self.held, self.known = remembered, 0, {}
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, chunks: list[str]) -> list[bytes]:
        code = "H" if self.chunked else "I"
        return [array(code, e.ids).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint16)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += self._encode([w.decode() for w in part])
                continue
            raw, cuts = ids.tobytes(), [0, *(2 * cuts).tolist()]
            out += [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, chunks: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(chunks, ids, strict=True))
        self.held += sum(map(len, chunks)) + sum(map(len, ids)) + ENTRY * len(chunks)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        if not self.chunked:
            return [x for t in texts for x in self._encode([t.decode()])]
        cut = [_parted(t) for t in texts]
        if self.held > self.remembered:
            self.known, self.held = {}, 0
        known, keys = self.known, set()
        for words in cut:
            keys.update(words)
        new = keys.difference(known)
        plain = [k for k in new if k.isalpha()]
        rest = [k for k in new if not k.isalpha()]
        letters = [(s := k.decode()).isalpha() and max(s) < "\u0130" for k in rest]
        plain += [k for k, yes in zip(rest, letters, strict=True) if yes]
        rest = [k for k, yes in zip(rest, letters, strict=True) if not yes]
        self._learn(plain, self._encode_words(plain))
        self._learn(rest, self._encode([k.decode() for k in rest]))
        return [b"".join(map(known.__getitem__, words)) for words in cut]


def encoder(path: str) -> _Encoder:
    if path not in _kept:
        _kept[path] = _Encoder(path)
    return _kept[path]


def _tokens(path: str, end: int):
    """Ids of each text with the end id, and where they begin among those that this task has for their queue."""

    def run(batches):
        enc, served, task = encoder(path), {}, TaskContext.get().partitionId()
        tail = np.array([end], enc.kind).tobytes()
        width = len(tail)
        for batch in batches:
            for a, b, texts in runs(batch.column("text"), AT_ONCE):
                ids = [x + tail for x in enc.ids([t or b"" for t in texts])]
                many, inside = [len(x) // width for x in ids], []
                for queue, n in zip(batch.column("queue").slice(a, b - a).to_pylist(), many, strict=True):
                    inside.append(served.get(queue, 0))
                    served[queue] = inside[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("queue").slice(a, b - a), pa.array(np.full(b - a, task, np.int32)), pa.array(inside, pa.int64()), pa.array(ids, pa.binary()), pa.array(many, pa.int64())],
                    ["doc_id", "queue", "task", "inside", "ids", "n"],
                )

    return run


#: Shares are whole numbers of 1 / SCALE; a queue under a SMALLEST-th of all (or under 4 tokens a quantum) joins the shared queue.
SCALE, SMALLEST = 1 << 28, 64


@dataclass
class Phase:
    """Windows from ``first`` on, ``windows`` in number, in which the same queues are served: ``order`` with running sums ``sums`` of their shares, and ``rare`` units of the shared queue a window (times SCALE)."""

    stage: int
    first: int
    order: list[int]
    sums: list[int]
    rare: int
    window: int
    quantum: int
    windows: int = 0
    served: dict[int, int] = field(default_factory=dict)  # tokens of each queue before this phase
    units: int = 0  # units of the shared queue before it

    def shared(self, t):
        """Units of the shared queue in the first t windows. Written so that 64 bits suffice, as numbers or arrays."""
        return t // SCALE * self.rare + (t % SCALE * self.rare + SCALE - 1) // SCALE

    def below(self, t, i: int):
        """Tokens of the first i queues in the first t windows."""
        n = self.window * t - self.quantum * self.shared(t)
        return n // SCALE * self.sums[i] + n % SCALE * self.sums[i] // SCALE

    def tokens(self, t, i: int):
        return self.below(t, i + 1) - self.below(t, i)


def _last(f, bound, low, high):
    """Largest t of low..high with f(t) <= bound, f rising; numbers or arrays."""
    low, high = np.zeros_like(bound) + low, np.zeros_like(bound) + high
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = f(mid) <= bound
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def phases(stages: list[tuple[dict[int, tuple[int, int]], tuple[int, int]]], window: int, quantum: int) -> tuple[list[Phase], dict[int, int], list[int]]:
    """The phases of each stage in turn; a stage is {queue: (tokens, weight)} and (units, weight) of its shared queue.

    Also how many tokens of every queue, and how many units of each stage's shared queue, the windows take.
    """
    out: list[Phase] = []
    served: dict[int, int] = {}
    shared: list[int] = []
    first = 0
    for stage, (queues, (units, rare_weight)) in enumerate(stages):
        left, taken = {k: n for k, (n, _) in queues.items()}, 0
        served |= dict.fromkeys(queues, 0)
        while left or units > taken:
            rare = rare_weight if units > taken else 0
            all_ = sum(queues[k][1] for k in left)
            if not all_ and not rare:
                break
            order, sums = sorted(left), [0]
            for k in order:
                sums.append(sums[-1] + queues[k][1])
            p = Phase(stage, first, order, [SCALE * s // all_ for s in sums] if all_ else [0], window // quantum * SCALE * rare // (all_ + rare), window, quantum, 0, dict(served), taken)
            low, high = 0, (sum(left.values()) + quantum * (units - taken)) // window
            fits = lambda n, p=p, order=order, left=left, free=units - taken: p.shared(n) <= free and all(p.tokens(n, i) <= left[k] for i, k in enumerate(order))
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(mid) else (low, mid - 1)
            p.windows = low
            lacking = [k for i, k in enumerate(order) if p.tokens(low + 1, i) > left[k]]
            ends = p.shared(low + 1) > units - taken
            for i, k in enumerate(order):
                served[k] += p.tokens(low, i)
                left[k] -= p.tokens(low, i)
            taken += p.shared(low)
            first += low
            if low:
                out.append(p)
            for k in lacking:
                del left[k]
            if ends:
                rare_weight = 0
            if not lacking and not ends:
                break
        shared.append(taken)
    return out, served, shared


def _tail(p: int, total: int, window: int) -> tuple[int, int, int]:
    """Sequence, offset and length of the sequence that holds token p of a tail: whole windows, then falling powers of two."""
    whole = total // window
    if p < whole * window:
        return p // window, p % window, window
    p, rest, i = p - whole * window, total % window, whole
    size = window
    while True:
        size >>= 1
        if rest & size:
            if p < size:
                return i, p, size
            p -= size
            i += 1


@dataclass
class Plan:
    """Where each queue's tokens go: the phases, then the tail from sequence ``first`` on."""

    window: int
    quantum: int
    phases: list[Phase]
    served: dict[int, int]  # tokens of each queue in the phases
    behind: dict[int, int]  # where the rest of each queue begins in the tail
    first: int
    tail: int

    def cut_tail(self, at: int, n: int):
        """(offset from ``at``, length, sequence, offset there) of n tokens from place ``at`` of the tail on."""
        done = 0
        while done < n:
            seq, to, size = _tail(at + done, self.tail, self.window)
            take = min(n - done, size - to)
            yield done, take, self.first + seq, to
            done += take

    def pieces(self, k: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows (number, start, length, sequence, offset) of intervals of queue k that begin at ``at``."""
        out = []
        for p in self.phases:
            if k not in p.order:
                continue
            i, begun = p.order.index(k), p.served[k]
            low, high = np.maximum(at - begun, 0), np.minimum(at + n - begun, p.tokens(p.windows, i))
            rows = np.flatnonzero(high > low)
            if not len(rows):
                continue
            low, high = low[rows], high[rows]
            count = lambda t, p=p, i=i: p.tokens(t, i)
            since, till = _last(count, low, 0, p.windows - 1), _last(count, high - 1, 0, p.windows - 1)
            many = till - since + 1
            own = np.repeat(np.arange(len(rows)), many)
            t = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + since[own]
            begin = count(t)
            a, b = np.maximum(low[own], begin), np.minimum(high[own], count(t + 1))
            to = self.quantum * (p.shared(t + 1) - p.shared(t)) + p.below(t + 1, i) - p.below(t, i) + a - begin
            out.append(np.stack([rows[own], a + begun - at[rows[own]], b - a, p.first + t, to], axis=1)[b > a])
        end = self.served[k]
        late = [(r, max(int(at[r]), end)) for r in np.flatnonzero(at + n > end)]
        out.append(np.array([(r, x - at[r] + d, take, seq, to) for r, x in late for d, take, seq, to in self.cut_tail(self.behind[k] + x - end, int(at[r] + n[r]) - x)], np.int64).reshape(-1, 5))
        return np.concatenate(out)


def _checked(ids: pa.Array, kind: str, cut: np.ndarray, doc: np.ndarray) -> pa.Array:
    """CRC-32 of ids ``cut[:, 1]`` to ``cut[:, 1] + cut[:, 2]`` of rows ``doc``, as 32-bit integers."""
    width = int(kind[-1])
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    wide = np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).astype("<u4")
    raw = memoryview(wide).cast("B")
    a = 4 * ((offsets[doc] - offsets[0]) // width + cut[:, 1])
    return pa.array([zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), (a + 4 * cut[:, 2]).tolist(), strict=True)], pa.int64())


def _slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """Parts of a batch of about ``most`` tokens."""
    end, at = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False)), 0
    while at < len(end):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _listed(plan: Plan, kind: str):
    """Pieces of the documents of the queues that every task knows."""

    def run(batches):
        for part in (p for batch in batches for p in _slices(batch)):
            k, at, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "at", "n"))
            got = [np.zeros((0, 5), np.int64)]
            for q in np.unique(k):
                rows = np.flatnonzero(k == q)
                cut = plan.pieces(int(q), at[rows], n[rows])
                cut[:, 0] = rows[cut[:, 0]]
                got.append(cut)
            cut = np.concatenate(got)
            doc = pa.array(cut[:, 0])
            col = lambda j, cut=cut: pa.array(np.ascontiguousarray(cut[:, j]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(doc), col(1), col(2), _checked(part.column("ids"), kind, cut, cut[:, 0]), part.column("n").take(doc), col(3), col(4)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def _by_unit(plan: Plan, kind: str, rests: int):
    """Pieces of the shared queue's documents by unit; those behind their source's whole units have their place in the tail, from ``rests`` on."""

    def run(batches):
        quantum = plan.quantum
        for part in (p for batch in batches for p in _slices(batch)):
            out: list[tuple[int, ...]] = []
            for i, (at, n, units, rest_at) in enumerate(zip(*(part.column(c).to_pylist() for c in ("at", "n", "units", "rest_at")), strict=True)):
                pos = 0
                while pos < n:
                    unit, inside = divmod(at + pos, quantum)
                    if unit >= units:
                        out += [(i, pos + d, take, n, seq, to, unit) for d, take, seq, to in plan.cut_tail(rests + rest_at + at + pos - units * quantum, n - pos)]
                        break
                    take = min(quantum - inside, n - pos)
                    out.append((i, pos, take, n, -1, inside, unit))
                    pos += take
            cut = np.array(out, np.int64).reshape(-1, 7)
            doc = pa.array(cut[:, 0])
            col = lambda j, cut=cut: pa.array(np.ascontiguousarray(cut[:, j]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(doc), part.column("queue").take(doc), col(1), col(2), _checked(part.column("ids"), kind, cut, cut[:, 0]), col(3), col(4), col(5), col(6)],
                ["doc_id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "unit"],
            )

    return run


def _unit_places(plan: Plan, units: list[int], taken: list[int]):
    """Sequence and offset of each unit, given its stage and its place among the units there. The ``units`` of a stage that are not ``taken`` open the tail."""
    late = [0, units[0] - taken[0]]

    def run(batches):
        for batch in batches:
            stage, slot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stage", "slot"))
            seq, to = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
            for p in plan.phases:
                rows = np.flatnonzero((stage == p.stage) & (slot >= p.units) & (slot < p.units + p.shared(p.windows)))
                if len(rows):
                    x = slot[rows] - p.units
                    t = _last(p.shared, x, 0, p.windows - 1)
                    seq[rows], to[rows] = p.first + t, plan.quantum * (x - p.shared(t))
            for i in np.flatnonzero(slot >= np.array(taken)[stage]):
                at, to[i], _ = _tail(int(slot[i] - taken[stage[i]] + late[stage[i]]) * plan.quantum, plan.tail, plan.window)
                seq[i] = plan.first + at
            yield pa.RecordBatch.from_arrays([batch.column("queue"), batch.column("unit"), pa.array(seq), pa.array(to)], ["queue", "unit", "unit_sequence", "unit_offset"])

    return run


def _running(df: DataFrame, order: list[str], value, name: str, tasks: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each one in ``order``, counted over sorted ranges."""
    df = stored(df.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), name)
    begin = df.groupBy("part").agg(F.sum(value).alias("many"))
    begin = begin.select("part", F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("inside", inside).join(begin, "part").withColumn(name, F.col("begin") + F.col("inside")).drop("part", "begin", "inside")


def pack(docs: DataFrame, path: str, end: int, window: int = 4096, quantum: int = 512, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Packs the ids of every whole text, then ``end``, into sequences of ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id lies in
    exactly one piece. Sequences are full, but for at most log2(window) at the end, whose lengths
    are powers of two. ``targets``: share of tokens by source (default: as in the corpus; sources that
    are not named come after the named ones, in their corpus shares, as do what queues hold that last longer than others, in the shares of those left).
    ``quantum`` (of the shared queue of small sources) divides ``window``, both powers of two. ``path``: a file of the library ``tokenizers``; texts
    are cut at white space only where the file says that this can't change an id.

    A null or empty text is the end id alone. A null source is a queue of its own. Repeated rows and null
    ids are packed each; other columns are ignored; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, "<u2" if parts_at_space(path) else "<u4"
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("queue"))
    tokens = stored(base.mapInArrow(_tokens(path, end), "doc_id long, queue string, task int, inside long, ids binary, n long"), "tokens")
    sums = stored(tokens.groupBy("queue", "task").agg(F.sum("n").alias("tokens")), "sums")
    # each queue's stage (named sources first), weight, and place: listed, or in the stage's shared queue
    queues = sums.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        queues = queues.withColumns({"stage": F.lit(0), "weight": F.col("tokens")})
    else:
        named = spark.createDataFrame([(f"={k}", round(1e6 * v)) for k, v in targets.items() if round(1e6 * v) > 0], "queue string, weight long")
        queues = queues.join(named, "queue", "left").withColumns({"stage": F.when(F.col("weight").isNull(), 1).otherwise(0), "weight": F.coalesce("weight", "tokens")})
    queues = stored(queues.withColumns({"units": F.expr(f"tokens div {quantum}"), "rest": F.col("tokens") % quantum}), "queues")
    every = {r.stage: r.weight for r in queues.groupBy("stage").agg(F.sum("weight").alias("weight")).collect()}  # two rows at most
    part = max(1 / SMALLEST, 4 / quantum)
    listed = F.col("weight") >= F.when(F.col("stage") == 0, F.lit(every.get(0, 0) * part)).otherwise(F.lit(every.get(1, 0) * part))
    big = sorted(queues.where(listed).select("queue", "stage", "tokens", "weight").collect())  # 1 / part of each stage at most
    small = {r.stage: r for r in queues.where(~listed).groupBy("stage").agg(F.sum("units").alias("units"), F.sum("rest").alias("rest"), F.sum("weight").alias("weight")).collect()}
    shared = [(int(small[s].units), int(small[s].weight)) if s in small else (0, 0) for s in (0, 1)]
    stages = [({k: (r.tokens, r.weight) for k, r in enumerate(big) if r.stage == s}, shared[s]) for s in (0, 1)]
    own, served, taken = phases(stages, window, quantum)
    # the tail: whole units of the shared queues, the rests of their sources, the rests of the listed queues
    rests = quantum * sum(n - t for (n, _), t in zip(shared, taken, strict=True))
    behind, tail = {}, rests + sum(int(r.rest) for r in small.values())
    for k, r in enumerate(big):
        behind[k] = tail
        tail += r.tokens - served[k]
    plan = Plan(window, quantum, own, served, behind, own[-1].first + own[-1].windows if own else 0, tail)
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")
    numbers = spark.createDataFrame([(r.queue, k) for k, r in enumerate(big)], "queue string, k int")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = tokens.join(at.join(F.broadcast(numbers), "queue"), ["queue", "task"]).select("doc_id", "k", (F.col("inside") + F.col("base")).alias("at"), "ids", "n")
    out = placed.mapInArrow(_listed(plan, kind), schema)
    if not small:
        return out
    less = stored(_running(queues.where(~listed), ["queue"], F.col("rest"), "rest_at", 32), "small")
    many = sum(n for n, _ in shared)
    # units in two steps: no array is longer than a queue's 4096th part, or than 4096
    low = less.where("units > 0").withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1, F.lit(4096).cast("long")))).repartition(max(32, many >> 17), "queue", "low")
    unit = low.withColumn("unit", F.explode(F.sequence("low", F.least(F.col("low") + 4095, F.col("units") - 1))))
    unit = unit.select("queue", "unit", "stage", ((2 * F.col("unit") + 1) / F.col("weight")).alias("due"))
    slot = _running(unit, ["stage", "due", "queue", "unit"], F.lit(1), "slot", max(32, many >> 17)).withColumn("slot", F.col("slot") - F.when(F.col("stage") == 1, shared[0][0]).otherwise(0))
    places = slot.select("queue", "unit", "stage", "slot").mapInArrow(_unit_places(plan, [n for n, _ in shared], taken), "queue string, unit long, unit_sequence long, unit_offset long")
    more = tokens.join(at.join(less.select("queue", "units", "rest_at"), "queue"), ["queue", "task"]).select("doc_id", "queue", (F.col("inside") + F.col("base")).alias("at"), "ids", "n", "units", "rest_at")
    more = more.mapInArrow(_by_unit(plan, kind, rests), "doc_id long, queue string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, unit long")
    done = F.col("sequence_id") >= 0
    more = more.join(places, ["queue", "unit"], "left").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.when(done, F.col("sequence_id")).otherwise(F.col("unit_sequence")).alias("sequence_id"), F.when(done, F.col("offset")).otherwise(F.col("unit_offset") + F.col("offset")).alias("offset"))
    return out.unionByName(more)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
