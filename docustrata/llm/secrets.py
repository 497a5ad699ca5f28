"""Secret scans: patterns find candidates, a character network trained on labelled findings judges each with its surroundings.

Labelled findings come from the texts themselves, values of the fixed patterns in their places against words of the same
text put in those places and other long runs, and from rules for the formats that a corpus may lack. A part held out gives the
calibration and one threshold for all: the highest that keeps the wanted recall of the rules' findings and of the corpus' own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charcnn import CharCnn, crop, findings, look_alike
from .words import texts

_any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_NAMES = "|".join(_any_case(w).replace("~", "_?") for w in ("password", "passwd", "secret", "token", "api~key"))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_OTHER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
#: Values under a name of credentials: quoted ones up to their quote on the same line, others up to a blank or quote, whatever marks they hold.
_NAMED = re.compile(r"""(?i:password|passwd|passphrase|pwd|secret|token|api_?key|credentials?|private_?key|auth)["']?\x20*[:=]\x20*(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([^\s"']{6,}))""")
KINDS = ("assign", "access", "hex", "model")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, n_sure long, found array<struct<kind:string,start:int,end:int,probability:double>>, text string"

_IN_HEX, _IN_OTHER = np.zeros(256, bool), np.zeros(256, bool)
_IN_HEX[list(b"0123456789abcdef")] = True
_IN_OTHER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value), leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def other_candidates(text: str, taken: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Spans that no base span covers: unbroken runs of 12 and more characters with a letter and a digit, and whole values under a name of credentials."""
    runs = []
    for m in _OTHER.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            runs.append((m.start(), m.end()))
    found, k = [], 0
    if "=" in text or ":" in text:
        for m in _NAMED.finditer(text):  # both come by start and neither overlaps its own kind
            a, b = m.span(m.lastindex)
            while k < len(runs) and runs[k][1] <= a:
                found.append(runs[k])
                k += 1
            while k < len(runs) and a <= runs[k][0] and runs[k][1] <= b:  # parts of the value
                k += 1
            if k == len(runs) or not (runs[k][0] <= a and b <= runs[k][1]):
                found.append((a, b))
    found += runs[k:]
    out, k, reach = [], 0, -1
    for a, b in sorted(found):  # base spans come by start, so one walk finds those that begin before a run
        while k < len(taken) and taken[k][1] <= a:
            reach = max(reach, taken[k][2])
            k += 1
        if reach < b:
            out.append(("model", a, b, a))
    return out


def _long_run(member: np.ndarray, offsets: np.ndarray, least: int, need: np.ndarray | None = None) -> np.ndarray:
    """Rows with a run of at least ``least`` member bytes, one of them in ``need``."""
    n = len(member)
    hit = np.zeros(len(offsets) - 1, bool)
    if n < least:
        return hit
    breaks = np.concatenate([[-1], np.flatnonzero(~member), [n]])
    starts, ends = breaks[:-1] + 1, breaks[1:]
    long_ = ends - starts >= least
    if need is not None:
        many = np.concatenate([[0], np.cumsum(need)])
        long_ &= many[ends] > many[starts]
    for a, b in zip(starts[long_], ends[long_], strict=True):  # a run may go over a row's end
        i = int(np.searchsorted(offsets, a, "right")) - 1
        while i < len(hit) and offsets[i] < b:
            hit[i] |= min(b, offsets[i + 1]) - max(a, offsets[i]) >= least
            i += 1
    return hit


def _likely(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a candidate of any kind."""
    digit = (data >= ord("0")) & (data <= ord("9"))
    maybe = _long_run(_IN_HEX[data], offsets, 16) | _long_run(_IN_OTHER[data], offsets, 12, digit)
    maybe |= _long_run(_IN_OTHER[data], offsets, 18, (data >= ord("A")) & (data <= ord("Z")))
    spot = np.flatnonzero((data == ord("=")) | (data == ord(":")))
    maybe[np.searchsorted(offsets, spot, "right") - 1] = True
    return maybe


def _scanned(model: CharCnn, mark: str | None):
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b, data, offsets in texts(column):
                maybe = _likely(data, offsets)
                rows = {k: [] for k in ("assign", "access", "hex", "model", "sure")}
                found, out = [], []
                views, owner = [], []
                held: list[list] = []
                for i in range(b - a):
                    spans = []
                    if maybe[i]:
                        text = column[a + i].as_py() or ""
                        base = base_spans(text)
                        spans = base + other_candidates(text, base)
                        for j, (_, _, e, v) in enumerate(spans):
                            got = crop(text, v, e)
                            views += got
                            owner += [(i, j)] * len(got)
                    held.append(spans)
                best: dict[tuple[int, int], float] = {}
                for at in range(0, len(views), 4096):
                    for key, p in zip(owner[at : at + 4096], model.probability(views[at : at + 4096]), strict=True):
                        best[key] = max(best.get(key, 0.0), float(p))
                for i, spans in enumerate(held):
                    sure = {v: best[i, j] for j, (k, _, _, v) in enumerate(spans) if k != "model"}
                    for j, (k, _, _, v) in enumerate(spans):  # what goes on with a value of a fixed pattern is at least as sure as that
                        if k == "model":
                            best[i, j] = max(best[i, j], sure.get(v, 0.0))
                    kept = [(k, s, e, best[i, j]) for j, (k, s, e, _) in enumerate(spans) if k != "model" or best[i, j] >= model.threshold]
                    kept.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    for k in KINDS:
                        rows[k].append(sum(s[0] == k for s in kept))
                    rows["sure"].append(sum(s[3] >= model.threshold for s in kept))
                    found.append([{"kind": k, "start": s, "end": e, "probability": p} for k, s, e, p in kept])
                    out.append(redact(column[a + i].as_py() or "", kept, mark) if mark is not None else None)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                rest = [(c, batch.column(c).slice(a, b - a)) for c in batch.schema.names if c.startswith("_keep_")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(rows[k], pa.int64()) for k in rows), pa.array(found, kind), pa.array(out, pa.string()), *(x for _, x in rest)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "n_sure", "found", "text", *(c for c, _ in rest)],
                )

    return run


def redact(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    """The text with every union of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for _, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _labelled(batches):
    """Views of findings that the texts label: values of base spans, and in their places and elsewhere what is none."""
    for batch in batches:
        column = batch.column("text")
        for a, b, data, offsets in texts(column):
            out: list[tuple[str, int, int, int]] = []
            for i in np.flatnonzero(_likely(data, offsets)):
                text = column[a + int(i)].as_py() or ""
                base = base_spans(text)
                for _, _, e, v in base:
                    near = text[max(0, v - 400) : v].split()[:-1] + text[e : e + 400].split()[1:]
                    put = look_alike([w for w in near if w.isalpha()], e - v, v)
                    out += [(*view, 1) for view in crop(text, v, e)]
                    if put:
                        around = text[max(0, v - 400) : v] + put + text[e : e + 400]
                        at = min(v, 400)
                        out += [(*view, 0) for view in crop(around, at, at + len(put))]
            t, x, y, z = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(z, pa.int32())], ["view", "since", "till", "label"])


#: Views labelled by the corpus that are fitted and calibrated on, at most: those with the smallest hashes.
SAMPLE = 4000


def trained(docs: DataFrame | None = None, text_col: str = "text", examples: int = 3000, sample: int = SAMPLE, recall: float = 0.98, seed: int = 1) -> CharCnn:
    """A network fitted on ``examples`` findings made by rule and, given texts, on ``sample`` views that these label.

    A fifth of each is held out for calibration; the threshold is the highest that keeps ``recall`` of the true ones of both.
    Texts without base spans leave the rules' findings alone to fit on.
    """
    views, labels = findings(examples, seed)
    held, truth = findings(examples // 4, seed + 1)
    own_held: tuple[list, list] = ([], [])
    if docs is not None:
        found = docs.select(F.col(text_col).alias("text")).mapInArrow(_labelled, "view string, since int, till int, label int")
        got = found.groupBy("view", "since", "till", "label").count().orderBy(F.xxhash64("view", "since"), "view", "since", "till", "label").limit(sample).collect()
        for k, r in enumerate(got):
            x, y = (own_held if k % 5 == 4 else (views, labels))
            x.append((r.view, r.since, r.till))
            y.append(r.label)
    model = CharCnn()
    model.fit(views, labels)
    model.calibrate(held + own_held[0], truth + own_held[1], recall)
    if any(own_held[1]):
        yes = np.sort(model.probability([v for v, y in zip(*own_held, strict=True) if y]))
        model.threshold = min(model.threshold, float(yes[int((1 - recall) * len(yes))]))
    return model


def scan(docs: DataFrame, model: CharCnn | None = None, mark: str | None = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Finds secrets in every whole text.

    One row per input row: doc_id, n_assign, n_access, n_hex, n_model, n_sure (spans of any kind at or over the threshold), found (kind, start, end in code
    points, end exclusive, probability; ordered by start, then kind), text (found spans replaced by ``mark``; null when
    ``mark`` is None), and the columns named in ``keep``. Spans of the fixed patterns always stay; the
    network scores them too, and adds candidates of kind ``model`` (``other_candidates``) at or over its threshold; one that goes on
    with a fixed pattern's value takes that one's probability if it is higher.
    ``model``: default, one trained on the rules' findings and on those that ``docs`` label.

    A null text is empty and has none. Repeated rows and null ids are ordinary rows; other columns are
    ignored; an empty table gives an empty result.
    """
    model = model or trained(docs, text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    schema = SCHEMA + "".join(f", `_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(_scanned(model, mark), schema).withColumnsRenamed({f"_keep_{c}": c for c in keep})


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, n_sure, probability (of the likeliest span)."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), mark=None)
    text = lambda keep: F.array_join(F.transform(F.filter("found", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    top = F.round(F.array_max(F.transform("found", lambda s: s["probability"])), 6)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text(lambda s: s["kind"] != "model"), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"), "n_model", "n_sure", top.alias("probability"))
