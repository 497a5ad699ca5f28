"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds part them:
P(grade > k) = sigmoid(w.x - theta_k). Fitted in numpy on a bounded sample of rated texts, applied to
every text inside the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Words, mix, powers, texts

DIMENSIONS = 1 << 18
#: Rated texts used for fitting, at most (those with the smallest hashed ids), and those of them held out.
SAMPLE, HELD_OUT = 8000, 5
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()[]{}#*$%&|<>")] = True
_UPPER, _DIGIT, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN[list(b"#*$%&|<>!=@^~{}[]\\/_")] = True
_SALT = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features present in each row, as (row, feature), by row: words without marks around the end, their first four bytes, and classes of the text's shape."""
    rows = len(offsets) - 1
    w = Words(data, offsets, lower=True)
    row = w.rows()
    end = w.end.copy()
    for _ in range(4):
        end -= (end > w.start + 1) & _MARK[data[end - 1]] if len(end) else 0
    _, down = powers(len(data) + 1)
    hashed = lambda e: mix((w.sums[e] - w.sums[w.start]) * down[w.start] + (e - w.start).astype(np.uint64)) if len(e) else np.zeros(0, np.uint64)
    size = np.maximum(np.diff(offsets), 1)
    count = lambda member: np.diff(np.concatenate([[0], np.cumsum(member)])[offsets])
    words = np.maximum(np.diff(w.first), 1)
    per_row = np.split(w.hash, w.first[1:-1]) if rows else []
    distinct = np.array([len(np.unique(x)) for x in per_row], float)
    shape = [
        np.minimum(10 * count(_UPPER[data]) // size, 9),
        np.minimum(20 * count(_SIGN[data]) // size, 9),
        np.minimum(10 * count(_DIGIT[data]) // size, 9),
        (10 * (1 - distinct / words)).astype(np.int64).clip(0, 9),
        np.minimum(np.log2(words + 1).astype(np.int64), 15),
        np.minimum((size - count(SPACE[data])) // words, 20),
    ]
    h = [hashed(end), mix(hashed(np.minimum(end, w.start + 4)) ^ _SALT)]
    r = [row, row]
    for k, s in enumerate(shape):
        h.append(mix(np.asarray(s).astype(np.uint64) + np.uint64((1000 * (k + 1) * int(_SALT)) & ((1 << 64) - 1))))
        r.append(np.arange(rows))
    key = np.concatenate(r).astype(np.uint64) * np.uint64(DIMENSIONS) + np.concatenate(h) % np.uint64(DIMENSIONS)
    key = np.unique(key)
    return (key // np.uint64(DIMENSIONS)).astype(np.int64), (key % np.uint64(DIMENSIONS)).astype(np.int64)


@dataclass
class Ordinal:
    """Weights by hashed feature, and ordered thresholds between the grades 0..K-1."""

    weights: np.ndarray
    thresholds: np.ndarray
    accuracy: float = float("nan")
    fitted: bool = True  # without any rated text it is not, and rejects nothing

    def above(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        score = np.bincount(row, weights=self.weights[feature], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def fit_arrays(x: list[np.ndarray], y: np.ndarray, grades: int, epochs: int = 60, rate: float = 0.1, penalty: float = 1e-5, least: int = 6, screen: float = 3.0, most: int = 256, seed: int = 3) -> Ordinal:
    """Maximum likelihood by Adam. Features in fewer than ``least`` texts, or that part no grade from those over it by ``screen`` standard errors, get no weight, nor do any but the ``most`` telling ones. Every HELD_OUT-th text measures the accuracy and is not fitted."""
    w, steps = np.zeros(DIMENSIONS), np.zeros(grades - 1)  # thresholds: first, then logs of the gaps
    model = Ordinal(w, np.zeros(grades - 1), fitted=False)
    n = len(x)
    if not n:
        return model
    test = np.arange(n) % HELD_OUT == HELD_OUT - 1
    z = np.zeros(DIMENSIONS)
    # in how many texts of each grade a feature is, from a few texts at a time: copies of all features would not be small
    by_grade = np.zeros((grades, DIMENSIONS), np.int32)
    for a in range(0, n, 256):
        for k in range(grades):
            own = [f for f, g in zip(x[a : a + 256], y[a : a + 256], strict=True) if g == k]
            if own:
                by_grade[k] += np.bincount(np.concatenate(own), minlength=DIMENSIONS).astype(np.int32)
    seen = by_grade.sum(axis=0)
    for k in range(grades - 1):  # among the texts of grade k and over: those over k
        n_k, over = by_grade[k:].sum(axis=0), by_grade[k + 1 :].sum(axis=0)
        share = np.mean(y[y >= k] > k) if (y >= k).any() else 0.0
        z = np.maximum(z, np.abs(over - share * n_k) / np.maximum(np.std((y > k)[y >= k]) * np.sqrt(n_k), 1e-9))
    z[seen < min(least, max(1, n // 20))] = 0
    telling = np.zeros(DIMENSIONS, bool)
    telling[np.argsort(-z, kind="stable")[:most]] = True
    telling &= z >= screen
    x = [f[telling[f]] for f in x]
    pick = np.flatnonzero(~test)
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)
    r, step = np.random.default_rng(seed), 0
    theta = lambda s: np.concatenate([s[:1], s[0] + np.cumsum(np.exp(s[1:]))])
    for _ in range(epochs):
        r.shuffle(pick)
        for part in np.array_split(pick, max(1, len(pick) // 512)):
            row, feature = _sparse([x[i] for i in part])
            score = np.bincount(row, weights=w[feature], minlength=len(part))
            t = theta(steps)
            up = np.concatenate([np.ones((len(part), 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - t, -30, 30))), np.zeros((len(part), 1))], axis=1)
            slope = up * (1 - up)
            g, k = y[part], np.arange(len(part))
            p = np.maximum(up[k, g] - up[k, g + 1], 1e-9)
            d_score = -(slope[k, g] - slope[k, g + 1]) / p / len(part)
            d_theta = np.zeros(grades - 1)
            np.add.at(d_theta, g[g > 0] - 1, (slope[k, g] / p)[g > 0] / len(part))
            np.add.at(d_theta, g[g < grades - 1], -(slope[k, g + 1] / p)[g < grades - 1] / len(part))
            d_steps = np.concatenate([[d_theta.sum()], np.exp(steps[1:]) * np.cumsum(d_theta[::-1])[::-1][1:]])
            d_w = np.bincount(feature, weights=d_score[row], minlength=DIMENSIONS) + penalty * w
            step += 1
            for v, d, a, b in ((w, d_w, m1, m2), (steps, d_steps, t1, t2)):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model = Ordinal(w.astype(np.float32), theta(steps))
    held = np.flatnonzero(test)
    if len(held):
        above = model.above(*_sparse([x[i] for i in held]), len(held))
        model.accuracy = float(np.mean((above > 0.5).sum(axis=1) == y[held]))
    return model


def _features_of(batches):
    for batch in batches:
        for a, b, data, offsets in texts(batch.column("text")):
            row, feature = features(data, offsets)
            blobs = [f.astype("<i4").tobytes() for f in np.split(feature, np.searchsorted(row, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a), batch.column("grade").slice(a, b - a), pa.array(blobs, pa.binary())], ["k", "grade", "features"])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """Fits on the ``sample`` rated texts with the smallest hashed ids; ratings that are null or out of 0..grades-1 are left out.

    Rows that repeat an id, and ratings that repeat one with the same grade, count once. The sample's ids are broadcast: ``sample`` bounds them, whatever the size of the tables. With no rated text every
    grade is as likely as any, and nothing is rejected for lack of evidence (all scores are one half).
    """
    grade = F.col(grade_col).cast("int")
    rated = ratings.select(F.col(id_col).cast("long").alias("k"), grade.alias("grade")).where(F.col("k").isNotNull() & F.col("grade").between(0, grades - 1)).orderBy(F.xxhash64("k"), "k", "grade").limit(sample)
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    found = base.join(F.broadcast(rated), "k").mapInArrow(_features_of, "k long, grade int, features binary")
    # rows that repeat a rated id count once, by the least of their features: the driver gets ``sample`` rows at most
    got = found.groupBy("k", "grade").agg(F.min("features").alias("features")).toArrow().sort_by([("k", "ascending"), ("grade", "ascending")])
    x = [np.frombuffer(b.as_buffer(), "<i4") for b in got.column("features")]
    return fit_arrays(x, got.column("grade").to_numpy().astype(np.int64), grades)


def _graded(model: Ordinal, cut: float, kept: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in texts(batch.column("text")):
                above = model.above(*features(data, offsets), b - a)
                top = above[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(above.sum(axis=1).round(6)), pa.array(top.round(6)), pa.array((top >= cut) | (not model.fitted)), *(batch.column(c).slice(a, b - a) for c in kept)],
                    ["_grade", "_tail", "_kept", *kept],
                )

    return run


def grade(docs: DataFrame, model: Ordinal, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the top grade), kept (at ``cut`` or over) and the columns named in ``keep``.

    One row per input row. A null or empty text has the shape features of no words and is graded by them;
    repeated rows and null ids are ordinary rows; other columns are ignored; an empty table gives an
    empty result.
    """
    own = {c: "text" if c == text_col else f"_keep_{c}" for c in keep}  # a text that is kept goes to the task once
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in own.items() if n != "text"))
    sent = ["doc_id", *own.values()]
    schema = "_grade double, _tail double, _kept boolean, doc_id long" + "".join(f", `{n}` {docs.schema[c].dataType.simpleString()}" for c, n in own.items())
    out = base.mapInArrow(_graded(model, cut, sent), schema)
    return out.select("doc_id", F.col("_grade").alias("expected_grade"), F.col("_tail").alias("tail_probability"), F.col("_kept").alias("kept"), *(F.col(n).alias(c) for c, n in own.items()))


def corpus_ratings(labels: DataFrame) -> DataFrame:
    """Grades of the table ``labels``: 0 for low quality, 1 for good but toxic, 2 for good and not toxic."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2).alias("grade"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_grade (0 to 2), tail_probability of grade 2, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, corpus_ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return grade(docs, model)
