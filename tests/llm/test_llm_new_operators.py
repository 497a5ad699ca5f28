"""Whitening, the filter audit and fingerprints against plain versions, with the odd cases: nulls, empty and long texts, ties, copies."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from docustrata.llm import audit, fingerprints, whitening

from test_llm_operators import SCHEMA, corpus, empty, split, table

VECTORS = "vec_id long, embedding array<double>, label int, x string, e long, n long, i int, c0 double, component int"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, 3, 4.0, 5) for i, v in rows], VECTORS)


def vectors():
    r = np.random.default_rng(3)
    m = r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) * 3 + r.normal(size=12) * 100
    m[:, 5] = 7.25  # no variance
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(300, None), (301, []), (302, [math.nan] * 12), (303, [math.inf] + [0.0] * 11), (304, [None] + [1.0] * 11), (None, m[3].tolist()), (3, m[3].tolist()), (305, [0.0] * 5 + [7.25] + [0.0] * 6)]
    return rows


def good(v):
    return v and all(c is not None and math.isfinite(c) for c in v)


def by_eigh(rows, most):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in rows], float)
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(c))
    e, u = e[::-1], u[:, ::-1]
    return (c @ u / np.sqrt(np.where(e > 0, e, np.inf)))[:, :most], (e / e.sum())[:most]


@pytest.mark.parametrize("most", [4, 32])
def test_whitening(spark, most):
    rows = [(i, v) for i, v in vectors() if good(v)]
    want, share = by_eigh(rows, most)
    m = min(most, 11)  # of 12 dimensions one has no variance
    got = whitening.whiten(vector_table(spark, vectors()), most).collect()
    assert len(got) == len(rows) * m and {r.n for r in got} == {len(rows)}
    sums = [sum(math.floor(64 * v[j]) + 1000000 for _, v in rows) for j in range(12)]
    deviation = {i: sum((len(rows) * (math.floor(64 * c) + 1000000) - s) ** 2 for c, s in zip(v, sums)) for i, v in rows}
    place = {i: k for k, (i, _) in enumerate(rows)}
    w = np.full((len(rows), m), np.nan)
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    for j in range(m):
        a, b = w[[place[i] for i, _ in rows], j], want[[place[i] for i, _ in rows], j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vector_table(spark, [])).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(vector_table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [1e300]), (5, [-1e300])])).collect()
    assert sorted((r.vec_id, r.n, r.component, round(abs(r.whitened), 6)) for r in got) == [(1, 2, 1, 1.0), (2, 2, 1, 1.0), (3, 3, 1, 0.0), (4, 3, 1, 1.224745), (5, 3, 1, 1.224745)]
    assert all(r.deviation is None for r in got if r.vec_id > 3)


@pytest.mark.parametrize("d,decay", [(300, 0.97), (300, 0.999), (64, 1.0), (5, 0.5), (1, 1.0)])
def test_eigenpairs(d, decay):
    """Whole iterations (300 dimensions, 16 wanted), close eigenvalues, and blocks that fill the space."""
    r = np.random.default_rng(d)
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    values = 100 * decay ** np.arange(d)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    calls = []
    wanted = min(16, d)
    e, u, share = whitening.largest_eigenpairs(lambda b: calls.append(b.shape) or a @ b, d, wanted)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:wanted], rtol=1e-11) and share < 1e-11
    assert np.abs(a @ u - u * e).max() < 1e-9 and np.abs(u.T @ u - np.eye(wanted)).max() < 1e-12
    assert len({s[1] for s in calls}) == 1 and len(calls) < 200


def test_eigenpairs_of_nothing_and_of_one_direction():
    e, u, _ = whitening.largest_eigenpairs(lambda b: 0 * b, 7, 3)
    assert not e.any() and u.shape == (7, 3)
    v = np.arange(1.0, 8)[:, None]
    e, u, _ = whitening.largest_eigenpairs(lambda b: v @ (v.T @ b), 7, 3)
    assert abs(e[0] - 140) < 1e-10 and abs(abs(u[:, 0] @ v[:, 0]) - np.sqrt(140)) < 1e-10 and np.abs(e[1:]).max() < 1e-10


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = whitening.op11_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(rows) and got.identity_error.max() < 1e-9
    want, share = by_eigh(sorted(rows), 32)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    near = np.minimum(np.abs(w - want).max(axis=0), np.abs(w + want).max(axis=0))
    assert near.max() < 1e-6 and np.allclose(got.drop_duplicates("component").sort_values("component").explained, share)


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); every order applied to every document."""
    told = {}
    for i, q, t in labels:
        told.setdefault(i, [0, 0])
        told[i][0] |= q == 1
        told[i][1] |= t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        w, t = split(t), t or ""
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append((part or "", f, *(told.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                failing = [x for x in own if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def audit_rows():
    r = random.Random(9)
    more = [(100 + k, " ".join(r.choice("ABCdefgh") * r.randint(1, 4) for _ in range(r.randint(0, 120))) + r.choice(["", "", " #", " ", "$x"])) for k in range(60)]
    more += [(200 + k, more[k % 5][1]) for k in range(25)] + [more[0], more[0], (100, "other text"), (None, more[1][1]), (None, None)]
    return corpus() + more


def test_filter_audit(spark):
    rows = audit_rows()
    df = table(spark, rows)
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (100, 1, 0), (103, 0, 1), (104, None, None), (None, 1, 1), (999, 1, 1)] + [(200 + k, k % 2, k % 3 == 0) for k in range(25)]
    told = spark.createDataFrame([(i, q, None if t is None else int(t), "x", 1) for i, q, t in labels], "doc_id long, quality int, toxic int, part string, h long")
    parts = [r.source for r in df.select("source").collect()]
    got = audited(audit.audit(df.repartition(3, "doc_id"), told))
    assert got == plain_audit([(i, t, p) for (i, t), p in zip(rows, parts)], labels)
    assert len(got) == 600 * len({p or "" for p in parts}) and audit.audit(empty(spark), told).count() == 0


def test_filter_audit_shuffles_texts_once_and_no_words(spark):
    plan = audit.word_totals(table(spark, corpus()).selectExpr("doc_id", "text", "xxhash64(text) h"))._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Generate explode")[0]
    assert before.count("Exchange") == 1  # of the totals; the other one lies under the words


def plain_codes(text, bins=512):
    """The same fingerprint, bin by bin, from the definition."""
    h, _ = fingerprints._shingles(fingerprints.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), lower=True), 5)
    if not len(h):
        return None
    kept = {}
    for x in fingerprints.mix(np.unique(h) + fingerprints._GOLD).tolist():
        b, v = x >> 55, x & ((1 << 55) - 1)
        kept[b] = min(v, kept.get(b, v))
    order, _ = fingerprints._orders(bins)
    values = [kept[b] if b in kept else kept[next(int(o) for o in order[b] if int(o) in kept)] for b in range(bins)]
    x = fingerprints.mix(np.array(values, np.uint64) + np.arange(bins, dtype=np.uint64) * fingerprints._GOLD)
    return [int(v) & 15 for v in x]


def coded(hex_):
    return [int(c, 16) for c in hex_] if hex_ else None


def like(x, y):
    if x is None or y is None:
        return float(x is y)
    return max(0.0, (sum(a == b for a, b in zip(x, y)) / len(x) - 1 / 16) / (15 / 16))


@pytest.mark.parametrize("partitions,size", [(1, 1 << 25), (7, 200), (3, 20000)])
def test_fingerprints(spark, partitions, size, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(fingerprints, "RANGE", size)
    df = table(spark, rows).repartition(partitions, "doc_id")
    hashed = [(r.doc_id, r.text or "", r.h) for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) h").collect()]
    order = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = []
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        x, y, z = plain_codes(t), plain_codes(changed), plain_codes(after)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), x, y, round(like(x, y), 9), round(like(x, z), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, coded(r.fingerprint), coded(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprints(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    (one,) = fingerprints.fingerprints(table(spark, [(4, "a b c d e f")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d ea b"[:9] + b"a ").hexdigest()
    (none,) = fingerprints.fingerprints(table(spark, [(None, None)])).collect()
    assert none.doc_id is None and none.fingerprint == "" and none.near_edited == 1.0 and none.n_chars == 0
    same = fingerprints.fingerprints(table(spark, [(1, "one text that is repeated")] * 50)).collect()
    assert len(same) == 50 and {r.near_next for r in same} == {1.0}


def test_likeness_is_without_bias(spark):
    """On real texts: the mean error is small, each one within five standard deviations; unrelated texts are unlike."""
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.op13_fingerprints(spark, sf).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [split(t.lower())] for i in range(max(len(w) - 4, 1))}
    errors = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        a, b, c = shingles(t), shingles(t[: len(t) - q] + after[:q]), shingles(after)
        for other, value in ((b, got[i].near_edited), (c, got[i].near_next)):
            j = len(a & other) / len(a | other)
            errors.append((value - j, j, len(a | other)))
    e = np.array([x for x, _, n in errors if n >= 50])
    assert len(got) == len(docs) and abs(e.mean()) < 0.005 and np.abs(e).max() < 0.2 and np.sqrt((e**2).mean()) < 0.04


def test_fingerprint_schema_has_no_clashes(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
