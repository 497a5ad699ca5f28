"""Embedding whitening by LOBPCG (Knyazev 2001) with distributed covariance-block products.

The covariance is never formed. Each iteration sends a block of directions to the tasks, which centre their rows, project
them on the block and return the partial product; Spark adds the partials by dimension. The driver does the
Rayleigh-Ritz step on the iterate, its residual and the previous direction: matrices of dimensions x block columns, whatever the
number of rows. Iterations go on until the residual norms of all wanted components, from a product computed anew, are
certified; only then are the rows whitened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Entries become floor(SCALE * c) + SHIFT; 64 * c beyond +-LARGEST counts as that.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2**48
#: Residual norms, as shares of the largest eigenvalue: aimed at, and the most that is accepted where rounding allows no better.
AIM, ACCEPT = 1e-14, 1e-11
#: Iterations before the fit is an error; rows centred at once.
ITERATIONS, ROWS = 500, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of longs as a matrix."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(len(column), -1)


def _blocks(batches):
    """(batch, first row, matrix of at most ROWS rows)."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column("x"))


def _partial(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), *(pa.array(c) for c in rows.T)], ["i", *(f"c{j}" for j in range(rows.shape[1]))])


def _summed(x: DataFrame, task, rows: int, columns: int, kind: str = "double") -> np.ndarray:
    """The sum over all tasks of the matrices (rows x columns) that ``task`` gives."""
    out = x.mapInArrow(task, "i int, " + ", ".join(f"c{j} {'double' if kind == 'double' else 'long'}" for j in range(columns)))
    out = out.groupBy("i").agg(*(F.sum(F.col(f"c{j}").cast(kind)).alias(f"c{j}") for j in range(columns)))
    total = np.zeros((rows, columns), object if kind != "double" else float)
    for r in out.toLocalIterator():
        total[r[0]] = [int(v) if kind != "double" else v for v in r[1:]]
    return total


def _sums():
    """Per batch: exact sums of each dimension."""

    def run(batches):
        for _, x in _blocks(batches):
            yield _partial(x.sum(axis=0)[:, None])

    return run


def _product(mean: tuple[np.ndarray, np.ndarray], block: np.ndarray):
    """Per task: the centred rows' product with the block, then the sums and the squares of each centred dimension."""

    def run(batches):
        total = None
        for _, x in _blocks(batches):
            c = _centred(x, mean)
            part = np.column_stack([c.T @ (c @ block), c.sum(axis=0), np.einsum("ij,ij->j", c, c)])
            total = part if total is None else total + part
        if total is not None:
            yield _partial(total)

    return run


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x - S/n: the whole part of S/n is subtracted exactly, its fraction afterwards."""
    return (x - mean[0]).astype(np.float64) - mean[1]


def _orthonormal(block: np.ndarray, image: np.ndarray | None, against: np.ndarray, against_image: np.ndarray | None, tiny: float = 1e-10) -> tuple[np.ndarray, np.ndarray | None]:
    """An orthonormal basis of what the block holds beside ``against``, with its image; directions that vanish are left out."""
    scale = np.linalg.norm(block, axis=0)
    keep = scale > 0
    block = block[:, keep] / scale[keep]
    if image is not None:
        image = image[:, keep] / scale[keep]
    for _ in range(2):
        share = against.T @ block
        block = block - against @ share
        if image is not None:
            image = image - against_image @ share
        u, s, v = np.linalg.svd(block, full_matrices=False)
        good = s > tiny
        turn = v.T[:, good] / s[good]
        if image is None:
            block = u[:, good]
        else:
            block, image = block @ turn, image @ turn
    return block, image


def largest_eigenpairs(product, d: int, wanted: int, seed: int = 11, aim: float = AIM, accept: float = ACCEPT, most: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of a symmetric positive operator of ``d`` dimensions, and the certified residual.

    ``product(block)`` applies the operator to a matrix of d rows. A quarter more columns than wanted are iterated, which
    keeps the last wanted ones apart from the rest of the spectrum. Raises ArithmeticError if ``most`` iterations don't
    bring the residuals under ``accept`` times the largest eigenvalue.
    """
    k = min(d, wanted + max(wanted // 4, 2))
    x, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))
    fresh, ax = True, product(x)
    p = ap = np.zeros((d, 0))
    best = np.inf
    for _ in range(most):
        if fresh:
            e, turn = np.linalg.eigh((g := x.T @ ax) / 2 + g.T / 2)
            x, ax, e = x @ turn[:, ::-1], ax @ turn[:, ::-1], e[::-1]
        r = ax - x * e
        norm = np.linalg.norm(r[:, :wanted], axis=0).max()
        if e[0] <= 0:
            return np.maximum(e[:wanted], 0), x[:, :wanted], 0.0
        share = norm / e[0]
        if fresh and (share <= aim or share <= accept and share > best / 2):
            return e[:wanted], x[:, :wanted], share
        if fresh:
            best = share
        if not fresh and share <= max(aim, best / 1e3):
            # by the updated images it is close enough: certify it by a product computed anew, and begin again from there if it is not
            x, _ = np.linalg.qr(x)
            fresh, ax = True, product(x)
            p = ap = np.zeros((d, 0))
            continue
        w, _ = _orthonormal(r, None, np.column_stack([x, p]), None)
        aw = product(np.column_stack([w, np.zeros((d, k - w.shape[1]))]))[:, : w.shape[1]]
        basis, image = np.column_stack([x, p, w]), np.column_stack([ax, ap, aw])
        e, turn = np.linalg.eigh((g := basis.T @ image) / 2 + g.T / 2)
        e, turn = e[::-1][:k], turn[:, ::-1][:, :k]
        step = turn.copy()
        step[: x.shape[1]] = 0  # the new direction: what W and P bring
        x, ax, p, ap = basis @ turn, image @ turn, basis @ step, image @ step
        p, ap = _orthonormal(p, ap, x, ax)
        fresh = False
        if w.shape[1] + x.shape[1] >= d or not w.shape[1]:
            x, _ = np.linalg.qr(x)
            fresh, ax = True, product(x)
            p = ap = np.zeros((d, 0))
    raise ArithmeticError(f"residuals of {share:.1e} after {most} iterations")


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum((n * x - S) ** 2) by row, exact; None where it exceeds a long."""
    far = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * far + max(map(abs, sums.tolist()), default=0) < 2**62:
        d = n * x - sums.astype(np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) < 2**62:
            return (d * d).sum(axis=1).tolist()
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


def _identity(mean: tuple[np.ndarray, np.ndarray], turn: np.ndarray, own: np.ndarray):
    def run(batches):
        total = None
        for _, x in _blocks(batches):
            w = _centred(x, mean) @ turn - own
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            yield _partial(total)

    return run


def _whitened(n: int, sums: np.ndarray, mean: tuple[np.ndarray, np.ndarray], turn: np.ndarray, explained: np.ndarray, error: float):
    m = turn.shape[1]

    def run(batches):
        for part, x in _blocks(batches):
            w = _centred(x, mean) @ turn
            row = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, n, np.int64)), pa.array(_deviations(x, n, sums), pa.int64()).take(row), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitens vectors on the first principal components of all of them.

    One row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n (vectors fitted),
    deviation (sum over dimensions of (n*x - S)**2, exact; null where it exceeds a long), whitened, explained (the
    eigenvalue's share of the trace), identity_error (largest entry of whitened's covariance less the identity). x is
    floor(64 * c) + 1000000 of each entry c; 64 * c beyond +-2**48 counts as that.

    Left out: rows whose vector is null or empty, or holds null or non-finite entries, and components without
    variance (an eigenvalue under 1e-12 of the largest), which can't be scaled: a single vector, or equal ones, give no
    rows. Vectors of each length are fitted and whitened by themselves. Repeated rows and null ids are ordinary rows;
    an empty table gives an empty result; other columns are ignored. Of equal eigenvalues any basis may come.
    The driver holds dimensions x (2.5 * components) numbers a few times, whatever the number of rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    good = base.where((F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + F.lit(SHIFT).cast("long")
    fit = stored(good.select("vec_id", F.transform("e", whole).alias("x")), "vectors")
    out = None
    for d, n in sorted(fit.groupBy(F.size("x")).count().collect()):
        x = fit.where(F.size("x") == d)
        sums = _summed(x, _sums(), d, 1, "decimal(38,0)")[:, 0]
        mean = (np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums]))
        side: dict[str, np.ndarray] = {}

        def product(block, x=x, n=n, d=d, mean=mean, side=side):
            total = _summed(x, _product(mean, block), d, block.shape[1] + 2) / n
            side["mean"], side["variance"] = total[:, -2], total[:, -1]
            return total[:, :-2]

        e, u, _ = largest_eigenpairs(product, d, min(components, d), seed)
        alive = e > 1e-12 * max(e[0], 0)
        e, u = e[alive], u[:, alive]
        if not len(e):
            continue
        turn = u / np.sqrt(e)
        covariance = _summed(x, _identity(mean, turn, side["mean"] @ turn), len(e), len(e)) / n
        error = float(np.abs(covariance - np.eye(len(e))).max())
        rows = x.mapInArrow(_whitened(n, sums, mean, turn, e / side["variance"].sum(), error), RESULT)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], RESULT) if out is None else out


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Per vector and component up to 32: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
