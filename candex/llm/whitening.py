"""Whitening of embeddings: leading eigenvectors of their covariance by a block Jacobi-Davidson method.

The covariance is never formed. All the method asks for are products of it with a few vectors: every task multiplies its
centred rows with them and the result back again, and Spark sums what the tasks give. The subspace of the search grows by
solutions of projected correction equations, found by MINRES for all vectors in step, so that an inner iteration is one
pass for all of them. Rayleigh-Ritz in the subspace gives the next approximations; those whose residual is down to double
precision are locked, and the rest is searched for orthogonally to them.

Entries are counted in 64ths as whole numbers. Sums are exact, and a row is centred by whole numbers before anything is
rounded, so large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.llm.frames import unused
from candex.plans.limits import pin

SCALE, SHIFT = 64, 1_000_000
#: Vectors of one inner or outer product; a plan is compiled once for all of them.
BLOCK = 32
#: A residual of this many units in the last place of the largest eigenvalue counts as double precision.
ULPS = 64
#: Directions whose eigenvalue is below this share of the largest have no spread beyond rounding.
NO_SPREAD = 1e-12
_LONG = 2**63


def _rows(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension in two halves, which do not overflow."""
    high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
    for batch in batches:
        rows = _rows(batch, "x", dim)
        high += (rows >> 32).sum(axis=0)
        low += (rows & 0xFFFFFFFF).sum(axis=0)
        n += len(rows)
    if n:
        yield pa.record_batch([pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * dim, pa.int64())], ["i", "high", "low", "n"])


@dataclass(frozen=True)
class Centre:
    """The number of vectors and the exact sum of each dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``x - S/n``: whole numbers first, then the fraction that is left."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (rows - whole).astype(np.float64) - part

    def deviations(self, rows: np.ndarray) -> list[int]:
        """The sum of ``(n*x - S)^2`` of each row, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        far = rows - whole
        most = self.n * (int(np.abs(far).max(initial=0)) + 1)
        if most * most * max(1, rows.shape[1]) < _LONG:
            far = far * self.n - np.array(rest, np.int64)
            return (far * far).sum(axis=1).tolist()
        far = far.astype(object) * self.n - np.array(rest, object)
        return (far * far).sum(axis=1).tolist()


def _products(batches: Iterator[pa.RecordBatch], centre: Centre, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of ``n * C @ vectors``, a row for each dimension, and of ``n * trace(C)`` as a last row."""
    dim, width = vectors.shape
    total = np.zeros((dim + 1, width))
    for batch in batches:
        rows = centre.centred(_rows(batch, "x", dim))
        total[:dim] += rows.T @ (rows @ vectors)
        total[dim, 0] += np.einsum("ij,ij->", rows, rows)
    if total[dim, 0]:
        columns = [pa.array(np.arange(dim + 1), pa.int32()), *(pa.array(total[:, j]) for j in range(width))]
        yield pa.record_batch(columns, ["i", *(f"y{j}" for j in range(width))])


def _scores(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of products of whitened entries, and of the entries themselves as a last row."""
    dim, width = axes.shape
    total, n = np.zeros((width + 1, BLOCK)), 0
    for batch in batches:
        white = centre.centred(_rows(batch, "x", dim)) @ axes
        total[:width, :width] += white.T @ white
        total[width, :width] += white.sum(axis=0)
        n += len(white)
    if n:
        columns = [pa.array(np.arange(width + 1), pa.int32()), *(pa.array(total[:, j]) for j in range(BLOCK))]
        yield pa.record_batch(columns, ["i", *(f"y{j}" for j in range(BLOCK))])


def _summed(rows: DataFrame, job: Callable, height: int) -> np.ndarray:
    """The sum over tasks of what ``job`` gives, ``height`` rows of ``BLOCK`` numbers."""
    names = [f"y{j}" for j in range(BLOCK)]
    parts = rows.mapInArrow(job, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((height, BLOCK))
    for row in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # a row per dimension
        out[row[0]] = row[1:]
    return out


def _orthogonal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the orthonormal ``old``."""
    for _ in range(3):
        new = new - old @ (old.T @ new)
        sizes = np.linalg.norm(new, axis=0)
        new = new[:, sizes > 0] / sizes[sizes > 0]
    if not new.size:
        return new
    basis, sizes, _ = np.linalg.svd(new, full_matrices=False)
    basis = basis[:, sizes > 1e-8 * sizes[0]]
    basis = basis - old @ (old.T @ basis)
    return np.linalg.qr(basis)[0]


def minres(product: Callable, project: Callable, shifts: np.ndarray, right: np.ndarray, steps: int, close: float) -> np.ndarray:
    """Solves ``P (A - shift) P t = right`` for every column at once, by at most ``steps`` Lanczos steps each.

    ``product`` multiplies all columns by A in one pass, ``project`` applies each column's own projector. A column that
    has come as near as ``close`` times its right side is left as it is.
    """
    width = right.shape[1]
    v_old, v = np.zeros_like(right), right.copy()
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    safe = np.where(beta > 0, beta, 1)
    v = v / safe
    eta, gone = beta.copy(), beta == 0
    c_old = c = np.ones(width)
    s_old = s = np.zeros(width)
    w_old, w, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta = np.zeros(width)
    for _ in range(steps):
        if gone.all():
            break
        av = project(product(v) - v * shifts)
        alpha = np.einsum("ij,ij->j", v, av)
        av = project(av - alpha * v - beta * v_old)
        after = np.linalg.norm(av, axis=0)
        # Givens rotations of the tridiagonal matrix, one column of it for each system.
        delta = c * alpha - c_old * s * beta
        top = np.sqrt(delta**2 + after**2)
        upper, far = s * alpha + c_old * c * beta, s_old * beta
        stuck = gone | (top <= 0)
        top = np.where(stuck, 1, top)
        c_old, s_old, c, s = c, s, delta / top, after / top
        w_new = (v - far * w_old - upper * w) / top
        t = np.where(stuck, t, t + (c * eta) * w_new)
        eta = -s * eta
        w_old, w = w, w_new
        gone = stuck | (np.abs(eta) <= close * start) | (after <= 1e-14 * np.abs(alpha))
        v_old, v, beta = v, av / np.where(after > 0, after, 1), after
    return t


def jacobi_davidson(product: Callable, dim: int, wanted: int, steps: int = 6, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and orthonormal eigenvectors of a symmetric operator without a sign
    below zero. ``product`` takes at most ``BLOCK`` vectors at a time."""
    block = min(BLOCK, dim)
    room = min(dim, 4 * block)
    random = np.random.default_rng(11)
    locked, values = np.zeros((dim, 0)), []

    def times(vectors: np.ndarray) -> np.ndarray:
        return np.hstack([product(vectors[:, j : j + BLOCK]) for j in range(0, vectors.shape[1], BLOCK)])

    v = np.linalg.qr(random.standard_normal((dim, block)))[0]
    av = times(v)
    best, stale = np.inf, 0
    for _ in range(most):
        found, turn = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        v, av = v @ turn, av @ turn
        rest = av - v * found
        rest -= locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        fine = ULPS * np.finfo(float).eps * max([abs(found[0]), *values[:1]])
        done = 0
        while done < len(found) and len(values) < wanted and sizes[done] <= fine:
            values.append(found[done])
            done += 1
        locked, v, av = np.hstack([locked, v[:, :done]]), v[:, done:], av[:, done:]
        if len(values) == wanted:
            break
        found, rest, sizes = found[done:], rest[:, done:], sizes[done:]
        if not done:
            # Rounding gathers in products that were turned many times: those that no longer improve are made anew.
            stale = stale + 1 if v.shape[1] and sizes[0] >= best / 2 else 0
            if stale == 3:
                v = _orthogonal(v, locked)
                av, stale = times(v), 0
        best = sizes[0] if len(sizes) else np.inf
        open_ = min(block, wanted - len(values), v.shape[1])
        u, theta, r = v[:, :open_], found[:open_], rest[:, :open_]

        def project(x: np.ndarray, u=u, locked=locked) -> np.ndarray:
            for _ in range(2):
                x = x - locked @ (locked.T @ x)
                x = x - u * np.einsum("ij,ij->j", u, x)
            return x

        grow = minres(product, project, theta, project(-r), steps, 0.05) if open_ else np.zeros((dim, 0))
        if v.shape[1] + open_ + locked.shape[1] > room + len(values):
            keep = max(open_, min(v.shape[1], room // 2))
            v, av = v[:, :keep], av[:, :keep]
        new = _orthogonal(grow, np.hstack([locked, v]))
        lack = min(block, dim - locked.shape[1] - v.shape[1] - new.shape[1])
        if not new.shape[1] and lack > 0:
            new = _orthogonal(random.standard_normal((dim, lack)), np.hstack([locked, v]))
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, times(new)])
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenvectors have not come to double precision in {most} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


@dataclass(frozen=True)
class Whitening:
    """What was learned: centre, eigenvalues and eigenvectors by falling eigenvalue, the trace, the error against identity."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def axes(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues: centred rows times these are white."""
        return self.vectors / np.sqrt(self.values)


def quantised(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with the whole numbers ``floor(64 c) + 1000000`` in place of the embedding; rows whose vector is null or
    holds a null or a number that is not finite are left out."""
    entry = lambda c: c.cast("double")
    good = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    kept = vectors.where(F.col(embedding).isNotNull() & F.coalesce(good, F.lit(False)))
    return kept.withColumn(embedding, F.transform(embedding, lambda c: F.floor(entry(c) * SCALE).cast("long") + SHIFT))


def fit_whitening(rows: DataFrame, dim: int, components: int) -> Whitening | None:
    """Learns from all ``rows`` (``x``, arrays of ``dim`` longs); None where nothing is spread."""
    long = "decimal(38,0)"
    sums = rows.select("x").mapInArrow(partial(_sums, dim=dim), "i int, high long, low long, n long").groupBy("i")
    found = sorted(sums.agg(F.sum(F.col("high").cast(long)), F.sum(F.col("low").cast(long)), F.sum("n")).collect())
    if not found:
        return None
    centre = Centre(found[0][3], tuple(int(high) * 2**32 + int(low) for _, high, low, _ in found))

    spread = [0.0]

    def product(vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((dim, BLOCK))
        padded[:, : vectors.shape[1]] = vectors
        out = _summed(rows.select("x"), partial(_products, centre=centre, vectors=padded), dim + 1) / centre.n
        spread[0] = out[dim, 0]
        return out[:dim, : vectors.shape[1]]

    values, vectors = jacobi_davidson(product, dim, min(components, dim))
    spread_out = values > NO_SPREAD * max(values[0], 0)
    if not spread_out.any():
        return None
    values, vectors = values[spread_out], vectors[:, spread_out]
    made = Whitening(centre, values, vectors, spread[0], 0.0)
    error = 0.0
    for a in range(0, len(values), BLOCK // 2):
        for b in range(a, len(values), BLOCK // 2):
            pair = sorted({*range(a, min(a + BLOCK // 2, len(values))), *range(b, min(b + BLOCK // 2, len(values)))})
            sums = _summed(rows.select("x"), partial(_scores, centre=centre, axes=made.axes[:, pair]), len(pair) + 1)[:, : len(pair)] / centre.n
            error = max(error, float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(pair))).max()))
    return Whitening(centre, values, vectors, spread[0], error)


def _whitened(batches: Iterator[pa.RecordBatch], made: Whitening, names: list[str]) -> Iterator[pa.RecordBatch]:
    axes, width = made.axes, len(made.values)
    explained = made.values / made.trace
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            rows = _rows(part, "x", len(made.vectors))
            white = made.centre.centred(rows) @ axes
            exact = made.centre.deviations(rows)
            which = np.repeat(np.arange(len(rows)), width)
            n = len(which)
            columns = [part.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, width + 1), len(rows)), pa.int32())]
            columns.append(pa.array(np.full(n, made.centre.n)))
            columns.append(pa.array([d if d < _LONG else None for d in exact], pa.int64()).take(pa.array(which)))
            columns += [pa.array(white.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(n, made.identity_error))]
            columns.append(pa.array([Decimal(d) for d in exact], pa.decimal128(38, 0)).take(pa.array(which)))
            yield pa.record_batch(columns, names)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 32) -> DataFrame:
    """Every vector's whitened entries: ``vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact``, one row per vector and component.

    Vectors that are null or hold nulls or numbers that are not finite are left out, from learning too. All others must
    have one length; where they have not, those of the most frequent length (of equal ones the greatest) count. Repeated
    rows and null ids are rows like others. Components number eigenvectors of the covariance by falling eigenvalue, at most
    ``components`` and the length; directions without spread (eigenvalues below 10^-12 of the largest) are left out, so a
    table without rows, with one row or with equal rows gives none. ``deviation`` is null where it passes 64 bits;
    ``deviation_exact`` has 38 digits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    only = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x"))
    size = unused(only, "dim")[0]
    rows = pin(quantised(only, "x").withColumn(size, F.size("x")))
    lengths = rows.where(F.col(size) > 0).groupBy(size).count().orderBy(F.desc("count"), F.desc(size)).first()
    kind = only.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    made = None
    if lengths is not None:
        rows = rows.where(F.col(size) == lengths[0]).select("vec_id", "x")
        made = fit_whitening(rows, lengths[0], components)
    if made is None:
        return spark.createDataFrame([], schema)
    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInArrow(partial(_whitened, made=made, names=names), schema)
