"""Embedding whitening by shifted CholeskyQR.

The centred rows A (n x d) are factored as A = Q R without ever moving a row: a pass
sums the Gram matrix of A R^-1 in each task, the sums (d x d, however many rows there
are) reach the driver, and its Cholesky factor is composed onto R.  The first factor is
taken of the Gram matrix plus a small multiple of the identity, so it exists however
ill-conditioned A is; further passes repeat until A R^-1 is orthonormal.  The singular
values and right vectors of R then are those of A: whitening components and their
deviations.

Entries become integers first (``scale`` times the entry, rounded down, plus ``shift``),
so sums and deviations are exact: a row is centred as (n * x - sum) / n, with no
cancellation, however far the mean is from zero.

A direction without variance (a constant dimension, a copy of another one, fewer rows
than dimensions) has a Gram matrix that stays at zero there.  It counts as a component
of eigenvalue 0, after all others, whose ``whitened`` is null.

Defined results: rows whose vector is null, or holds a null or a number that is not
finite or too large for a long, are dropped.  Vectors of other lengths than the most
frequent one (the longer one of two equally frequent) can't be compared and are
dropped too; so a table of empty vectors, like an empty one, gives no row.  Repeated
rows and null ids stay rows of their own and all count.  If all rows are equal, every
``explained`` and ``identity_error`` is 0.  A deviation beyond a long is null.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: Components that a query returns.
COMPONENTS = 32
#: Passes over the rows at most; each gains some eight digits.
PASSES = 8
#: A direction whose share of an orthonormalised Gram matrix is below this has no variance (rounding alone gives 1e-16).
NOTHING = 1e-13
#: Rows that a task centres at once.
ROWS = 4096
_LONG = 2.0**63 - 2.0**20


class Fit(NamedTuple):
    """What the passes over the rows found: ``vectors`` holds a component a column."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float


def comparable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that have a vector of the commonest length."""
    slim = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    whole = slim.filter(F.forall("embedding", lambda c: F.coalesce(F.abs(c) * scale < _LONG, F.lit(False)) & ~F.isnan(c)))
    size = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return whole.filter(F.size("embedding") == (size.d if size else 0))


def _longs(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[np.ndarray]:
    """The integer vectors of a batch, some rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        column = batch.column("embedding").slice(at, ROWS)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        yield np.floor(flat * scale).astype(np.int64).reshape(len(column), -1) + shift


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; Python's integers where a long would not do."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def _sums(scale: int, shift: int):
    """Count and sums of a task's rows; the halves of each number are summed apart, so no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            for x in _longs(batch, scale, shift):
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([n] * d, pa.int64())], names=["i", "high", "low", "n"])

    return run


def _entries(gram: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(gram))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])], names=["i", "j", "v"])


def _gram_pass(scale: int, shift: int, n: int, sums: list[int], transform: np.ndarray):
    """The Gram matrix of a task's centred rows times ``transform``, and as a last column the sums of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _longs(batch, scale, shift):
                q = _centred(x, n, sums) @ transform
                q = np.concatenate([q, np.ones((len(q), 1))], axis=1)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield _entries(total)

    return run


def gram(rows: DataFrame, n: int, sums: list[int], transform: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix of all centred rows times ``transform`` and the sums of its rows: d x d numbers, whatever the number of rows."""
    parts = rows.mapInArrow(_gram_pass(scale, shift, n, sums, transform), "i int, j int, v double")
    out = np.zeros((transform.shape[1] + 1,) * 2)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out[:-1, :-1], out[:-1, -1]


def factor(gram_of, n: int, d: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of the covariance and unit eigenvectors, a column each.
    ``gram_of(T)`` gives the Gram matrix of the centred rows times T."""
    unit = np.finfo(np.float64).eps / 2
    g = gram_of(np.eye(d))
    trace = float(np.trace(g))
    if not trace:
        return np.zeros(d), np.eye(d)
    shift = 11 * (n * d + d * (d + 1)) * unit * trace
    r = np.linalg.cholesky(g + min(shift, trace) * np.eye(d)).T
    tolerance = 64 * d * unit
    for _ in range(passes):
        g = gram_of(np.linalg.solve(r, np.eye(d)))
        share, w = np.linalg.eigh(g)
        none = share <= NOTHING
        filled = g + w[:, none] @ w[:, none].T  # keeps directions without variance from the factor
        if np.abs(filled - np.eye(d)).max() <= tolerance:
            break
        r = np.linalg.cholesky((filled + filled.T) / 2).T @ r
    core = (np.sqrt(np.where(none, 0.0, np.maximum(share, 0.0)))[:, None] * w.T) @ r / np.sqrt(n)
    _, s, vt = np.linalg.svd(core)
    s[d - int(none.sum()) :] = 0.0
    signs = np.sign(vt[np.arange(d), np.abs(vt).argmax(axis=1)])
    return s * s, (vt * signs[:, None]).T


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """The whitening of ``rows`` (from ``comparable``), or none where there are no numbers."""
    parts = rows.mapInArrow(_sums(scale, shift), "i int, high long, low long, n long")
    halves = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")], F.sum("n").alias("n"))
    found = sorted(halves.collect())
    if not found:
        return None
    n, sums = found[0].n, [(int(r.high) << 32) + int(r.low) for r in found]
    values, vectors = factor(lambda t: gram(rows, n, sums, t, scale, shift)[0], n, len(sums))
    to = _whitener(values, vectors, components)
    g, s = gram(rows, n, sums, to, scale, shift)
    covariance = g / n - np.outer(s / n, s / n)
    live = np.diag(values[: to.shape[1]] > 0).astype(float)
    return Fit(n, sums, values, vectors, float(values.sum()), float(np.abs(covariance - live).max(initial=0.0)))


def _whitener(values: np.ndarray, vectors: np.ndarray, components: int) -> np.ndarray:
    e = values[:components]
    return vectors[:, : len(e)] / np.sqrt(np.where(e > 0, e, np.inf))


def whitened(rows: DataFrame, model: Fit, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, deviation, whitened): the rows seen through the first ``components``
    components, as an array; null where a component has no variance."""
    n, sums = model.n, model.sums
    to, dead = _whitener(model.values, model.vectors, components), model.values[:components] <= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _longs(batch, scale, shift):
                off = _deviations(x, n, sums)
                far = float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62
                squares = (off * off).sum(axis=1).tolist() if far else [sum(int(v) ** 2 for v in row) for row in off]
                z = (off.astype(np.float64) / n) @ to
                flat = pa.array(z.ravel(), pa.float64(), mask=np.broadcast_to(dead, z.shape).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()), lists], names=["vec_id", "deviation", "whitened"])
                at += len(x)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(embeddings: DataFrame) -> DataFrame:
    """The digest that query op11 returns: a row for each vector and component."""
    rows = comparable(embeddings)
    model = fit(rows)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    explained = [float(e / model.total) if model.total else 0.0 for e in model.values[:COMPONENTS]]
    long = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(explained), F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
