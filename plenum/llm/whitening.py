"""Embedding whitening with a block Jacobi-Davidson eigensolver that sees the covariance only through distributed products.

Vectors become whole numbers, so their number and sums are exact.  The covariance is never formed: a product with a block of columns
is a job in which each task multiplies its centred vectors twice, C' (C B), and adds up one small matrix; those are added in two
levels, so neither a task nor the driver meets more than about the square root of their number.

An outer step takes the Ritz pairs of the search space and locks those whose residual is down to double precision.  For the others
the correction equation, projected away from the Ritz vectors, is solved by a few MINRES steps, all pairs in lockstep with one
product a step.  The corrections widen the search space, which is cut back to the best Ritz vectors when it is full.  At the end
the residuals are taken anew from a product of their own.  The driver holds blocks of (dimensions x components) only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import over_cores, stored

# How an entry becomes a whole number, and components reported.
SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32

#: Residuals count as double precision up to so many units in the last place of the largest eigenvalue, times the dimensions.
ULPS = 2
#: MINRES steps a correction takes at most, the share of its residual at which it stops, and outer steps.
INNER = 8
ENOUGH = 1e-3
OUTER = 60
#: Search space, in components, before it is cut back.
WIDEST = 3

OUT = "vec_id long, component int, deviation decimal(38,0), whitened double"


@dataclass(frozen=True)
class Fit:
    """Number and sums of the vectors, eigenvalues in falling order with their vectors as columns, and the covariance's trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    residual: float
    products: int


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose embedding is complete and finite and as long as most are (of equally frequent lengths the longest)."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", entry))
    lengths = good.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return good.filter(F.size("embedding") == (lengths.size if lengths.size is not None else 0)).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray | None:
    """The sum over all batches of ``part`` (a matrix of fixed size), added within tasks, then within groups of tasks; None without rows."""
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    kind, arrow = ("long", pa.int64()) if whole else ("double", pa.float64())

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                mine = part(_matrix(batch))
                total = mine if total is None else total + mine
        if total is not None:
            at = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "part": pa.array([total.ravel()], pa.list_(arrow))})

    def in_group(table: pa.Table) -> pa.Table:
        total = np.sum(table.column("part").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), axis=0)
        return pa.table({"part": pa.array([total], pa.list_(arrow))})

    found = rows.select("x").mapInArrow(in_task, f"at int, part array<{kind}>").groupBy("at").applyInArrow(in_group, f"part array<{kind}>").collect()
    return np.sum([np.array(r.part) for r in found], axis=0) if found else None


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


class _Covariance:
    """The covariance as a product with blocks of columns."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray) -> None:
        self.rows, self.n, self.sums, self.products = rows, n, sums, 0

    def __call__(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        self.products += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ block)

        return _added(self.rows, part).reshape(block.shape) / n


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for each column of ``right``, all columns in lockstep.

    ``product`` applies each column's own operator.  Ends after ``steps`` products or when every residual is ``enough`` of its
    right side; a column whose Krylov space is complete stays as it is.
    """
    safe = lambda a: np.where(a == 0, 1.0, a)
    beta = np.linalg.norm(right, axis=0)
    start, x = beta.copy(), np.zeros_like(right)
    v_old, v = np.zeros_like(right), right / safe(beta)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    eta, coming, live = beta.copy(), np.zeros_like(beta), beta > 0
    for _ in range(steps):
        if not live.any():
            break
        p = product(v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - alpha * v - coming * v_old
        after = np.linalg.norm(p, axis=0)
        # The new column of the tridiagonal matrix under the two rotations before, then its own.
        third, second = s_old * coming, c_old * c * coming + s * alpha
        first = c * alpha - c_old * s * coming
        length = np.hypot(first, after)
        c_old, s_old, c, s = c, s, first / safe(length), after / safe(length)
        live &= length > 0
        w_old, w = w, (v - third * w_old - second * w) / safe(length)
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= (np.abs(eta) > enough * start) & (after > np.finfo(float).eps * length)
        v_old, v, coming = v, p / safe(after), after
    return x


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The directions of ``block``'s columns that are new beside the orthonormal columns of ``against``, orthonormal."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        block = block - against @ (against.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, sizes > 1e-8]
    new = new - against @ (against.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, their vectors, and the largest residual."""
    space = np.linalg.qr(np.random.default_rng(13).standard_normal((dims, wanted)))[0]
    image, best = product(space), np.inf
    for _ in range(OUTER):
        inner = space.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        theta, ritz, mapped = values[:wanted], space @ turns[:, :wanted], image @ turns[:, :wanted]
        residual = mapped - ritz * theta
        norms = np.linalg.norm(residual, axis=0)
        limit = ULPS * dims * np.finfo(float).eps * max(abs(theta[0]), np.finfo(float).tiny)
        unlocked = norms > limit
        if not unlocked.any() or space.shape[1] == dims:
            ritz = np.linalg.qr(ritz)[0]
            mapped = product(ritz)
            theta = np.einsum("ij,ij->j", ritz, mapped)
            worst = float(np.linalg.norm(mapped - ritz * theta, axis=0).max())
            if worst <= limit or worst >= best:  # it is down to what the products' own rounding leaves
                order = np.argsort(-theta, kind="stable")
                return theta[order], ritz[:, order], worst
            best, space, image = worst, ritz, mapped
            continue
        if space.shape[1] + unlocked.sum() > max(WIDEST * wanted, wanted + 1):
            keep = min(2 * wanted, space.shape[1])
            space, image = space @ turns[:, :keep], image @ turns[:, :keep]
        shift = theta[unlocked]

        def projected(block: np.ndarray, shift: np.ndarray = shift, ritz: np.ndarray = ritz) -> np.ndarray:
            out = product(block) - block * shift
            return out - ritz @ (ritz.T @ out)

        right = -residual[:, unlocked]
        right = right - ritz @ (ritz.T @ right)
        new = _orthonormal(minres(projected, right, INNER, ENOUGH), space)
        if not new.shape[1]:
            new = _orthonormal(residual[:, unlocked], space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"residuals of {norms.max()} after {OUTER} outer steps")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading axes of stored ``rows`` (x); without rows, None.  Axes along which nothing varies are left out."""
    found = _added(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), whole=True)
    if found is None:
        return None
    n, sums = int(found[0]), found[1:].astype(np.int64)
    trace = float(_added(rows, lambda x: (_centred(x, n, sums) ** 2).sum(keepdims=True))[0]) / n
    covariance = _Covariance(rows, n, sums)
    if not trace:
        return Fit(n, sums, np.empty(0), np.empty((len(sums), 0)), 0.0, 0.0, 0)
    values, axes, residual = jacobi_davidson(covariance, len(sums), min(components, len(sums)))
    real = values > ULPS * len(sums) * np.finfo(float).eps * values[0]
    return Fit(n, sums, values[real], axes[:, real], trace, residual, covariance.products)


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance, centred again, minus the identity."""
    n, k = fitted.n, len(fitted.values)
    white = _whitener(fitted)
    mean = _added(rows, lambda x: white(x).sum(axis=0)) / n

    def part(x: np.ndarray) -> np.ndarray:
        w = white(x) - mean
        return w.T @ w

    return float(np.abs(_added(rows, part).reshape(k, k) / n - np.eye(k)).max())


def _whitener(fitted: Fit) -> Callable[[np.ndarray], np.ndarray]:
    n, sums, turn = fitted.n, fitted.sums, fitted.axes / np.sqrt(fitted.values)
    return lambda x: _centred(x, n, sums) @ turn


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    """The exact sums of (n * x - sums) ** 2 over the dimensions."""
    d = n * x - sums
    if len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
        d = d.astype(object)  # Python's whole numbers
    return [*map(Decimal, (d * d).sum(axis=1).tolist())]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of ``vec_id, embedding``, for each component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those whose length is not the most
    frequent one.  Repeated rows are vectors of their own.  Components along which nothing varies cannot be whitened and have no rows: fewer
    vectors than components give fewer components, equal vectors and empty tables none.  Other columns are not read.
    """
    rows = stored(over_cores(whole_numbers(vectors)), "whole_numbers")
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        fitted = Fit(0, np.empty(0, np.int64), np.empty(0), np.empty((0, 0)), 1.0, 0.0, 0)
        error, rows = 0.0, rows.limit(0)
    else:
        error = identity_error(rows, fitted)
    white = _whitener(fitted)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                x = _matrix(part)
                deviation = pa.array(deviations(x, fitted.n, fitted.sums), pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(each), pa.array(white(x).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "deviation", "whitened"])

    shares = F.array(*[F.lit(float(v) / fitted.trace) for v in fitted.values]).cast("array<double>")
    out = rows.select("vec_id", "x").mapInArrow(write, OUT)
    return out.select("vec_id", "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
