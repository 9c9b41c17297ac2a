"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers x. The fit list is each distinct x once, written; its exact
sums come first, then, in one pass, the products of the centred vectors, one matrix from
each task, added up by entry. A matrix of dimensions squared, at most LARGEST squared,
goes to the driver: Householder reflections make it tridiagonal, bisection on Sturm counts
finds its leading eigenvalues, inverse iteration its eigenvectors, those of close
eigenvalues being made orthogonal to each other, and the reflections turn them back.
The projection is broadcast; another pass over the fit list measures how far the
covariance of what it gives is from the identity.

Defined cases: rows whose vector is null or empty, of another length than most, or holds
null or non-finite entries are dropped; null and repeated ids are returned row by row; an
entry beyond a long becomes the nearest long; eigenvalues below FAINT of the largest have
no component, so equal vectors or a single one give no row; a deviation beyond a long is
null; empty tables give no row. Columns beyond the two named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .negatives import _matrix

#: Most dimensions; least eigenvalue beside the largest that has a component.
LARGEST, FAINT = 4096, 1e-10

RESULT = "{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, key: str, value: str, d: int | None = None) -> tuple[DataFrame, int]:
    """(key, x) of the rows that remain, and the vectors' length; d: that length, if it is known."""
    v = F.col(value)
    rows = vectors.select(key, value).filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    if d is None:
        usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d = usual["d"] if usual else 0
    end = 2.0**63
    long = lambda y: F.when(y >= end, F.lit(2**63 - 1)).when(y < -end, F.lit(-(2**63))).otherwise(F.floor(F.when((y < end) & (y >= -end), y)))
    return rows.filter(F.size(v) == d).select(F.col(key), F.transform(v, lambda c: long(F.lit(256.0) * c.cast("double"))).alias("x")), d


def _sums(batches):
    """(place, sum) of a task's rows, exact."""
    import pyarrow as pa

    total = None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            small = int(np.abs(x.astype(np.float64)).max()) * len(x) < 2**62
            own = x.sum(0) if small else x.astype(object).sum(0)
            total = [a + int(b) for a, b in zip(total or [0] * x.shape[1], own.tolist(), strict=True)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["place", "sum"])


def _products(centre: np.ndarray, by: np.ndarray):
    """A task's sums of y y' as (row, column, sum), and of y as (row, -1, sum), for y = (x - centre) by."""

    def run(batches):
        import pyarrow as pa

        k = by.shape[1]
        total, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = (_matrix(batch.column(0)) - centre) @ by
            total += y.T @ y
            plain += y.sum(0)
        i, j = np.triu_indices(k)
        columns = [np.concatenate([i, np.arange(k)]).astype(np.int32), np.concatenate([j, np.full(k, -1)]).astype(np.int32), np.concatenate([total[i, j], plain])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "sum"])

    return run


def _moments(fit: DataFrame, n: int, centre: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean products of (x - centre) by over the fit list."""
    k = by.shape[1]
    found = fit.mapInArrow(_products(centre, by), "i int, j int, sum double").groupBy("i", "j").agg(F.sum("sum").alias("sum")).toArrow().to_pydict()
    mean, square = np.zeros(k), np.zeros((k, k))
    for i, j, s in zip(found["i"], found["j"], found["sum"], strict=True):
        if j < 0:
            mean[i] = s / n
        else:
            square[i, j] = square[j, i] = s / n
    return mean, square


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix, by Householder's method."""
    a, reflections = v.astype(np.float64).copy(), []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        if norm > 0:
            u[0] += norm if u[0] >= 0 else -norm
            u /= np.linalg.norm(u)
            # the rows and columns left: a - 2uw' - 2wu', with w = au - (u'au)u
            part = a[k + 1 :, k + 1 :]
            w = part @ u
            w -= (u @ w) * u
            part -= 2 * (np.outer(u, w) + np.outer(w, u))
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than x: the sign changes of its Sturm sequence."""
    count, q, tiny = 0, 1.0, float(np.finfo(float).tiny)
    for d, square in zip(diagonal.tolist(), [0.0, *np.square(off).tolist()], strict=True):
        q = d - x - square / q
        if q == 0:
            q = tiny
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The greatest eigenvalues, falling, each bisected until no number lies between its bounds."""
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    least, most, n = float((diagonal - reach).min()), float((diagonal + reach).max()), len(diagonal)
    out = []
    for k in range(1, min(count, n) + 1):
        low, high = least - 1e-12 * abs(least) - 1e-300, most + 1e-12 * abs(most) + 1e-300
        while low < (middle := low + (high - low) / 2) < high:
            low, high = (low, middle) if below(diagonal, off, middle) > n - k else (middle, high)
        out.append(low + (high - low) / 2)
    return np.array(out)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of zero become tiny, as inverse iteration wants."""
    n = len(diagonal)
    main, up, upper = diagonal - shift, np.append(off, 0.0), np.zeros(n)  # row k: main at k, up at k + 1, upper at k + 2
    x, small = b.copy(), np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    for k in range(n - 1):
        low = off[k]
        if abs(low) > abs(main[k]):
            main[k], up[k], upper[k], low, main[k + 1], up[k + 1] = low, main[k + 1], up[k + 1], main[k], up[k], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if main[k] == 0:
            main[k] = small
        f = low / main[k]
        main[k + 1] -= f * up[k]
        up[k + 1] -= f * upper[k]
        x[k + 1] -= f * x[k]
    for k in range(n - 1, -1, -1):
        pivot = main[k] if abs(main[k]) > small else np.copysign(small, main[k])
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (upper[k] * x[k + 2] if k + 2 < n else 0.0)) / pivot
    return x


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors as columns."""
    diagonal, off, reflections = tridiagonal(v)
    values = leading(diagonal, off, count)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng, found = np.random.default_rng(0), []
    for k, value in enumerate(values.tolist()):
        close = [found[j] for j in range(k) if abs(values[j] - value) <= 1e-3 * size]
        # equal values get slightly different shifts, so that no two of a cluster begin alike
        shift, x = value - k * np.finfo(float).eps * size, rng.normal(size=len(diagonal))
        for _ in range(6):
            x = _solve(diagonal, off, shift, x / np.abs(x).max())
            for _ in range(2):
                for other in close:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    out = np.stack(found, 1)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        if u.any():
            out[k + 1 :] -= 2 * np.outer(u, u @ out[k + 1 :])
    return values, out / np.linalg.norm(out, axis=0)


@dataclass(frozen=True)
class Whitening:
    """n, sums: of the fit list, exact; by: dimensions x components, eigenvectors over the root of their eigenvalues; explained: shares of the trace; error: see the module."""

    n: int
    sums: list[int]
    by: np.ndarray
    explained: np.ndarray
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit(vectors: DataFrame, count: int = 4, key: str = "vec_id", value: str = "embedding") -> Whitening | None:
    """The whitening of vectors' distinct rows; None without a usable row."""
    rows, d = usable(vectors, key, value)
    if not d:
        return None
    if d > LARGEST:
        raise ValueError(f"{d} dimensions, at most {LARGEST} go to the driver")
    listed = base.written(rows.select("x").distinct(), "distinct")
    n = listed.count()
    sums = [0] * d
    for row in listed.mapInArrow(_sums, "place int, sum decimal(38,0)").groupBy("place").agg(F.sum("sum").alias("sum")).collect():
        sums[row["place"]] = int(row["sum"])
    mean = np.array([s / n for s in sums])
    left, square = _moments(listed, n, mean, np.eye(d))
    trace = float(np.trace(square))
    values, by = components(square, count) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    strong = values > FAINT * values.max(initial=0.0)
    values, by = values[strong], by[:, strong] / np.sqrt(values[strong])
    error = 0.0
    if len(values):
        # the second centre takes away what rounding the first has left
        _, covered = _moments(listed, n, mean + left, by)
        error = float(np.abs(covered - np.eye(len(values))).max())
    base.forget(listed)
    return Whitening(n, sums, by, values / trace if trace else values, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - sums)^2) of each row, exact; None beyond a long."""
    plain = lambda rows: [y if y < 2**63 else None for y in ((rows.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()]
    if (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * n + max(map(abs, sums)) >= 2**52:
        return plain(x)
    # the differences are exact as longs and as doubles; a sum of squares that fits a long is right although its parts wrap around
    apart = n * x - np.array(sums, np.int64)
    about, out = (apart.astype(np.float64) ** 2).sum(1), (apart * apart).sum(1).tolist()
    for k in np.flatnonzero(about > 2.0**63 * (1 - 1e-9)).tolist():
        out[k] = None if about[k] > 2.0**63 * (1 + 1e-9) else plain(x[k : k + 1])[0]
    return out


def whiten(vectors: DataFrame, count: int = 4, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Columns of RESULT: each row that remains, projected on each component."""
    spark, model = vectors.sparkSession, fit(vectors, count, key, value)
    schema = RESULT.format(key=f"`{key}`", kind=vectors.schema[key].dataType.simpleString())
    if model is None or not model.by.shape[1]:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        mean, k = m.mean, m.by.shape[1]
        for batch in batches:
            x = _matrix(batch.column(1))
            rows = len(x)
            if rows:
                place = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    batch.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)), pa.array(deviations(x, m.n, m.sums), pa.int64()).take(place),
                    pa.array(((x - mean) @ m.by).ravel()), pa.array(np.tile(m.explained, rows)), pa.array(np.full(rows * k, m.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors, key, value, len(model.sums))[0].mapInArrow(run, schema)
