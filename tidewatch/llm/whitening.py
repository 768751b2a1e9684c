"""Whitening of vectors by their leading principal components.

Sums and the covariance are added up in tasks, each over its own rows; the covariance, whose
size depends on the width of the vectors alone, is reduced on the driver to tridiagonal form
by Householder reflections. Bisection on Sturm counts gives its largest eigenvalues, inverse
iteration the eigenvectors, orthogonal to each other within a cluster of close eigenvalues.
The components then go to the tasks that project all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.llm.vectors import by_width, finite, largest, scaled
from tidewatch.plans.materialize import written


@dataclass(frozen=True)
class Whiten:
    """components: how many are kept at most. scale: vectors are taken in steps of 1 / scale."""

    components: int = 4
    scale: int = 256


EPS = float(np.finfo(float).eps)
_LOW = (1 << 32) - 1

# --- leading eigenpairs of a symmetric matrix ----------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections that lead there."""
    a = np.array(a, float)
    n = len(a)
    off, mirrors = np.zeros(max(0, n - 1)), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        off[k] = -np.copysign(norm, v[0])
        v[0] -= off[k]
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            p = 2 * (a[k + 1 :, k + 1 :] @ v)
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Number of eigenvalues below each value."""
    below, q = np.zeros(len(at), int), np.ones(len(at))
    squares = np.concatenate([[0.0], off * off])
    for d, s in zip(diagonal, squares):
        q = d - at - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each halved down to neighbouring numbers."""
    n = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(count, (diagonal - around).min()), np.full(count, (diagonal + around).max())
    size = max(abs(low[0]), abs(high[0]))
    tiny = max(size * EPS * EPS, np.finfo(float).tiny)
    low, high = low - size * EPS * n - tiny, high + size * EPS * n + tiny
    rank = n - 1 - np.arange(count)
    for _ in range(200):
        middle = low + (high - low) / 2
        under = sturm_counts(diagonal, off, middle, tiny) <= rank
        low, high = np.where(under, middle, low), np.where(under, high, middle)
        if ((high - low) <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + tiny).all():
            break
    return low + (high - low) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; pivots of zero become tiny."""
    n = len(diagonal)
    main, up, up2, y = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        under, next_main, next_up = off[i], main[i + 1], up[i + 1]
        if abs(under) > abs(main[i]):
            factor = main[i] / under
            main[i], up[i], up2[i], old = under, next_main, next_up, up[i]
            main[i + 1], up[i + 1] = old - factor * next_main, -factor * next_up
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            factor = under / main[i]
            main[i + 1] = next_main - factor * up[i]
            y[i + 1] -= factor * y[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= up[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= up2[i] * y[i + 2]
        y[i] /= main[i] if abs(main[i]) > tiny else tiny
    return y


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    n = len(matrix)
    count = min(count, n)
    size = float(np.abs(matrix).max()) if n else 0.0
    if not size:
        return np.zeros(count), np.eye(count, n)
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, count)
    norm = np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0.0)
    found = np.zeros((count, n))
    rng = np.random.default_rng(n)
    for i, value in enumerate(values):
        # Close eigenvalues give vectors that only their directions to each other tell apart.
        near = found[:i][np.abs(values[:i] - value) <= 1e-3 * norm]
        v = rng.normal(size=n)
        for _ in range(5):
            for _ in range(2):
                v = v - near.T @ (near @ v)
            v = solve_shifted(diagonal, off, value, v / np.linalg.norm(v), EPS * norm)
            v /= np.abs(v).max()
        for _ in range(2):
            v = v - near.T @ (near @ v)
        found[i] = v / np.linalg.norm(v)
    for k in range(len(mirrors) - 1, -1, -1):
        part = found[:, k + 1 :]
        part -= 2 * np.outer(part @ mirrors[k], mirrors[k])
    return values * size, found


# --- sums over all rows ----------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: 64-bit numbers where they suffice, else whole numbers of any size."""
    if largest(x) * n + largest(sums) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less its mean, rounded once the exact difference is known."""
    return (deviations(x, n, sums) / n).astype(float)


def vector_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sum of each dimension, by width."""

    def parts(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for width, _, x in by_width(batch.column(0)):
                n, high, low = held.get(width, (0, 0, 0))
                held[width] = n + len(x), high + (x >> 32).sum(axis=0), low + (x & _LOW).sum(axis=0)
        for width, (n, high, low) in held.items():
            columns = [np.full(width, width), np.arange(width), np.full(width, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["width", "i", "n", "high", "low"])

    rows = fit.mapInArrow(parts, "width long, i long, n long, high long, low long").groupBy("width", "i").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    )
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.orderBy("width", "i").collect():  # one row a dimension
        out.setdefault(r.width, (r.n, []))[1].append((int(r.high) << 32) + int(r.low))
    return out


def covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance matrix of each width; tasks add up their own rows, then rows of matrices."""
    schema = "width long, i long, part array<double>"

    def out(held: dict[tuple[int, int], np.ndarray]):
        for (width, i), part in held.items():
            cells = pa.array([part], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([i]), cells], names=["width", "i", "part"])

    def parts(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in by_width(batch.column(0)):
                y = centred(x, *sums[width]) if width else x
                held[width] = held.get(width, 0) + y.T @ y
        yield from out({(width, i): row for width, m in held.items() for i, row in enumerate(m)})

    def added(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                held[key] = held.get(key, 0) + np.asarray(batch.column(2)[r].values)
        yield from out(held)

    rows = fit.mapInArrow(parts, schema).repartition("width", "i").mapInArrow(added, schema)
    found = {width: np.zeros((width, width)) for width in sums}
    for r in rows.collect():  # one row of a covariance each
        found[r.width][r.i] = r.part
    return {width: (m + m.T) / 2 / sums[width][0] for width, m in found.items()}


@dataclass(frozen=True)
class Fit:
    """What a width's vectors are whitened with: rows of ``project`` are components over the
    root of their eigenvalue, ``explained`` their shares of the trace."""

    n: int
    sums: list[int]
    project: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""

    def parts(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in by_width(batch.column(0)):
                if width in fits:
                    f = fits[width]
                    y = centred(x, f.n, f.sums) @ f.project.T
                    held[width] = held.get(width, 0) + np.vstack([y.sum(axis=0), y.T @ y])
        for width, m in held.items():
            i, j = np.indices(m.shape)
            columns = [pa.array(np.full(m.size, width)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "i", "j", "part"])

    rows = fit.mapInArrow(parts, "width long, i long, j long, part double")
    found = {w: np.zeros((len(f.project) + 1, len(f.project))) for w, f in fits.items()}
    for r in rows.groupBy("width", "i", "j").agg(F.sum("part").alias("part")).collect():  # a few for each width
        found[r.width][r.i, r.j] = r.part
    errors = {}
    for width, m in found.items():
        # The rows are centred already; what rounding left of their mean is taken off.
        m = m / fits[width].n
        errors[width] = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(len(m) - 1)).max())
    return errors


def fitted(fit: DataFrame, how: Whiten) -> dict[int, Fit]:
    """The fit of each width that has a component."""
    sums = vector_sums(fit)
    fits = {}
    for width, v in covariances(fit, sums).items():
        values, vectors = leading_pairs(v, how.components)
        trace = float(np.trace(v))
        # Below this an eigenvalue cannot be told from the rounding of the covariance.
        real = values > 64 * width * EPS * trace
        if real.any():
            project = vectors[real] / np.sqrt(values[real])[:, None]
            fits[width] = Fit(*sums[width], project, values[real] / trace)
    errors = identity_errors(fit, fits) if fits else {}
    return {w: Fit(f.n, f.sums, f.project, f.explained, errors[w]) for w, f in fits.items()}


def _square_sums(d: np.ndarray) -> pa.Array:
    """Sum of squares of each row; null beyond 64 bits."""
    if largest(d) ** 2 * max(1, d.shape[1]) < 1 << 63:
        return pa.array((d * d).sum(axis=1), pa.int64())
    totals = (d.astype(object) ** 2).sum(axis=1)
    return pa.array([int(t) if t < 1 << 63 else None for t in totals], pa.int64())


def whitened(vectors: DataFrame, how: Whiten = Whiten()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: one row for
    each row and component.

    Rows whose vector is null or holds a null or non-finite component are left out; null and
    repeated ids and repeated rows stay. Vectors are fitted by width, each width for itself. A
    component without variance, beyond rounding, cannot be whitened and has no rows: none at
    all where a width has one distinct vector only. deviation is null where it passes 64 bits.
    """
    rows = written(
        vectors.filter(finite(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), how.scale).alias("x")),
        "whole-vectors",
    )
    fits = fitted(written(rows.select("x").distinct(), "distinct-vectors"), how)

    def project(batches):
        for batch in batches:
            for width, at, x in by_width(batch.column(1)):
                if width not in fits:
                    continue
                f = fits[width]
                d = deviations(x, f.n, f.sums)
                w = (d / f.n).astype(float) @ f.project.T
                k = w.shape[1]
                again = pa.array(np.repeat(np.arange(len(at)), k))
                columns = [
                    batch.column(0).take(pa.array(at)).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, f.n)),
                    _square_sums(d).take(again),
                    pa.array(w.ravel()),
                    pa.array(np.tile(f.explained, len(at))),
                    pa.array(np.full(len(at) * k, f.error)),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        project,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
