"""Whitening against dense linear algebra and exact whole numbers."""

import numpy as np
import pytest

from tidewatch.llm.whitening import Whiten, leading_pairs, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def plain(vectors, count, scale=256):
    """n, deviations, |whitened| and shares by dense linear algebra."""
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] for v in vectors]
    fit = [list(t) for t in sorted({tuple(v) for v in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:count], vecs[:, ::-1][:, :count]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    white = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x]) @ vecs / np.sqrt(values)
    return n, dev, np.abs(white), values / np.trace(cov)


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 40])
def test_eigenpairs(dim):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    cases = [
        rng.normal(size=(dim, dim)),
        q * np.arange(1, dim + 1) ** 2,
        q * np.sort(rng.choice([1.0, 1.0 + 1e-13, 5.0], dim)),  # equal and nearly equal ones
        np.eye(dim), np.zeros((dim, dim)), q * 1e-150, q * 1e150, np.ones((dim, dim)),
    ]
    for a in cases:
        m = a @ a.T
        k = min(dim, 4)
        values, vectors = leading_pairs(m, k)
        size = max(np.abs(m).max(), 1e-300)
        expected = np.linalg.eigvalsh(m / size)[::-1][:k]
        assert np.allclose(values / size, expected, atol=1e-13 * dim)
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
        assert np.abs((m / size) @ vectors.T - vectors.T * (values / size)).max() < 1e-12 * dim


def test_against_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.array([5, 3, 2, 1.5] + [0.3] * 8) + 7
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(None, rows[3][1]), rows[5], (900, rows[7][1])] + [(1000 + i, rows[9][1]) for i in range(200)]
    n, dev, white, share = plain([v for _, v in rows], 4)
    bad = [None, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [0.0] * 11, []]
    df = frame(spark, rows + [(2000 + i, v) for i, v in enumerate(bad)])
    got = whitened(df.repartition(5)).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    expected = [(i, c + 1, d, w) for (i, _), d, ws in zip(rows, dev, white) for c, w in enumerate(ws)]
    found = sorted(((r.vec_id, r.component, r.deviation, abs(r.whitened)) for r in got), key=key)
    for f, e in zip(found, sorted(expected, key=key)):
        assert f[:3] == e[:3] and f[3] == pytest.approx(e[3], abs=1e-9)
    for r in got:
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-9
    # One sign for all rows of a component.
    signs = {}
    for r in got:
        k = [i for i, x in rows].index(r.vec_id) if r.vec_id is not None else 3
        v = (np.array(rows[k][1], float) * 256 // 1).astype(int)
        signs.setdefault((r.component, v.tobytes()), set()).add(r.whitened)
    assert all(max(s) - min(s) < 1e-12 for s in signs.values())


def test_large_numbers_and_low_rank(spark):
    rows = [(i, [3e15 + i * 2**30, 1.0, float(i % 2)]) for i in range(8)]
    got = whitened(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((8 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    for r in got:
        assert r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None)
    assert {r.component for r in got} == {1}  # the others drown in the rounding of the first
    huge = frame(spark, [(0, [3e38, 1.0]), (1, [-3e38, 0.0]), (2, [0.0, 0.0])])
    assert {r.vec_id for r in whitened(huge).collect()} == {0, 1, 2}


def test_widths_single_and_empty(spark):
    rows = [(i, [float(i), float(i * i % 5)]) for i in range(6)] + [(10 + i, [float(i)]) for i in range(3)]
    got = whitened(frame(spark, rows), Whiten(components=3)).collect()
    assert {(r.vec_id < 10, r.component, r.n) for r in got} == {(True, 1, 6), (True, 2, 6), (False, 1, 3)}
    assert whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitened(frame(spark, [])).count() == 0
