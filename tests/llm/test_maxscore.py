"""Top-k search against the scores of all pairs."""

import numpy as np
import pytest

from tidewatch.llm.maxscore import Search, competitive, top_k

SCHEMA = "vec_id long, embedding array<float>, key string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def fit(n):
    return max(-(2**63), min(2**63 - 1, n))


def plain(rows, how):
    ok = [
        (i, [fit(int(np.floor(how.scale * float(np.float32(c))))) for c in v]) for i, v in rows
        if v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for q, (i, w) in enumerate(ok):
        if i is None or i % how.every:
            continue
        scored = [
            (-fit(sum(a * b for a, b in zip(w, x))), j is None, j or 0) for r, (j, x) in enumerate(ok)
            if r != q and len(x) == len(w)
        ]
        for rank, (s, none, j) in enumerate(sorted(scored)[: how.k], 1):
            out.append((i, rank, None if none else j, -s))
    return sorted(out, key=str)


def check(spark, rows, how, parts=5):
    got = sorted((tuple(r) for r in top_k(frame(spark, rows).repartition(parts), how).collect()), key=str)
    assert got == plain(rows, how)


@pytest.mark.parametrize("how", [Search(every=7), Search(k=3, every=5, queries=10, shard=16, first=3)])
def test_against_all_pairs(spark, how):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24)) / 4
    vectors = (centres[rng.integers(6, size=260)] + rng.normal(size=(260, 24)) / 30).tolist()
    rows = [(i - 20, v) for i, v in enumerate(vectors)]
    rows += [rows[25], (3, rows[27][1]), (None, rows[28][1]), (None, rows[28][1])]  # repeated rows and ids, null ids
    rows += [(1000 + i, rows[41][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2005, [1.0, None]), (2010, [float("nan")] * 24), (2015, [float("inf")] + [0.0] * 23)]
    rows += [(2100, []), (2101, []), (2105, [1.0, 2.0]), (2135, [-1.0, 2.0])]
    check(spark, rows, how)


def test_sparse_terms_large_numbers_and_few_rows(spark):
    rng = np.random.default_rng(2)
    sparse = np.where(rng.random((150, 40)) < 0.1, rng.normal(size=(150, 40)), 0.0).tolist()
    check(spark, [(i, v) for i, v in enumerate(sparse)], Search(k=5, every=4, first=2, shard=32))
    large = [(i, [float(x) for x in v]) for i, v in enumerate(rng.choice([1e7, -3e12, 2.5e18, 7.0], (30, 3)))]
    check(spark, large, Search(k=4, every=3))
    check(spark, [(0, [1.0])], Search())
    check(spark, [(0, [1.0]), (20, [-1.0])], Search())
    assert top_k(frame(spark, [])).count() == 0


def test_terms_below_the_floor_are_not_traversed():
    rows = np.array([[5.0, 1, 0], [0, 1, 1], [4, 0, -9]])
    query, row, score = competitive(np.array([[2.0, 1, 1]]), rows, np.array([8.0]))
    assert sorted(zip(row.tolist(), score.tolist())) == [(0, 11)]
    query, row, score = competitive(np.array([[2.0, 1, 1]]), rows, np.array([float(-(1 << 63))]))
    assert sorted(zip(row.tolist(), score.tolist())) == [(0, 11), (1, 2), (2, -1)]
