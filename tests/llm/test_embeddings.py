"""Embedding links against all pairs."""

import numpy as np
import pytest

from tidewatch.llm.embeddings import Near, near_vectors


def plain(rows, cosine):
    ok = [
        i for i, (_, v, l) in enumerate(rows)
        if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            u, v = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(u) == len(v):
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim, noise", [(64, 0.02), (12, 0.06)])
def test_against_all_pairs(spark, dim, noise):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, dim))
    rows = []
    for i in range(300):
        c = centres[rng.integers(20)]
        v = c + rng.normal(size=dim) * noise * np.linalg.norm(c) / np.sqrt(dim) * rng.choice([0.5, 2, 5])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(3))))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(5)] + [rows[7], (None, rows[8][1], rows[8][2])]
    bad = [None, [], [0.0] * dim, [1.0, None], [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1)]
    rows += [(400 + i, v, 1) for i, v in enumerate(bad)] + [(410, rows[3][1], None), (411, [1.0, 0.0], 1), (412, [1.0, 0.01], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = sorted((tuple(r) for r in near_vectors(df.repartition(3), Near()).collect()), key=str)
    assert got == plain(rows, 0.98)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(df).count() == 0
