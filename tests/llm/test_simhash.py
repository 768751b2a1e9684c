"""Near-duplicates against a plain computation of the same definition."""

import os
import random
import re

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm.simhash import Search, keep_one, links, near_duplicates, neighbour_links

SF_DIR = "/root/testdata/sf0.001"


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    root = plain_components(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=str)


def test_against_plain(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, "The cat  sat\ton THE mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \n"),
        (6, "one"), (6, "one"), (7, "Äb ÄB ß"), (None, "one"), (8, long), (9, long + " more"), (10, "a\x00b c d e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert keep_one(df).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == expected(rows)


def clustered(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set(base)
    for b in base * 3:
        for _ in range(rng.randint(1, 3)):
            b ^= 1 << rng.randrange(64)
        out.add(b)
    return sorted(out)


@pytest.mark.parametrize("search", [Search(bucket=2), Search(layouts=(1,)), Search(layouts=(2,))])
def test_links(spark, search):
    from tidewatch.llm.common import components

    values = clustered(3, 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(links(prints, search)).collect()}
    want = plain_components(values)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    unsigned = {k % (1 << 64): v % (1 << 64) for k, v in got.items()}
    unsigned |= {v: v for v in values if v not in unsigned}
    assert groups(unsigned) == groups(want)


def test_odd_radius(spark):
    from tidewatch.llm.common import components

    prints = spark.createDataFrame([(0,), (7,), (1 << 20,), (0b1111 << 30,)], "fp long")
    got = {r["node"]: r["root"] for r in components(neighbour_links(prints, 3)).collect()}
    assert {k for k, v in got.items() if v == 0} == {0, 7, 1 << 20}


def test_keep_one(spark):
    rows = [(3, "a b c d e", "x"), (2, "A b c d e", "y"), (2, "A b c d e", "y"), (9, "quite another text here", None), (None, "a b c d e", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `order` string")
    got = keep_one(df).toPandas()
    assert list(got.columns) == ["doc_id", "text", "order"]
    assert sorted(got.doc_id) == [2, 9]
    assert isinstance(got, pd.DataFrame)


def test_keep_one_keeps_the_least_of_each_component(spark):
    rng = random.Random(5)
    rows = [(0, ""), (1, None), (2, "a b"), (3, "A b"), (4, "a b c")]
    for group in range(25):
        words = [f"g{group}w{rng.randrange(500)}" for _ in range(rng.choice((6, 12, 40, 90, 200)))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(0, 2 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `meta.x` string")
    got = keep_one(df).toPandas()
    values = plain_fingerprints([t for _, t in rows])
    roots = plain_components(values)
    least = {}
    for (i, _), v in zip(rows, values):
        least[roots[v]] = min(i, least.get(roots[v], i))
    assert list(got.columns) == ["doc_id", "text", "meta.x"]
    assert sorted(got.doc_id) == sorted(least.values())
    assert 30 < len(got) < len(rows)
