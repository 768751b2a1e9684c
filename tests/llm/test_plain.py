"""Classifiers and the pipeline against plain computations, one text at a time."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_passages import WORD, lowered, repeats
from tests.llm.test_scores_and_mix import corpus, levels
from tests.llm.test_simhash import plain_components, plain_print
from tidewatch.llm import quality, toxicity
from tidewatch.llm.mixing import Mix
from tidewatch.llm.toxicity import Learn

SF_DIR = "/root/testdata/sf0.001"
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"

# Classes of characters by their number; 14 is everything beyond ASCII, 0 what is left.
KINDS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",",
    "!?", "|", "#$%&*@^~", "<>{}[]()=/\\_+", "\"'`:;-",
]


def kind(c):
    return 14 if ord(c) > 127 else next((k for k, s in enumerate(KINDS, 1) if c in s), 0)


def share(part, whole):
    return part / max(whole, 1)


def plain_statistics(text):
    text = text or ""
    size = len(text.encode())
    words = NOT_SPACE.findall(text)
    low = [lowered(w) for w in words]
    lengths = [len(w.encode()) for w in words]
    n = len(words)
    mean = share(sum(lengths), n)
    lines = [lowered(x) for x in text.split("\n") if x]
    pairs = list(zip(low, low[1:]))
    kinds = Counter()
    for c in text:
        kinds[kind(c)] += len(c.encode())
    return [
        math.log1p(size), math.log1p(n), mean, math.sqrt(max(0, share(sum(x * x for x in lengths), n) - mean**2)),
        share(len(set(low)), n), share(max(Counter(low).values(), default=0), n), share(sum(a == b for a, b in pairs), n),
        share(len(set(pairs)), len(pairs)), share(sum(kind(w[0]) == 2 for w in words), n),
        share(sum(8 <= kind(w[-1]) <= 12 for w in words), n), math.log1p(len(lines)), share(len(set(lines)), len(lines)),
        share(n, len(lines)), *(share(kinds[k], size) for k in range(15)),
    ]


def plain_score(forest, x):
    """Down each tree from its root: left child 2i + 1, right child 2i + 2."""
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def forest_of(docs, labels):
    return quality.train(docs.select("doc_id", quality.statistics_udf("text").alias("stats")), labels)


def test_statistics():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "One, two!  two? ÄÖ é|", "a\tb\n\nA\tb\n x", "\x00\x7f~ end", "x" * 3000, "w " * 3000]
    texts += ["".join(rng.choice("aAbB 1.,!?|#<'\n\té€") for _ in range(rng.randrange(400))) for _ in range(60)]
    data = "".join(t or "" for t in texts).encode()
    offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    got = quality.statistics(np.frombuffer(data, np.uint8), offsets)
    np.testing.assert_allclose(got, [plain_statistics(t) for t in texts], atol=1e-7)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_quality_query(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    forest = forest_of(docs, labels)
    assert len(forest.feature) > 0
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in quality.op1_quality(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = plain_score(forest, plain_statistics(r.text))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-6)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def word_features(word, how):
    data = np.frombuffer(word.encode(), np.uint8)
    found = toxicity.sentence_features(data, np.array([0, len(data)]), how)[0]
    return {int(f) for f in found.ravel() if f >= 0}


def plain_toxic(text, weights, how):
    """1 less the chance that no sentence is toxic."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = WORD.findall(lowered(sentence))
        if words:
            used = set().union(*(word_features(w, how) for w in words))
            none *= 1 - 1 / (1 + math.exp(-(sum(weights[f] for f in used) + weights[-1])))
    return 1 - none


def test_toxicity_scores_against_plain(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, stats string")
    known, how = spark.createDataFrame(labels, LABELS), Learn(size=1 << 14)
    weights = toxicity.train(docs, known, how)
    assert np.count_nonzero(weights[:-1]) > 0
    # Weights travel as 32-bit numbers.
    sent = weights.astype(np.float32).astype(float)
    order = lambda found: sorted(found, key=lambda r: (str(r[0]), r[1]))
    want = order((r[0], plain_toxic(r[1], sent, how)) for r in rows)
    got = order((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, known, how).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    np.testing.assert_allclose([x for _, x in got], [x for _, x in want], atol=1e-6)


def test_toxicity_gradient_by_differences():
    """The first step goes down the plain likelihood in every coordinate, and training lowers it."""
    rng = random.Random(6)
    texts, y = [], []
    for i in range(60):
        words = [rng.choice("ab cd ef gh ij kl".split()) for _ in range(12)]
        if i % 3 == 0:
            words[rng.randrange(12)] = rng.choice(["vile", "foul"])
        texts.append(" ".join(words[:6]) + ". " + " ".join(words[6:]))
        y.append(float(i % 3 == 0))
    how = Learn(size=1 << 12, prefixes=(), steps=1, least=1, sure=0.5, l2=0.0)
    features, sentences = [], []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        f, s, *_ = toxicity.sentence_features(data, np.array([0, len(data)]), how)
        pairs = sorted({(int(b), int(a)) for a, b in zip(f[0], s)})
        features.append(np.array([a for _, a in pairs]))
        sentences.append(np.array([b for b, _ in pairs]))
    y, weight = np.array(y), np.array([1.0 + i % 2 for i in range(60)])

    def loss(w):
        p = [min(max(plain_toxic(t, w, how), 1e-12), 1 - 1e-12) for t in texts]
        return -sum(k * (math.log(q) if v else math.log(1 - q)) for q, v, k in zip(p, y, weight))

    start = np.zeros(how.size + 1)
    start[-1] = -5.0
    moved = toxicity.fit(features, sentences, y, weight, how) - start
    used = np.flatnonzero(moved)
    assert len(used) > 3 and {how.size} < set(used.tolist())
    for i in used:
        step = np.zeros(how.size + 1)
        step[i] = 1e-4
        slope = loss(start + step) - loss(start - step)
        assert abs(moved[i]) == pytest.approx(how.rate, rel=1e-3) and moved[i] * slope < 0
    trained = toxicity.fit(features, sentences, y, weight, Learn(**{**how.__dict__, "steps": 300}))
    assert loss(trained) < 0.2 * loss(start)


def within(part, whole):
    """Whether ``part`` is left of ``whole`` when some of it is taken out."""
    rest = iter(whole)
    return all(any(a == b for b in rest) for a in part)


def hit_words(words, windows):
    hit = set()
    for size, known in windows.items():
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in known:
                hit.update(range(i, i + size))
    return hit


def check_quality(before, after, tables):
    forest = forest_of(tables["documents"], tables["labels"])
    scores = {r.doc_id: plain_score(forest, plain_statistics(r.text)) for r in before}
    assert all(abs(s - 0.3) > 1e-6 for s in scores.values())
    assert sorted(after) == sorted(r for r in before if scores[r.doc_id] >= 0.3)
    assert len(after) < len(before)


def check_lines(before, after, tables):
    """Repeats of 50 words go, shorter than 45 words stay."""
    docs = [(r.doc_id, r.text) for r in before]
    must, may = repeats(docs, 50), repeats(docs, 45)
    left = {r.doc_id: NOT_SPACE.findall(r.text or "") for r in after}
    assert len(after) == len(before) and sum(map(len, left.values())) < sum(len(w) for w, _ in must.values())
    for i, (words, gone) in must.items():
        assert within(left[i], [w for k, w in enumerate(words) if k not in gone])
        assert within([w for k, w in enumerate(words) if k not in may[i][1]], left[i])


def check_near(before, after, tables):
    prints = {r.doc_id: plain_print(r.text) for r in before}
    root = plain_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(after) == sorted(r for r in before if r.doc_id in least.values())
    assert len(after) < len(before)


def check_benchmark(before, after, tables):
    windows = {}
    for r in tables["benchmark"].collect():
        words = WORD.findall(lowered(r.text))
        for i in range(max(1, len(words) - 9) if words else 0):
            win = tuple(words[i : i + 10])
            windows.setdefault(len(win), set()).add(win)
    left = {r.doc_id: r.text for r in after}
    assert len(left) == len(before)
    cut = 0
    for r in before:
        words = WORD.findall(lowered(r.text))
        hit = hit_words(words, windows)
        cut += len(hit)
        assert WORD.findall(lowered(left[r.doc_id])) == [w for k, w in enumerate(words) if k not in hit]
    assert cut


def check_mix(before, after, tables):
    sizes = Counter()
    of = {r.doc_id: (r.source, len(NOT_SPACE.findall(r.text or ""))) for r in before}
    for source, n in of.values():
        sizes[source] += n
    want, taken = levels(dict(sizes)), Counter()
    for r in after:
        source, n = of[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and 0 <= r.taken <= 2 * n
        assert r.target == pytest.approx(want[source])
        taken[source] += r.taken
    # A block at the end of a source is shorter than the others, wherever the mix puts it.
    assert len(after) == len(before) and all(abs(taken[s] - t) <= Mix().block for s, t in want.items())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_stage_after_stage(spark):
    """Each stage on what the plain view of the one before confirmed; run() gives the last rows."""
    tables = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = tables["documents"]
    checks = (check_quality, check_lines, check_near, check_benchmark, check_mix)
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=True):
        before = docs.collect()
        after = stage(spark, docs, SF_DIR).collect()
        check(before, after, tables)
        if name != "mixing":
            docs = spark.createDataFrame(after, docs.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, after))
