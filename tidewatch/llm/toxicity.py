"""Toxicity by multiple-instance learning.

Labels are known for documents only. A sentence has a chance from its words; a document is
toxic unless none of its sentences is (noisy-or). Weights of words come from the gradient of
the documents' likelihood, and the sentences with a high chance are the offending ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidewatch.llm.common import ALNUM, LOWER, find_words, mixed, prefix_hash, run_hash, table, text_slices
from tidewatch.llm.labels import fold, labelled

_END = np.zeros(256, np.int64)
_END[list(b".!?\n")] = 1


@dataclass(frozen=True)
class Learn:
    """sample: most labelled documents of either label that training sees. prefixes: lengths in bytes
    of beginnings of a longer word that count as features of their own. least and sure: documents of label 1
    that a feature needs, and by how many standard errors they must outnumber the others; a
    word that tells nothing would only be learned by heart."""

    sample: int = 3000
    size: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 6, 8, 10)
    steps: int = 300
    rate: float = 0.2
    l2: float = 2e-4
    least: int = 3
    sure: float = 3.5


def sentence_features(data: np.ndarray, offsets: np.ndarray, how: Learn):
    """Of the texts of one slice: the features of each word (-1: none), the sentence of each
    word, the row, first byte and last byte of each sentence. A sentence ends at a stop or a new line."""
    begin, stop, first = find_words(data, offsets, ALNUM)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = np.uint64(how.size)
    lowered = prefix_hash(LOWER[data].astype(np.uint64) + np.uint64(1))
    features = np.full((1 + len(how.prefixes), len(begin)), -1, np.int64)
    features[0] = run_hash(lowered, begin, stop) % size
    for k, length in enumerate(how.prefixes, 1):
        longer = stop - begin > length
        h = run_hash(lowered, begin[longer], begin[longer] + length)
        features[k, longer] = mixed(h + np.uint64(length)) % size
    ends = np.cumsum(_END[data])[begin] if len(begin) else np.zeros(0, np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(begin)) - 1 if len(at) else at
    return features, np.cumsum(new) - 1, rows[at], begin[at], stop[last]


_INTS = ArrayType(IntegerType())


def features_udf(how: Learn):
    """Column function: distinct pairs of feature and sentence of a text."""

    @F.arrow_udf(StructType().add("feature", _INTS).add("sentence", _INTS))
    def features_of(texts: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in text_slices(texts):
            features, sentence, row, _, _ = sentence_features(data, offsets, how)
            owner = row[sentence] if len(sentence) else sentence
            cuts = np.searchsorted(owner, np.arange(len(offsets)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                s = sentence[a:b] - (sentence[a] if b > a else 0)
                kind, word = np.nonzero(features[:, a:b] >= 0)
                pairs = np.unique(s[word] * how.size + features[kind, a + word])
                out.append({"feature": (pairs % how.size).astype(np.int32), "sentence": (pairs // how.size).astype(np.int32)})
        return pa.array(out, pa.struct([("feature", pa.list_(pa.int32())), ("sentence", pa.list_(pa.int32()))]))

    return features_of


def fit(features: list[np.ndarray], sentences: list[np.ndarray], y: np.ndarray, weight: np.ndarray, how: Learn):
    """Weights of the features, the last one the bias, that maximise the noisy-or likelihood."""
    w = np.zeros(how.size + 1)
    total = float(weight.sum())
    if not total or (weight * y).sum() in (0, total):
        share = float((weight * y).sum() / total) if total else 0.5
        w[-1] = np.log(max(share, 1e-9))
        return w
    counts = [int(s[-1]) + 1 if len(s) else 0 for s in sentences]
    base = np.cumsum([0, *counts])
    f = np.concatenate(features).astype(np.int64)
    s = np.concatenate([a + b for a, b in zip(sentences, base)]).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), counts)
    ones, zeros = (
        np.bincount(np.concatenate([np.unique(x) for x, of in zip(features, y) if of == k] + [f[:0]]), minlength=how.size)
        for k in (1, 0)
    )
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    pooled = (ones + zeros + 1) / (n1 + n0 + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    telling = (ones >= how.least) & (ones / n1 - zeros / n0 > how.sure * error)
    f, s = f[telling[f]], s[telling[f]]
    used, f = np.unique(f, return_inverse=True)
    v, bias = np.zeros(len(used)), -5.0
    m, u = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weight = weight / total
    for step in range(1, how.steps + 1):
        z = np.clip(np.bincount(s, v[f], base[-1]) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))
        pull = weight * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        gz = pull[doc] * p
        grad = np.append(np.bincount(f, gz[s], len(used)) + how.l2 * v / len(y) ** 0.5, gz.sum())
        m = 0.9 * m + 0.1 * grad
        u = 0.99 * u + 0.01 * grad**2
        move = how.rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
        v, bias = v - move[:-1], bias - move[-1]
    w[used], w[-1] = v, bias
    return w


def train(docs: DataFrame, labels: DataFrame, how: Learn) -> np.ndarray:
    """Weights from a bounded sample outside the held-out fold."""
    sample = labelled(docs.select("doc_id", "text"), labels, "toxic", fold(3) != 1, how.sample)
    got = sample.select(features_udf(how)("text").alias("x"), "y", "weight").toArrow()
    x = got["x"].combine_chunks() if got.num_rows else None
    fs, ss = ([a.values.to_numpy() for a in x.field(k)] for k in (0, 1)) if got.num_rows else ([], [])
    return fit(fs, ss, np.asarray(got["y"], float), np.asarray(got["weight"], float), how)


def score_udf(weights: np.ndarray, how: Learn):
    """Score of a text, and the sentences that offend: start, end (code points) and chance."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
    weights = weights.astype(np.float32)

    @F.arrow_udf("struct<score: double, offending: array<struct<start: bigint, `end`: bigint, chance: double>>>")
    def score(texts: pa.Array) -> pa.Array:
        scores, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        table_ = np.append(weights[:-1], np.float32(0))
        bias = float(weights[-1])
        for first, data, offsets in text_slices(texts):
            features, sentence, row, a, b = sentence_features(data, offsets, how)
            n = len(row)
            # A word counts once in a sentence, as in training.
            kind, word = np.nonzero((table_[features] != 0) & (features >= 0))
            key = np.unique(sentence[word] * how.size + features[kind, word])
            z = np.clip(np.bincount(key // how.size, table_[key % how.size], n) + bias, -30, 30)
            quiet = np.bincount(row, np.logaddexp(0, z), len(offsets) - 1)
            scores[first : first + len(offsets) - 1] = -np.expm1(-quiet)
            p = 1 / (1 + np.exp(-z))
            for i in np.flatnonzero(p >= 0.5):
                r = int(row[i])
                text = data[offsets[r] : int(b[i])]
                points = np.cumsum((text & 0xC0) != 0x80)
                at = int(a[i]) - int(offsets[r])
                spans[first + r].append({"start": int(points[at]) - 1, "end": int(points[-1]), "chance": float(p[i])})
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(spans, span_type)], names=["score", "offending"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, how: Learn = Learn(), flag_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row.

    A null or empty text has no sentence, so its score is 0. Rows with a null id are scored
    and never learned from; repeated rows stay. Without labels of both kinds a sentence's
    chance is the share of label 1 (one half without any label).
    """
    found = score_udf(train(docs, labels, how), how)(F.col("text"))
    rows = docs.select("doc_id", (fold(3) == 1).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.score").alias("score"), F.col("found.offending").alias("offending")).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= flag_at, 1).otherwise(0).alias("predicted"), "offending"
    )


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    rows = toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    spans = F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rows.withColumn("offending", F.array_join(spans, ","))
