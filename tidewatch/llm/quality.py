"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of the whole text, many documents at a time. The trees are
grown on a bounded sample of labelled rows and flattened into arrays of one shape, so that
all trees of a batch are walked together, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewatch.llm.common import LOWER, NOT_SPACE, find_words, fresh, table, text_slices, word_hashes
from tidewatch.llm.labels import fold, labelled
from tidewatch.plans.materialize import written

# Classes of bytes whose shares are statistics.
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=/\\_+", b"\"'`:;-",
), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[0x80:] = 14
CLASSES = 15


@dataclass(frozen=True)
class Trees:
    """sample: most labelled rows of either label that training sees."""

    sample: int = 12_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    smooth: float = 1.0
    least: float = 2.0


def _shares(ids: np.ndarray, rows: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: how many keys, how many distinct ones, and the most frequent one's count."""
    counts = np.bincount(ids, minlength=rows).astype(float)
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(ids):
        order = np.lexsort((keys, ids))
        i, k = ids[order], keys[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(i)))
        distinct = np.bincount(i[at], minlength=rows).astype(float)
        np.maximum.at(most, i[at], runs)
    return counts, distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of the texts of one slice: one row of numbers for each."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row_of * CLASSES + _CLASS[data], minlength=rows * CLASSES).reshape(rows, CLASSES)
    begin, stop, first = find_words(data, offsets, NOT_SPACE)
    ids = np.repeat(np.arange(rows), np.diff(first))
    h = word_hashes(data, begin, stop, LOWER)
    length = (stop - begin).astype(float)
    words, distinct, most = _shares(ids, rows, h)
    n = np.maximum(words, 1)
    mean = np.bincount(ids, length, rows) / n
    spread = np.sqrt(np.maximum(np.bincount(ids, length**2, rows) / n - mean**2, 0))
    together = (ids[1:] == ids[:-1]) if len(ids) else np.zeros(0, bool)
    repeats = np.bincount(ids[1:][together & (h[1:] == h[:-1])], minlength=rows)
    pair = h[1:] * np.uint64(3) + h[:-1]
    pairs, pairs_distinct, _ = _shares(ids[1:][together], rows, pair[together])
    first_upper = np.bincount(ids[(_CLASS[data[begin]] == 2)], minlength=rows)
    last = _CLASS[data[stop - 1]] if len(stop) else np.zeros(0, np.int64)
    ends_odd = np.bincount(ids[(last >= 8) & (last <= 12)], minlength=rows)
    line_table = np.ones(256, bool)
    line_table[10] = False
    lb, ls, lf = find_words(data, offsets, line_table)
    line_ids = np.repeat(np.arange(rows), np.diff(lf))
    lines, lines_distinct, _ = _shares(line_ids, rows, word_hashes(data, lb, ls, LOWER))
    per_line = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, spread, distinct / n, most / n, repeats / n,
        pairs_distinct / np.maximum(pairs, 1), first_upper / n, ends_odd / n, np.log1p(lines),
        lines_distinct / per_line, words / per_line, *(kinds[:, k] / some for k in range(CLASSES)),
    ])


N_STATISTICS = 13 + CLASSES


@F.arrow_udf(ArrayType(DoubleType()))
def statistics_udf(texts: pa.Array) -> pa.Array:
    """The statistics of each text; null counts as the empty text."""
    out = np.zeros((len(texts), N_STATISTICS))
    for first, data, offsets in text_slices(texts):
        out[first : first + len(offsets) - 1] = statistics(data, offsets)
    ends = np.arange(0, out.size + 1, N_STATISTICS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays: inner nodes in heap order, and the values of the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for the rows of ``x``; all trees go down a level together."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            at = np.zeros((len(x), trees), np.int64)
            each = np.arange(trees)
            rows = np.arange(len(x))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                right = x[rows, self.feature[each, at]] > self.threshold[each, at]
                at = 2 * at + 1 + right
            total = total + self.leaf[each, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Trees) -> Forest:
    """Boosted trees for the logistic loss, splits searched on histograms of binned values."""
    inner = 2**how.depth - 1
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    positive, total = float((weight * y).sum()), float(weight.sum())
    prior = (positive + 0.5) / (total + 1)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or positive in (0, total):
        return Forest(base, *empty)
    grid = np.linspace(0, 1, how.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(c, grid)) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    columns = x.shape[1]
    shift = np.arange(columns) * how.bins
    raw = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(how.depth):
            begin, width = 2**level - 1, 2**level
            at = ((node - begin)[:, None] * columns * how.bins + shift + binned).ravel()
            shape = (width, columns, how.bins)
            hists = [np.bincount(at, np.repeat(v, columns), width * columns * how.bins).reshape(shape) for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hists)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + how.smooth) + gr**2 / (hr + how.smooth) - gt**2 / (ht + how.smooth)
            gain[(hl < how.least) | (hr < how.least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1).max(axis=1) > 1e-6
            column, cut = best // how.bins, best % how.bins
            for i in np.flatnonzero(good):
                if cut[i] < len(edges[column[i]]):
                    feature[begin + i], threshold[begin + i] = column[i], edges[column[i]][cut[i]]
            right = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + right
        leaf = node - inner
        gs = np.bincount(leaf, g, inner + 1)
        hs = np.bincount(leaf, h, inner + 1)
        value = -how.rate * gs / (hs + how.smooth)
        raw = raw + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def train(rows: DataFrame, labels: DataFrame, how: Trees = Trees()) -> Forest:
    """A forest from rows (doc_id, stats) outside the held-out fold. The sample is bounded."""
    sample = labelled(rows, labels, "quality", fold(5) != 0, how.sample)
    got = sample.select("stats", "y", "weight").toArrow()
    x = np.array(got["stats"].to_pylist(), float).reshape(-1, N_STATISTICS)
    return grow(x, np.asarray(got["y"], float), np.asarray(got["weight"], float), how)


def score_udf(forest: Forest):
    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), N_STATISTICS)
        return pa.array(np.concatenate([forest.scores(p) for p in np.array_split(x, len(x) // 4096 + 1)]))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, how: Trees = Trees(), keep_at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts have statistics of zero and are scored like any other. Rows with a
    null id are scored and never learned from; repeated rows stay. Without labels, or with
    labels of one kind only, all scores are the share of label 1 (one half without any).
    """
    rows = written(docs.select("doc_id", statistics_udf("text").alias("stats")), "statistics")
    forest = train(rows, labels, how)
    score = score_udf(forest)(F.col("stats"))
    return rows.select("doc_id", (fold(5) == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= keep_at, 1).otherwise(0)
    )


def keep_good(docs: DataFrame, labels: DataFrame, how: Trees = Trees(), keep_at: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``keep_at`` or more, columns as given."""
    # The statistics of all rows are written, so that labels meet numbers and no text moves.
    stats = docs.select("doc_id", statistics_udf("text").alias("stats"))
    forest = train(written(stats, "statistics"), labels, how)
    score = fresh(docs, "score")
    return docs.withColumn(score, score_udf(forest)(statistics_udf("text"))).filter(F.col(score) >= keep_at).drop(score)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
