"""Line dedup by winnowing.

Shared passages stand in mid-line in these texts, so a line here is a rolling one: ten
consecutive words, at every word. Of each window of line hashes the least is a fingerprint,
so two texts that share 50 words or more share a fingerprint within them. A fingerprint that
occurs again is keyed with the words around it: a key spans 45 words, at steps of five, so
any shared passage of 50 words has a common key however the fingerprint lies in it. Positions
are joined by key to the first occurrence, the match is extended both ways, and every later
run is deleted. The work is linear in the occurrences; no pairs are formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import (
    NOT_SPACE, SAME, cut_spans, find_words, fresh, own_columns, prefix_hash, run_hash, table, text_slices, word_hashes,
)
from tidewatch.plans.materialize import written

#: Words compared on either side of a key: as many as lie between two keys.
LANES = 5


@dataclass(frozen=True)
class Winnow:
    """line: words of a rolling line. passage: words from which a shared passage is always
    found. step: words between the keys of a fingerprint, at most as many as are compared
    on extending. filter_blocks: the most 64-bit blocks of the filter of repeated
    fingerprints; past that it lets more through, and the join on keys stays exact."""

    line: int = 10
    passage: int = 50
    step: int = 5
    filter_blocks: int = 1 << 20

    @property
    def window(self) -> int:
        return self.passage - self.line + 1

    @property
    def around(self) -> int:
        return self.passage - self.line - self.step

    @property
    def span(self) -> int:
        return self.line + self.around


def window_minima(h: np.ndarray, width: int, start: np.ndarray | None = None) -> np.ndarray:
    """Places of the least value of every window that begins at ``start`` (all), of equal ones
    the last."""
    n = len(h) - width + 1
    start = np.arange(max(0, n)) if start is None else start
    if not len(start):
        return np.zeros(0, np.int64)
    # The low bits say the place, counted down, so the last of equal values is the least.
    low = np.uint64((1 << 20) - 1)
    place = np.arange(len(h), dtype=np.uint64) & low
    tagged = (h & ~low) | (low - place)
    least, size = tagged, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:n], least[width - size : width - size + n])
    at = (low - (least[start] & low)).astype(np.int64)
    return np.unique(start + ((at - start) & int(low)))


def _words(column: pa.Array):
    """For each slice of texts: its first row, the hashes of its words, and the first word of
    each row (one more at the end)."""
    for first, data, offsets in text_slices(column):
        begin, stop, heads = find_words(data, offsets, NOT_SPACE)
        yield first, word_hashes(data, begin, stop, SAME), heads


def _prints(own: np.ndarray, heads: np.ndarray, how: Winnow) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums for hashes of runs, hashes of all lines, and the fingerprints' places in a slice."""
    prefix = prefix_hash(own)
    at = np.arange(max(0, len(own) - how.line + 1))
    lines = run_hash(prefix, at, at + how.line) if len(at) else np.zeros(0, np.uint64)
    ends = np.repeat(heads[1:], np.diff(heads))
    inside = np.flatnonzero(ends - np.arange(len(own)) >= how.passage)  # windows within a row
    return prefix, lines, window_minima(lines, how.window, inside)


def fingerprints_udf(how: Winnow):
    """The fingerprints of a text, repeats included."""

    @F.arrow_udf("array<bigint>")
    def fingerprints(column: pa.Array) -> pa.Array:
        sizes, values = np.zeros(len(column) + 1, np.int64), [np.zeros(0, np.uint64)]
        for first, own, heads in _words(column):
            _, lines, at = _prints(own, heads, how)
            values.append(lines[at])
            sizes[first + 1 : first + len(heads)] = np.diff(np.searchsorted(at, heads))
        flat = np.concatenate(values).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))

    return fingerprints


def _address(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(1) << (h >> np.uint64(58)) | np.uint64(1) << (h >> np.uint64(52) & np.uint64(63))
    return h % np.uint64(blocks), bits


def repeated_filter(prints: DataFrame, how: Winnow) -> np.ndarray:
    """Bits of the fingerprints that occur more than once; its size has an upper bound."""
    again = written(prints.groupBy("h").count().filter("count > 1").select("h"), "repeated-lines")
    blocks = int(min(how.filter_blocks, max(1, again.count() // 4)))

    def bits(batches):
        for batch in batches:
            block, mask = _address(np.asarray(batch.column(0)).view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.view(np.int64)), pa.array(mask.view(np.int64))], names=["block", "mask"]
            )

    rows = again.mapInArrow(bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    got = rows.toArrow()  # at most filter_blocks rows
    out = np.zeros(blocks, np.uint64)
    out[np.asarray(got["block"])] = np.asarray(got["mask"]).view(np.uint64)
    return out


KEYS = "array<struct<k: bigint, at: int, `left`: bigint, `right`: bigint, far: int>>"


def keys_udf(seen: np.ndarray, how: Winnow):
    """Keys of the fingerprints that may occur again: hash, first word, and 16 bits of each of
    the five words before and after (nearest in the lowest bits, the fifth ones in ``far``).

    Of equal keys within a slice of texts the first one is given, by id, hash of the text and
    place; the runs of the later ones come without a key, as first word (at, as -1 - place)
    and end (left). So a text that repeats itself, or a passage that many texts share, adds
    one row for each slice to a common key.
    """

    def equal(own: np.ndarray, a: np.ndarray, b: np.ndarray, low: tuple, high: tuple, sign: int) -> np.ndarray:
        """How many of the nearest words are the same, going on from places a and b."""
        same, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(LANES):
            x, y = a + sign * k, b + sign * k
            going &= (x >= low[0]) & (y >= low[1]) & (x < high[0]) & (y < high[1])
            going[going] = own[x[going]] == own[y[going]]
            same += going
        return same

    def lanes(short: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, sign: int):
        """Four words in one number, and the fifth."""
        out = np.zeros(len(at), np.uint64)
        for k in range(LANES):
            place = at + sign * k
            word = short[np.where((place < low) | (place >= high), len(short) - 1, place)]
            if k == LANES - 1:
                return out, word
            out |= word << np.uint64(16 * k)

    def of_slice(own: np.ndarray, heads: np.ndarray, rank: np.ndarray):
        """Rows of texts, and of each k, whether there is one, at, left, right and far."""
        prefix, lines, at = _prints(own, heads, how)
        block, mask = _address(lines[at], len(seen))
        at = at[seen[block] & mask == mask]
        row_of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        low, high = (heads[r][row_of[at]][:, None] for r in (slice(None, -1), slice(1, None)))
        start = at[:, None] - np.arange(0, how.around + 1, how.step)
        start = np.unique(start[(start >= low) & (start + how.span <= high)])
        k = run_hash(prefix, start, start + how.span)
        row = row_of[start]
        low, high = heads[row], heads[row + 1]
        # Equal keys in the order of their documents and places; the first of each leads.
        order = np.lexsort((start - low, rank[row], k))
        new = np.ones(len(order), bool)
        new[1:] = k[order][1:] != k[order][:-1]
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
        first = lead == np.arange(len(start))
        # Repeated rows are one document: the same place of one is not later.
        later = ~first & ((rank[row] != rank[row[lead]]) | (start - low != start[lead] - low[lead]))
        a, f = start[later], start[lead[later]]
        lows, highs = (low[later], low[lead[later]]), (high[later], high[lead[later]])
        begin = a - equal(own, a - 1, f - 1, lows, highs, -1)
        end = a + how.span + equal(own, a + how.span, f + how.span, lows, highs, 1)
        heads_of = np.ones(len(a), bool)
        heads_of[1:] = (begin[1:] > np.maximum.accumulate(end)[:-1]) | (row[later][1:] != row[later][:-1])
        runs = np.flatnonzero(heads_of)
        stops = np.maximum.reduceat(end, runs) if len(runs) else end
        short = np.append(own >> np.uint64(48) | np.uint64(1), np.uint64(0))
        lo, hi, some = low[first], high[first], start[first]
        left, far_left = lanes(short, some - 1, lo, hi, -1)
        right, far_right = lanes(short, some + how.span, lo, hi, 1)
        run_low = lows[0][runs]
        none = np.zeros(len(runs), np.uint64)
        return (
            np.concatenate([row[first], row[later][runs]]),
            np.concatenate([k[first], none]),
            np.arange(len(some) + len(runs)) < len(some),
            np.concatenate([some - lo, -1 - (begin[runs] - run_low)]),
            np.concatenate([left, (stops - run_low).astype(np.uint64)]),
            np.concatenate([right, none]),
            np.concatenate([far_left | far_right << np.uint64(16), none]),
        )

    @F.arrow_udf(KEYS)
    def keys(column: pa.Array, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        sizes = np.zeros(len(column) + 1, np.int64)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3)]
        ids, hashes = np.asarray(ids), np.asarray(hashes)
        for first, own, heads in _words(column):
            n = len(heads) - 1
            order = np.lexsort((hashes[first : first + n], ids[first : first + n]))
            i, h = ids[first : first + n][order], hashes[first : first + n][order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (i[1:] != i[:-1]) | (h[1:] != h[:-1])]))
            got = of_slice(own, heads, rank)
            by_row = np.argsort(got[0], kind="stable")
            parts.append(tuple(c[by_row] for c in got))
            sizes[first + 1 : first + n + 1] = np.bincount(got[0], minlength=n)
        _, k, keyed, at, left, right, far = (np.concatenate(c) for c in zip(*parts))
        fields = [
            pa.array(k.view(np.int64), mask=~keyed), pa.array(at.astype(np.int32)), pa.array(left.view(np.int64)),
            pa.array(right.view(np.int64)), pa.array(far.astype(np.uint32).view(np.int32)),
        ]
        flat = pa.StructArray.from_arrays(fields, names=["k", "at", "left", "right", "far"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)

    return keys


def _equal_lanes(a: Column, b: Column, far: Column) -> Column:
    """How many of the nearest words are the same; ``far``: differing bits of the fifth ones."""
    differ = a.bitwiseXOR(b)
    out = F.lit(0)
    for k in range(1, LANES):
        mask = (1 << 16 * k) - 1
        mask -= (mask >> 63) << 64
        out = F.when(differ.bitwiseAND(F.lit(mask).cast("long")) == 0, k).otherwise(out)
    return F.when((differ == 0) & (far == 0), LANES).otherwise(out)


def spans_udf():
    """Runs of words, merged and sorted, as spans of code points of the text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<start: bigint, `end`: bigint>>")
    def spans(column: pa.Array, runs: pa.Array) -> pa.Array:
        out: list = []
        for first, data, offsets in text_slices(column):
            begin, stop, heads = find_words(data, offsets, NOT_SPACE)
            for row in range(len(offsets) - 1):
                own = runs[first + row].as_py()
                if not own:
                    out.append(None)
                    continue
                n = int(heads[row + 1] - heads[row])
                marks = np.zeros(n + 1, np.int64)
                for r in own:
                    marks[max(0, r["a"])] += 1
                    marks[min(n, r["b"])] -= 1
                inside = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                text = data[offsets[row] : offsets[row + 1]]
                points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                b = begin[heads[row] : heads[row + 1]] - offsets[row]
                e = stop[heads[row] : heads[row + 1]] - offsets[row]
                out.append([
                    {"start": int(points[b[x]]), "end": int(points[e[y - 1]])}
                    for x, y in zip(edge[::2], edge[1::2])
                ])
        return pa.array(out, span)

    return spans


def repeated_runs(docs: DataFrame, how: Winnow) -> DataFrame:
    """Rows (id, hash, runs): of each document, the runs of words that occur earlier.

    Earlier is by id, a null id last, then by the hash of the text, then by place.
    """
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("th")]
    prints = docs.select(F.explode(fingerprints_udf(how)("text")).alias("h"))
    seen = repeated_filter(prints, how)
    placed = docs.select(*place, "text")
    found = placed.select("id", "th", F.explode(keys_udf(seen, how)("text", "id", "th")).alias("x")).select("id", "th", "x.*")
    # Dealt out by key once: the firsts and the join to them read the same exchange, so the
    # same columns must be used by both. Runs without a key get one that spreads them.
    spread = F.coalesce("k", F.xxhash64("id", "th", "at"))
    keys = found.withColumn("k", spread).repartition("k")
    firsts = (
        keys.groupBy("k").agg(F.min(F.struct("id", "th", "at", "left", "right", "far")).alias("f"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n")
    )
    later = F.expr("id <> f.id or th <> f.th")
    far = F.col("far").bitwiseXOR(F.col("f.far"))
    a = F.col("at") - _equal_lanes(F.col("left"), F.col("f.left"), far.bitwiseAND(F.lit(0xFFFF)))
    b = F.col("at") + how.span + _equal_lanes(F.col("right"), F.col("f.right"), F.shiftrightunsigned(far, 16))
    own = F.struct((-1 - F.col("at")).alias("a"), F.col("left").cast("int").alias("b"))
    run = F.when(F.col("at") < 0, own).when(later, F.struct(a.alias("a"), b.alias("b")))
    runs = keys.join(firsts, "k", "left").select("id", "th", run.alias("run")).filter("run is not null")
    return runs.groupBy("id", "th").agg(F.collect_set("run").alias("runs"))


def with_spans(docs: DataFrame, name: str, how: Winnow = Winnow()) -> DataFrame:
    """``docs`` with a column ``name``: sorted spans (start, end in code points) that repeat.

    A passage of ``passage`` words or more that stands in an earlier document, or earlier in
    the same one, is covered whole; words are compared as they are, white space does not
    count. Matches are extended against one earlier occurrence of their key, the first of all
    or of its slice: where only another one goes on further, up to ``step`` words may stay at
    that edge. A null or empty text, and any with fewer words, has none (null). Rows that share id
    and text are one document: none of them is later than the others.
    """
    own_id, own_hash, runs = (fresh(docs, c) for c in ("id", "th", "runs"))
    spans = repeated_runs(docs.select("doc_id", "text"), how).toDF(own_id, own_hash, runs)
    keyed = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    keyed = keyed.withColumn(own_hash, F.xxhash64("text")).join(spans, [own_id, own_hash], "left")
    # Texts without runs do not go to Python.
    asked = F.when(F.col(runs).isNotNull(), F.col("text"))
    return keyed.withColumn(name, spans_udf()(asked, runs)).select(*own_columns(docs), name)


def deduplicated(docs: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """``docs`` without the later ones of repeated passages; columns and rows as given."""
    name = fresh(docs, "spans")
    return cut_spans(with_spans(docs, name, how), name).select(*own_columns(docs))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, how many runs were deleted, their spans, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut_spans(with_spans(docs, "spans"), "spans")
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rows.select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("spans"), "text",
    )
