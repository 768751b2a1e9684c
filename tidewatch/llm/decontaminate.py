"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents within one task. Words that no benchmark item has cut the
shard's text into runs, and runs shorter than the shortest phrase cannot hold one; what is
left is indexed, all phrases are searched backwards at once, and their occurrences located.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ALNUM, LOWER, cut_spans, find_words, fresh, own_columns, table, text_slices, word_hashes
from tidewatch.llm.fm_index import FMIndex
from tidewatch.plans.materialize import written

RESULT = (
    "n_words bigint, n_hit bigint, items array<string>, "
    "words array<struct<start: bigint, `end`: bigint>>, "
    "spans array<struct<start: bigint, `end`: bigint>>"
)


@dataclass(frozen=True)
class Windows:
    """words: of a window. shard: words indexed together at most (a longer text is whole).
    block_bytes: size of the item texts that one pass over the documents takes along."""

    words: int = 10
    shard: int = 1 << 20
    block_bytes: int = 8 << 20


@dataclass(frozen=True)
class Phrases:
    """The windows of one block of items: hashes of all words, phrases as word numbers."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[np.ndarray]
    names: np.ndarray


def phrases_of(names: list[str], texts: list[str], how: Windows) -> Phrases:
    """Distinct windows of the items, with the items of each. Items without words have none."""
    rows, h = [], np.zeros(0, np.uint64)
    for _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        begin, stop, first = find_words(data, offsets, ALNUM)
        hashes = word_hashes(data, begin, stop, LOWER)
        rows += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        h = np.concatenate([h, hashes])
    vocabulary = np.unique(h)
    owners: dict[tuple, set[int]] = {}
    for i, row in enumerate(rows):
        numbers = (np.searchsorted(vocabulary, row) + 1).tolist()
        for a in range(max(1, len(numbers) - how.words + 1) if numbers else 0):
            owners.setdefault(tuple(numbers[a : a + how.words]), set()).add(i)
    lengths = np.array([len(p) for p in owners], np.int64)
    phrases = np.zeros((len(owners), how.words), np.int64)
    for i, p in enumerate(owners):
        phrases[i, : len(p)] = p
    items = [np.array(sorted(v)) for v in owners.values()]
    return Phrases(vocabulary, phrases, lengths, items, np.array(names, object))


class Shard:
    """Runs of known words gathered from many texts, then searched together."""

    def __init__(self, known: Phrases, how: Windows):
        self.known, self.how = known, how
        self.least = int(known.lengths.min()) if len(known.lengths) else 0
        self.parts: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.size = self.words = 0

    def add(self, hashes: np.ndarray, first: np.ndarray) -> None:
        """Words of more texts; ``first`` has each text's first word."""
        vocabulary = self.known.vocabulary
        number = np.zeros(len(hashes), np.int64)
        if self.least and len(hashes):
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            number = np.where(vocabulary[at] == hashes, at + 1, 0)
            cut = np.zeros(len(hashes) + 1, bool)
            cut[first] = True
            inside = number > 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | cut[1:-1]
            run = np.cumsum(begins)
            long = np.bincount(run[inside], minlength=run[-1] + 1) >= self.least
            use = inside & long[run]
            where = np.flatnonzero(use)
            heads = begins[where]
            # A separator before each run: the words shift by the runs so far.
            shifted = np.arange(len(where)) + np.cumsum(heads)
            text = np.zeros(len(where) + int(heads.sum()), np.int64)
            text[shifted] = number[where]
            places = np.full(len(text), -1, np.int64)
            places[shifted] = where + self.words
            self.parts.append(text)
            self.at.append(places)
            self.size += len(text)
        self.words += len(hashes)

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and phrases of all occurrences."""
        text = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(text, len(self.known.vocabulary))
        low, high = index.search(self.known.phrases, self.known.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.concatenate(self.at)[index.locate(rows)], phrase


def hits_udf(known: Phrases, how: Windows):
    """Occurrences in each text: words, words hit, items, and merged spans in words and in code
    points. A second column has the result of an earlier block of items, to add to."""

    def finish(shard: Shard, texts: list, before: list, out: list) -> None:
        place, phrase = shard.hits()
        bounds = np.cumsum([0] + [len(t[1]) for t in texts])
        marks = np.zeros(shard.words + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + known.lengths[phrase], -1)
        earlier = before[len(out) : len(out) + len(texts)]
        for i, old in enumerate(earlier):
            for span in old["words"]:
                marks[bounds[i] + span["start"]] += 1
                marks[bounds[i] + span["end"]] -= 1
        hit = np.cumsum(marks[:-1]) > 0
        order = np.argsort(place, kind="stable")
        place, phrase = place[order], phrase[order]
        edges = np.searchsorted(place, bounds)
        for i, (data, begin, stop) in enumerate(texts):
            mine = np.unique(phrase[edges[i] : edges[i + 1]])
            items = np.unique(np.concatenate([known.items[p] for p in mine])) if len(mine) else []
            names = {str(known.names[k]) for k in items}
            names.update(earlier[i]["items"] if earlier else ())
            own = np.flatnonzero(hit[bounds[i] : bounds[i + 1]])
            words, spans = [], []
            if len(own):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                heads = np.concatenate([[True], np.diff(own) > 1])
                runs = list(zip(own[heads].tolist(), own[np.append(heads[1:], True)].tolist()))
                words = [{"start": a, "end": b + 1} for a, b in runs]
                spans = [{"start": int(points[begin[a]]), "end": int(points[stop[b]])} for a, b in runs]
            out.append({
                "n_words": len(begin), "n_hit": len(own), "items": sorted(names),
                "words": words, "spans": spans,
            })

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("words", span), ("spans", span),
    ])

    @F.arrow_udf(RESULT)
    def hits(column: pa.Array, earlier: pa.Array) -> pa.Array:
        before = earlier.to_pylist() if not pa.types.is_boolean(earlier.type) else []
        out: list[dict] = []
        shard, texts = Shard(known, how), []
        for _, data, offsets in text_slices(column):
            begin, stop, first = find_words(data, offsets, ALNUM)
            shard.add(word_hashes(data, begin, stop, LOWER), first)
            for row in range(len(offsets) - 1):
                a, b, o = first[row], first[row + 1], offsets[row]
                texts.append((data[o : offsets[row + 1]], begin[a:b] - o, stop[a:b] - o))
            if shard.size >= how.shard or shard.words >= 4 * how.shard:
                finish(shard, texts, before, out)
                shard, texts = Shard(known, how), []
        finish(shard, texts, before, out)
        return pa.array(out, kind)

    return hits


def item_blocks(benchmark: DataFrame, how: Windows):
    """Names and texts of the items, as many at a time as ``block_bytes`` allows.

    Items come over one partition at a time, so the driver holds one block of them.
    """
    names, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if row[1]:
            names.append("" if row[0] is None else row[0])
            texts.append(row[1])
            size += len(row[1].encode())
        if size >= how.block_bytes:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, how: Windows = Windows()) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, items (ids as text, sorted), words
    and spans (removal spans in words and in code points).

    A null or empty text has no words. A null item id is the empty text; repeated items are
    found alike. An empty benchmark hits nothing. Every block of items is one more pass.
    """
    # A block is sent to the tasks as it is; its size is bounded by ``block_bytes``. The driver
    # holds one at a time: what the blocks before it found is written with the documents.
    blocks = item_blocks(benchmark, how)
    names, texts = next(blocks, ([], []))
    out = docs.withColumn(name, hits_udf(phrases_of(names, texts, how), how)("text", F.lit(True)))
    for names, texts in blocks:
        out = written(out, "benchmark-hits")
        out = out.withColumn(name, hits_udf(phrases_of(names, texts, how), how)("text", name))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    rows = with_hits(docs.select("doc_id", "text"), benchmark, "found", how)
    # The struct is taken apart once: the UDF must not run again for each field.
    rows = rows.select("doc_id", "found").select("doc_id", "found.*")
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts and n_chars brought up to date."""
    name = fresh(docs, "found")
    return cut_spans(with_hits(docs, benchmark, name, how), f"{name}.spans").select(*own_columns(docs))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")
