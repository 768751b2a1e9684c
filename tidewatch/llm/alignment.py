"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

All A and B tokens of a text are sorted by their first byte; a running maximum of their ends
shows where a token starts at or behind everything before it, and there a new group begins.
Within a group every A token is linked with every B token.

Tokens of neither tokenizer reach over a place where a space follows a character that is no
white space (checked when they are loaded), so texts are cut there, and pieces that repeat
are encoded and aligned once. A text's tokens, groups and links are those of its pieces.

Documents travel in chunks of bounded size. A chunk has a dictionary of its pieces and linked
pairs, so corpus-wide counts come back to a chunk once for each pair, not once for each link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.plans.materialize import written


@dataclass(frozen=True)
class Align:
    """a: tokenizers file of a byte-level BPE. b: sentencepiece model. Both must be at the same
    path on every executor. chunk: bytes of text that share a dictionary; one text is never
    split. memory: characters of cached pieces a task holds."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"
    chunk: int = 1 << 22
    memory: int = 1 << 20


#: Pieces end before a space that follows a character that is no white space.
PIECE = re.compile(r"\s*(?:\S++(?:[^\S ]\s*+)?)++|\s+")
#: Word pattern of byte-level BPE (a fixed value of that format).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and spaces below this are the same in every Unicode version in use.
SETTLED = "ɐ"
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Ids and bytes of a byte-level BPE file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for one task
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * self.size
        for text, i in model["vocab"].items():
            self.bytes[i] = special.get(i) or bytes(letters[c] for c in text)
        before = spec.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        #: Whether pieces may be encoded for themselves.
        self.cuts = usual and not before.get("add_prefix_space") and not spec.get("normalizer")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        self.fast = None
        if self.cuts and in_order and not model.get("ignore_merges"):
            # Ids rise in the order of merges, so they serve as ranks for the faster library.
            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        fast = self.fast.encode_ordinary
        # Long words are merged in less than quadratic time by the other library only.
        out = [fast(t) if len(t) < 256 and max(t) < SETTLED else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = e.ids
        return out


class Pieces:
    """Ids and bytes of a sentencepiece model, which puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        self.space = self.model.piece_to_id(SPACE)
        plain = self.model.normalize("a   b\tc ") == SPACE + "a" + SPACE * 2 + " b\tc" + SPACE
        within = any(SPACE in p.lstrip(SPACE) for p in names)
        self.cuts = plain and not within and self.bytes[self.space] == b" "

    def encode(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with the space that the model adds; a lone one it would not give."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [[self.space] if t == " " and self.cuts else ids for t, ids in zip(texts, found)]


def coalesced(a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two tilings of the same bytes, given by the ends of their tokens.

    Returns, in order of group, side and place: token numbers, side (0 A, 1 B) and group.
    """
    stops = np.concatenate([a_stops, b_stops])
    starts = np.concatenate([[0], a_stops[:-1], [0], b_stops[:-1]]) if len(a_stops) and len(b_stops) else stops
    side = np.repeat(np.array([0, 1], np.int8), [len(a_stops), len(b_stops)])
    number = np.concatenate([np.arange(len(a_stops)), np.arange(len(b_stops))])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(stops[order])
    group = np.zeros(len(order), np.int64)
    if len(order):
        np.cumsum(starts[order][1:] >= reach[:-1], out=group[1:])
    order = order[np.lexsort((starts[order], side[order], group))]
    return number[order], side[order], np.sort(group)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int64, int(sizes.sum())), sizes


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


#: Pairs of one group beyond which ids are counted before they are paired.
_WIDE = 1 << 12


def linked_ids(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """(group, A id, B id, times) of all links; ``a`` and ``b`` are ids in order of groups."""
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    count = n_a * n_b
    wide = np.flatnonzero(count > _WIDE)
    count[wide] = 0
    group = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    across = n_b[group]
    out = [(group, a[a_at[group] + place // across], b[b_at[group] + place % across], np.ones(len(group), np.int64))]
    for g in wide.tolist():
        (ua, ca), (ub, cb) = (
            np.unique(ids[at[g] : at[g] + n[g]], return_counts=True) for ids, at, n in ((a, a_at, n_a), (b, b_at, n_b))
        )
        times = np.outer(ca, cb).ravel()
        out.append((np.full(len(times), g), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), times))
    return tuple(np.concatenate(parts) for parts in zip(*out))


class Aligner:
    """Aligned pieces of texts, kept for later texts up to a bound."""

    def __init__(self, how: Align):
        self.how, self.a, self.b = how, ByteBpe(how.a), Pieces(how.b)
        self.cuts = self.a.cuts and self.b.cuts
        self.lengths = [np.array([len(x) for x in t.bytes]) for t in (self.a, self.b)]
        ids = range(max(self.a.size, self.b.size))
        self.names = np.array([[f"{i}{end}" for i in ids] for end in ",|;"], object)
        self.widths = np.array([len(n) for n in self.names[0]])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.texts: list[str] = []  # groups of each piece as text
        self.counts = np.zeros((0, 5), np.int64)  # whole, n_a, n_b, n_groups, n_links
        self.ends = np.zeros(1, np.int64)  # of a piece's links in the next two
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces not seen before."""
        ids = [t.encode(pieces) for t in (self.a, self.b)]
        whole = np.array([
            p.encode() == b"".join([self.a.bytes[i] for i in x]) == b"".join([self.b.bytes[i] for i in y])
            for p, x, y in zip(pieces, *ids)
        ], bool)
        (a, n_a), (b, n_b) = (_flat([x if w else [] for x, w in zip(t, whole)]) for t in ids)
        number, side, group = coalesced(*(np.cumsum(n[i]) for n, i in zip(self.lengths, (a, b))))
        n_groups = int(group[-1]) + 1 if len(group) else 0
        is_b = side == 1
        own = [np.bincount(group[side == s], minlength=n_groups) for s in (0, 1)]
        piece = np.repeat(np.arange(len(pieces)), n_a)[np.cumsum(own[0]) - 1]  # of each group
        ids = np.where(is_b, b[np.where(is_b, number, 0)] if len(b) else 0, a[np.where(is_b, 0, number)] if len(a) else 0)
        # What follows a token: another one of its side, the other side, or another group.
        after = np.full(len(ids), 2)
        after[:-1][group[1:] == group[:-1]] = 1
        after[:-1][(group[1:] == group[:-1]) & (side[1:] == side[:-1])] = 0
        text = "".join(self.names[after, ids].tolist())
        stops = np.cumsum(np.bincount(piece[group], weights=self.widths[ids], minlength=len(pieces)).astype(np.int64)).tolist()
        self.texts += [text[i : max(i, j - 1)] for i, j in zip([0, *stops[:-1]], stops)]
        g, x, y, times = linked_ids(a, b, *own)
        # One number for piece and pair, by the places of the pairs met here.
        names, place = np.unique((x << 32) | y, return_inverse=True)
        keys, times = _summed(piece[g] * max(1, len(names)) + place, times)
        per_piece = np.bincount(keys // max(1, len(names)), minlength=len(pieces))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(per_piece)])
        self.pairs = np.concatenate([self.pairs, names[keys % max(1, len(names))]])
        self.times = np.concatenate([self.times, times])
        groups, links = (np.bincount(piece, weights=w, minlength=len(pieces)).astype(np.int64) for w in (None, own[0] * own[1]))
        self.counts = np.vstack([self.counts, np.column_stack([whole, n_a, n_b, groups, links])])
        start = len(self.index)
        self.index.update((p, start + i) for i, p in enumerate(pieces))
        self.held += sum(map(len, pieces))

    def cut(self, text: str):
        """Lists of the pieces of a text that is not empty, a bounded number at once."""
        text = " " + text
        if not self.cuts:
            yield [text]
        elif len(text) < 1 << 21:
            yield PIECE.findall(text)
        else:
            found = (m.group() for m in PIECE.finditer(text))
            while some := list(islice(found, 1 << 16)):
                yield some

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece numbers of each text, none for null and empty ones."""
        if self.held > self.how.memory:
            self.forget()
        out: list[list[np.ndarray]] = []
        waiting: list[list[str]] = []
        sizes: list[tuple[int, int]] = []  # text and number of its pieces that wait

        def flush() -> None:
            new = list(dict.fromkeys(p for pieces in waiting for p in pieces if p not in self.index))
            if new:
                self.learn(new)
            for (i, _), pieces in zip(sizes, waiting):
                out[i].append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
            waiting.clear()
            sizes.clear()

        n = 0
        for text in texts:
            out.append([])
            for pieces in self.cut(text) if text else ():
                waiting.append(pieces)
                sizes.append((len(out) - 1, len(pieces)))
                n += len(pieces)
                if n > 1 << 16:
                    flush()
                    n = 0
        flush()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in out]

    def digest(self, pieces: np.ndarray) -> str:
        """SHA-256 of the groups of these pieces as text."""
        h, texts = hashlib.sha256(), self.texts
        for first in range(0, len(pieces), 1 << 18):
            part = ";".join([texts[i] for i in pieces[first : first + (1 << 18)].tolist()])
            h.update((";" * bool(first) + part).encode())
        return h.hexdigest()


@cache
def _aligner(how: Align) -> Aligner:
    return Aligner(how)


_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    # Of a document: its distinct pieces as steps from one to the next, and how often it has
    # them; small numbers, as most of what travels is this.
    ("pieces", pa.list_(pa.int32())), ("often", pa.list_(pa.int8())),
    # Of the chunk's own row: the ends of its pieces in the next two, their pairs by place,
    # and the pairs with the number of documents that hold them.
    ("ends", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
])
_CHUNK_DDL = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pieces array<int>, "
    "often array<tinyint>, ends array<int>, places array<int>, times array<long>, pairs array<long>, docs array<int>"
)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def in_steps(doc: np.ndarray, piece: np.ndarray, often: np.ndarray, n: int):
    """Rising pieces of each document as steps, counts of at most 127 (a step of 0 goes on with
    the same piece), and the number of steps of each document."""
    more = (often + 126) // 127
    ends = np.cumsum(more)
    at = np.repeat(np.arange(len(piece)), more)
    counts = np.full(len(at), 127)
    counts[ends - 1] = often - 127 * (more - 1)
    doc, piece = doc[at], piece[at]
    steps = piece.copy()
    steps[1:] -= piece[:-1]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    steps[first] = piece[first]
    return steps, counts, np.bincount(doc, minlength=n)


def from_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    places = np.cumsum(steps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return places - np.repeat(places[starts] - steps[starts], sizes[sizes > 0])


def chunk_rows(aligner: Aligner, chunk: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of the documents of a chunk and, last, of its dictionary."""
    numbers = aligner.numbers(texts)
    n = len(numbers)
    # A document with a piece that does not come back byte for byte has no tokens.
    sound = [bool(len(p)) and bool(aligner.counts[p, 0].all()) for p in numbers]
    numbers = [p if ok else p[:0] for p, ok in zip(numbers, sound)]
    sizes = np.fromiter(map(len, numbers), np.int64, n)
    flat = np.concatenate(numbers) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    used, piece = np.unique(flat, return_inverse=True)
    counts = np.zeros((n, 4), np.int64)
    for c in range(4):
        counts[:, c] = _per_row(aligner.counts[flat, c + 1], sizes)
    own, often = np.unique(doc * max(1, len(used)) + piece, return_counts=True)
    own_doc, own_piece = own // max(1, len(used)), own % max(1, len(used))
    # Links of the chunk's pieces, then the documents of each pair.
    first, stop = aligner.ends[used], aligner.ends[used + 1]
    links = np.repeat(first - np.concatenate([[0], np.cumsum(stop - first)[:-1]]), stop - first) if len(used) else np.zeros(0, np.int64)
    links = links + np.arange(len(links))
    pairs, places = np.unique(aligner.pairs[links], return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int64)
    held = ends[own_piece + 1] - ends[own_piece]
    at = np.repeat(ends[own_piece] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
    holds = np.unique(np.repeat(own_doc, held) * max(1, len(pairs)) + places[at])
    docs = np.bincount(holds % max(1, len(pairs)), minlength=len(pairs))
    steps, often, per_doc = in_steps(own_doc, own_piece, often, n)
    none = pa.nulls(n)
    documents = [
        pa.array(np.full(n, chunk)), ids.cast(pa.int64()), *(pa.array(counts[:, c]) for c in range(4)),
        pa.array([aligner.digest(p) if len(p) else "" for p in numbers], pa.string()),
        _lists(steps, per_doc, pa.int32()), _lists(often, per_doc, pa.int8()),
        *(none.cast(f.type) for f in list(_CHUNKS)[9:]),
    ]
    dictionary = [[chunk], [None], [None], [None], [None], [None], [None], [None], [None], [ends], [places], [aligner.times[links]], [pairs], [docs]]
    columns = [pa.concat_arrays([d, pa.array(x, f.type)]) for d, x, f in zip(documents, dictionary, _CHUNKS)]
    return pa.RecordBatch.from_arrays(columns, schema=_CHUNKS)


def _per_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def chunked(docs: DataFrame, how: Align) -> DataFrame:
    def rows(batches):
        aligner = _aligner(how)
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(np.asarray(_bytes(texts)))
            first = 0
            while first < batch.num_rows:
                done = sizes[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(sizes, done + how.chunk, "right")))
                yield chunk_rows(aligner, part, ids.slice(first, stop - first), texts.slice(first, stop - first).to_pylist())
                part += 1
                first = stop

    return docs.mapInArrow(rows, _CHUNK_DDL)


def _bytes(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
])


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with what the corpus-wide counts of its pairs say of their links."""
    left, right = left.combine_chunks(), right.combine_chunks()
    is_doc = np.asarray(left.column("pieces").is_valid())
    book = left.filter(pa.array(~is_doc))
    docs = left.filter(pa.array(is_doc))
    ends, places, times, pairs = (np.asarray(book.column(c)[0].values) for c in ("ends", "places", "times", "pairs"))
    found = np.searchsorted(pairs, np.asarray(right.column("pair")))
    weights = []
    for name in ("best", "count"):
        by_pair = np.zeros(len(pairs), np.int64)
        by_pair[found] = np.asarray(right.column(name)).astype(np.int64)
        weights.append(_per_row(by_pair[places] * times, np.diff(ends)))  # of each piece
    pieces, often = (docs.column(c).combine_chunks() for c in ("pieces", "often"))
    sizes = np.asarray(pieces.value_lengths()).astype(np.int64)
    pieces = from_steps(np.asarray(pieces.flatten()).astype(np.int64), sizes)
    often = np.asarray(often.flatten()).astype(np.int64)
    extra = [pa.array(_per_row(w[pieces] * often, sizes)) for w in weights]
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*columns, *extra, docs.column("groups_sha256")], schema=_OUT)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id in the upper 32 bits, B id below), count and best of all linked pairs."""
    held = chunks.filter("ends is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    # One row a pair by now; an A id has at most as many as B has ids.
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "count", (F.col("count") == most).cast("int").alias("best"))


def aligned(docs: DataFrame, how: Align = Align()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and texts that do not come back byte for byte from their tokens
    (such as those with the sign that stands for a space in B), have no tokens: zeros and an
    empty digest. Repeated rows and ids count as documents of their own. The task holds the
    pieces of a text, and of a group without common ends one row for each pair of its
    distinct ids.
    """
    chunks = written(chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), how), "token-chunks")
    counts = written(pair_counts(chunks), "pair-counts")
    asked = chunks.filter("ends is not null").select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    known = asked.join(counts, "pair").select("of", "pair", "count", "best")
    left = chunks.drop("docs").groupBy("chunk").cogroup(known.groupBy("of"))
    return left.applyInArrow(
        _counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op11_align(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
