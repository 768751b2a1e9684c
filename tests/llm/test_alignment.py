"""Alignment of two tokenizers against a plain walk over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm.alignment import Align, Aligner, ByteBpe, Pieces, aligned, coalesced, from_steps, in_steps, linked_ids

A, B = Align().a, Align().b


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(A)
    bpe.encode_special_tokens = True
    return bpe, sentencepiece.SentencePieceProcessor(model_file=B), ByteBpe(A).bytes, Pieces(B).bytes


def plain(texts, tools):
    """All columns but doc_id, one text after another, whole."""
    bpe, model, a_bytes, b_bytes = tools
    docs = []
    for text in texts:
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a = b = []
        ends = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            ends.append(out)
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, out) if last < e <= cut] for ids, out in zip((a, b), ends)])
            last = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    count = Counter(pair for d in docs for pair in set(d[3]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (n_a, n_b, g, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha)
        for n_a, n_b, g, links, sha in docs
    ]


def odd_texts():
    rng = np.random.default_rng(5)
    alphabet = list("aaaeestn   \n\t'.,0189ABÄéß ▁中文ا😀　\x00\x1c​﻿") + ["'s", " the", "\r\n", "  \n ", "<s>", "<|endoftext|>", "ﬁ"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(300)]
    texts += [None, "", " ", "  ", "\n", " a ", "a  ", "a\n", "a\n b", "a\n  b", "a \n b", "▁", "a ▁b", "x" * 700, "é" * 300]
    texts += ["plain words, plain words.", "plain words, plain words.", "<s> </s> <|endoftext|> <0x0A>", "don't we'll it's"]
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma", "Straße", "naïve", "x1"], 4000))]
    texts += [" the" * 1000 + " end"]
    return texts


def test_against_plain(spark, tools):
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, pair string")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = sorted(((r[0], *e) for r, e in zip(rows, plain(texts, tools))), key=str)
    for how, parts in ((Align(), 3), (Align(chunk=200, memory=100), 4)):
        got = aligned(df.repartition(parts), how).select("doc_id", *names).collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_pieces_are_encoded_as_in_their_text(tools):
    own = Aligner(Align())
    assert own.cuts and own.a.fast is not None
    for text in filter(None, odd_texts()):
        pieces = [p for some in own.cut(text) for p in some]
        assert "".join(pieces) == " " + text
        assert sum(own.a.encode(pieces), []) == tools[0].encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert sum(own.b.encode(pieces), []) == tools[1].encode(text)


def test_the_two_libraries_agree_on_the_vocabulary():
    bpe = ByteBpe(A)
    for token in bpe.bytes[:50256]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        ids = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.fast.encode_ordinary(text) == ids


def test_whole_texts_where_pieces_do_not_hold(tools):
    own = Aligner(Align())
    own.cuts = own.b.cuts = False
    texts = [t for t in odd_texts() if t]
    numbers = own.numbers(texts)
    assert all(len(n) == 1 for n in numbers)
    assert [own.counts[n[0], 1] for n in numbers if own.counts[n[0], 0]] == [e[0] for e in plain(texts, tools) if e[0]]


def test_steps():
    doc, piece = np.array([0, 0, 2, 2, 2, 4]), np.array([3, 9, 0, 5, 6, 2])
    often = np.array([1, 127, 128, 300, 2, 254])
    steps, counts, sizes = in_steps(doc, piece, often, 6)
    assert sizes.tolist() == [2, 0, 6, 0, 2, 0] and counts.max() == 127 and counts.min() == 1
    back = from_steps(steps, sizes)
    total = Counter()
    for d, p, n in zip(np.repeat(np.arange(6), sizes), back, counts):
        total[d, p] += n
    assert total == Counter(dict(zip(zip(doc, piece), often)))


def test_groups_and_wide_groups():
    number, side, group = coalesced(np.array([2, 3, 6]), np.array([1, 3, 4, 6]))
    assert list(zip(number, side, group)) == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 1, 1)]
    assert all(len(x) == 0 for x in coalesced(np.zeros(0, int), np.zeros(0, int)))
    rng = np.random.default_rng(1)
    a, b = rng.integers(5, size=103), rng.integers(4, size=92)
    g, x, y, times = linked_ids(a, b, np.array([3, 100]), np.array([2, 90]))
    got = Counter()
    for k, i, j, t in zip(g, x, y, times):
        got[k, i, j] += t
    expected = Counter((0, i, j) for i in a[:3] for j in b[:2]) + Counter((1, i, j) for i in a[3:] for j in b[2:])
    assert got == expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert aligned(df).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in aligned(one).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
