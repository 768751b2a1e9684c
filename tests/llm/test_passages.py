"""Line dedup and decontamination against plain computations."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import line_dedup
from tidewatch.llm.decontaminate import Windows, contamination, decontaminated
from tidewatch.llm.fm_index import FMIndex
from tidewatch.llm.line_dedup import deduplicated, with_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_hits(text, items, width=10):
    words = WORD.findall(lowered(text))
    hit, names = set(), set()
    for name, item in items:
        w = WORD.findall(lowered(item))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            win = w[a : a + width]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(str(name))
    joined = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def prose(rng, n, size=60):
    return [rng.choice("ab cd Éf gh1 ij kl2 mn op qr st uv wx".split()) + str(rng.randrange(size)) for _ in range(n)]


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500)
    text[0] = 0
    index = FMIndex(text, 3)
    phrases = np.array([[1, 2, 0], [3, 3, 3], [2, 0, 0], [1, 2, 3], [1, 1, 2]])
    lengths = np.array([2, 3, 1, 3, 3])
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(500 - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("how", [Windows(), Windows(shard=64, block_bytes=300)])
def test_contamination(spark, how):
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([12, 30, 3, 1, 10, 25])]
    items += [(6, None), (7, "..."), (8, items[1][1]), (None, items[0][1])]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            part = WORD.findall(items[rng.randrange(6)][1])
            cut = rng.randrange(len(part))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part[max(0, cut - 14) : cut + 14]]
        docs.append((i, ", ".join(w)))
    docs += [(None, None), (60, ""), (60, ""), (61, "!? "), (62, " ".join(prose(rng, 30000)))]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, found int").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n_hit int")
    named = [("" if n is None else n, t or "") for n, t in items]
    got = contamination(d, b, how).drop("spans").collect()
    want = [(i, *plain_hits(t, named)) for i, t in docs]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = {r["doc_id"]: r["text"] for r in decontaminated(d, b, how).collect()}
    for i, t in docs[:60]:
        n, hits, *_ = plain_hits(t, named)
        assert len(WORD.findall(lowered(left[i]))) == n - hits
    assert left[62] is not None and left[None] is None


def test_no_benchmark(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert tuple(contamination(d, b).first())[1:4] == (3, 0, 0)
    assert contamination(d.limit(0), b).count() == 0


def test_line_dedup(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 75, 300)]
    docs, inside = [], {}
    for i in range(50):
        w, marks = [], []
        for _ in range(3):
            w += [word() for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.6:
                k = rng.randrange(len(passages))
                marks.append((k, len(w)))
                w += passages[k]
        w += [word()]
        docs.append((i, "  ".join(w)))
        inside[i] = (w, marks)
    docs += [(None, None), (70, ""), (70, ""), (71, "few words"), (72, " ".join(["and"] * 400)), (73, " ".join(passages[4]))]
    df = spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], "doc_id long, text string, n_chars long, runs string")
    got = {r["doc_id"]: r for r in deduplicated(df.repartition(3)).collect()}
    assert len(got) == len({d[0] for d in docs}) and list(df.columns) == list(got[0].asDict())
    seen = set()
    for i, (w, marks) in inside.items():
        gone = set()
        for k, at in marks:
            if k in seen:
                gone.update(range(at, at + len(passages[k])))
            seen.add(k)
        left = [x for j, x in enumerate(w) if j not in gone]
        assert got[i]["text"].split() == left
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[None]["text"] is None and got[70]["text"] == "" and got[71]["text"] == "few words"
    assert got[73]["text"].split() == ([] if 4 in seen else passages[4])
    assert len(got[72]["text"].split()) < 60


def test_line_dedup_empty(spark):
    assert with_spans(spark.createDataFrame([], "doc_id long, text string"), "spans").count() == 0


def repeats(docs, width):
    """Words of each document, in order of id, within a run of ``width`` words that stands in
    an earlier document or earlier in the same one."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        hit = set()
        for a in range(len(words) - width + 1):
            run = tuple(words[a : a + width])
            if run in seen:
                hit.update(range(a, a + width))
            seen.add(run)
        out[i] = words, hit
    return out


@pytest.mark.parametrize("parts, edge", [(1, 0), (4, 0), (3, 5)])
def test_line_dedup_against_all_runs(spark, parts, edge):
    """Edges that the first occurrence lacks and a later one has may keep some words."""
    rng = random.Random(parts)
    passages = [prose(rng, n, 10**6) for n in (44, 45, 49, 50, 51, 53, 60, 75, 120, 400)]
    docs = []
    for i in range(140):
        words = prose(rng, rng.randrange(0, 60), 10**6)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            part = rng.choice(passages)
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[rng.randrange(3) if edge and len(part) > 60 else 0 :]
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, `meta.x` string").repartition(parts)
    got = with_spans(df, "spans").collect()
    assert list(got[0].asDict()) == ["doc_id", "text", "meta.x", "spans"]
    must, may = repeats(docs, 50), repeats(docs, 45)
    for r in got:
        text = r["text"] or ""
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        gone = {k for k, x in enumerate(starts) if any(s["start"] <= x < s["end"] for s in r["spans"] or [])}
        left = must[r["doc_id"]][1] - gone
        # Two edges may meet.
        assert not any(all(k + d in left for d in range(2 * edge + 1)) for k in left)
        assert gone <= may[r["doc_id"]][1]
    assert sum(len(h) for _, h in must.values()) > 3000


@pytest.mark.parametrize("place", [0, 40])
def test_line_dedup_fingerprint_at_either_end(spark, monkeypatch, place):
    """Where a window's least line is its first or its last, the passage is still covered whole."""
    rng = random.Random(place)
    passage = prose(rng, 50, 10**6)
    own = [prose(rng, 30, 10**6) for _ in range(4)]
    docs = [(0, own[0] + passage + own[1]), (1, own[2] + passage + own[3])]
    monkeypatch.setattr(line_dedup, "window_minima", lambda h, width, start: np.unique(np.clip(start + place, 0, len(h) - 1)))
    seen = np.full(1, (1 << 64) - 1, np.uint64)
    texts = [" ".join(w) for _, w in docs]
    import pyarrow as pa

    how = line_dedup.Winnow()
    words = list(line_dedup._words(pa.array(texts)))
    (_, h, heads), = words
    prefix, lines, at = line_dedup._prints(h, heads, how)
    at = at[(at == 30 + place) | (at == heads[1] + 30 + place)]
    monkeypatch.setattr(line_dedup, "_prints", lambda *_: (prefix, lines, at))
    keys = line_dedup.keys_udf(seen, how).func(pa.array(texts), pa.array([0, 1]), pa.array([5, 6])).to_pylist()
    runs = [(-1 - k["at"], k["left"]) for k in keys[1] if k["k"] is None]
    assert runs == [(30, 80)]
