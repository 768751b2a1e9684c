"""Personal data by weak supervision.

Patterns propose spans; regex, gazetteer and context labelers vote on each. Expectation
maximisation over the counts of all vote patterns of the corpus estimates how reliable each
labeler is, and a logistic classifier of spans is trained on the resulting chances. Spans of
the strict patterns always stay; the classifier decides on the looser ones.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.plans.materialize import written

#: Fixed values of the query's contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT_SIGN = re.compile(r"[(\[] ?(?i:at) ?[)\]]")
# Looser proposals, on which the classifier decides, as on matches that fail a strict check.
LOOSE = (
    (0, re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?[(\[] ?(?i:at) ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[] ?(?i:dot) ?[)\]] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+")),
    (3, re.compile(r"(?<![0-9+.(-])(?<![0-9)][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (2, re.compile(r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
)
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
COUNTRY_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "7", "81", "86", "91")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
CUES = (
    re.compile(r"mail|contact|write|correo|e-?mail", re.I), re.compile(r"\bip\b|address|host|server|adresse", re.I),
    re.compile(r"card|visa|credit|tarjeta|karte|carte", re.I), re.compile(r"phone|tel|call|mobile|fax|telef", re.I),
)
AGAINST = re.compile(r"version|isbn|order|serial|invoice|section|chapter|\bno\.|\bid\b", re.I)


@dataclass(frozen=True)
class Supervise:
    """reach: characters before a span that context labelers read. at: chance from which the
    classifier adds a span."""

    reach: int = 40
    at: float = 0.5
    rounds: int = 60
    steps: int = 400


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str, failed: list | None = None) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the strict patterns, by kind and start.

    ``failed`` takes the matches that a check refuses: no dot in a host, parts beyond 255, a
    wrong check digit, a wrong number of digits.
    """
    out = []
    failed = [] if failed is None else failed
    done, at = 0, text.find("@")
    while at >= 0:
        # The match at this sign starts where its run of local characters does, at the
        # earliest after the match before; looking from the sign keeps long runs linear.
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        elif start < at and (host := HOST.match(text, at + 1)):
            failed.append((0, start, host.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append((1, m.start(), m.end()))
        else:
            failed.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19:
                (out if luhn(digits) else failed).append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        good = 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15
        (out if good else failed).append((3, m.start(), m.end()))
    return out


def votes(text: str, kind: int, start: int, end: int, regex: str, how: Supervise) -> str:
    """One letter for each labeler: y (personal), n (not), or - (no opinion).

    ``regex`` is the strict patterns' vote: y for a match, n for one that fails, - for none.
    """
    strict = regex == "y"
    span, before = text[start:end], text[max(0, start - how.reach) : start]
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        gazetteer = "y" if re.split(r"[.\])( ]+", span.lower())[-1] in TOP_DOMAINS else "n"
        check = "y" if strict or re.search(r"dot|\.", span, re.I) else "n"
    elif kind == 1:
        gazetteer = "n" if span.startswith(("0.", "127.", "255.")) else "-"
        check = "y" if ":" in span or len(set(span.split("."))) > 1 else "n"
    elif kind == 2:
        gazetteer = "y" if ISSUERS.match(digits) else "n"
        check = "y" if luhn(digits) else "n"
    else:
        gazetteer = "y" if not strict or digits.startswith(COUNTRY_CODES) else "n"
        check = "y" if 10 <= len(digits) <= 15 else "n"
    cue = "y" if CUES[kind].search(before) else "-"
    against = "n" if AGAINST.search(before) else "-"
    inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return regex + gazetteer + check + cue + against + ("n" if inside else "y")


LABELERS = 6


def proposals(text: str, how: Supervise) -> list[dict]:
    """Strict spans first, by kind and start, then failed and looser ones that overlap none of
    them nor each other."""
    failed: list = []
    strict = base_spans(text, failed)
    out = [(k, a, b, "y") for k, a, b in strict]
    more = [(k, a, b, "n") for k, a, b in failed]
    digits = any(c.isdigit() for c in text)
    for kind, pattern in LOOSE:
        if AT_SIGN.search(text) if kind == 0 else digits:
            more += [(kind, m.start(), m.end(), "-") for m in pattern.finditer(text)]
    if more:
        taken = sorted((a, b) for _, a, b in strict)
        starts = np.array([a for a, _ in taken], np.int64)
        stops = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
        last = 0
        for kind, a, b, regex in sorted(more, key=lambda s: (s[1], -s[2], s[3] != "n", s[0])):
            i = int(np.searchsorted(starts, b))
            if a >= last and (i == 0 or stops[i - 1] <= a):
                out.append((kind, a, b, regex))
                last = b
    return [
        {"kind": k, "start": a, "end": b, "strict": v == "y", "votes": votes(text, k, a, b, v, how)} for k, a, b, v in out
    ]


SPANS = "array<struct<kind: int, start: bigint, `end`: bigint, strict: boolean, votes: string>>"


def proposals_udf(how: Supervise):
    kind = pa.list_(pa.struct([
        ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strict", pa.bool_()), ("votes", pa.string()),
    ]))

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for first in range(0, len(texts), 256):
            out += [proposals(t or "", how) for t in texts.slice(first, 256).to_pylist()]
        return pa.array(out, kind)

    return spans


def reliabilities(patterns: list[tuple[int, str]], counts: np.ndarray, how: Supervise):
    """Chance that a span of each (kind, votes) is personal, and each labeler's vote shares.

    The two hidden classes start from the majority of the votes. A labeler's shares of y, n
    and - are estimated for either class, smoothed by one count.
    """
    code = np.array([["yn-".index(c) for c in v] for _, v in patterns]).reshape(-1, LABELERS)
    kinds = np.array([k for k, _ in patterns], np.int64)
    lean = (code == 0).sum(axis=1) - (code == 1).sum(axis=1)
    chance = 1 / (1 + np.exp(-1.5 * lean))
    shares = np.zeros((2, LABELERS, 3))
    for _ in range(how.rounds):
        weight = np.stack([counts * (1 - chance), counts * chance])
        prior = np.array([(np.bincount(kinds, w, len(KINDS)) + 1) for w in weight])
        for y in (0, 1):
            for j in range(LABELERS):
                n = np.bincount(code[:, j], weight[y], 3) + 1
                shares[y, j] = n / n.sum()
        like = [np.log(prior[y][kinds]) + np.log(shares[y][np.arange(LABELERS), code]).sum(axis=1) for y in (0, 1)]
        chance = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return chance, shares


def span_features(patterns: list[tuple[int, str]]) -> np.ndarray:
    """Votes and kind of each pattern as 0 and 1, with a constant."""
    rows = [
        [1.0, *(float(k == i) for i in range(len(KINDS))), *(float(c == x) for c in v for x in "yn")] for k, v in patterns
    ]
    return np.array(rows, float).reshape(-1, 1 + len(KINDS) + 2 * LABELERS)


def train_spans(patterns: list[tuple[int, str]], counts: np.ndarray, how: Supervise) -> dict[tuple[int, str], float]:
    """Chance of each pattern by a logistic classifier fitted to the labelers' consensus."""
    if not patterns:
        return {}
    soft, _ = reliabilities(patterns, counts, how)
    x, weight = span_features(patterns), counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(how.steps):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - soft)) + 1e-4 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= 0.5 * step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(patterns, (1 / (1 + np.exp(-x @ w))).tolist()))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


RESULT = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, chances string"
)


def decide_udf(chances: dict[tuple[int, str], float], how: Supervise):
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("chances", pa.string())])

    @F.arrow_udf(RESULT)
    def decide(proposed: pa.Array) -> pa.Array:
        out = []
        for first in range(0, len(proposed), 1024):
            for row in proposed.slice(first, 1024).to_pylist():
                base = [(s["kind"], s["start"], s["end"]) for s in row if s["strict"]]
                more = [
                    (s["kind"], s["start"], s["end"])
                    for s in row if not s["strict"] and chances[s["kind"], s["votes"]] >= how.at
                ]
                counts = np.bincount([k for k, _, _ in base], minlength=len(KINDS))
                out.append({
                    **{f"n_{k}": int(n) for k, n in zip(KINDS, counts)},
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "spans": joined(sorted({*base, *more})),
                    "chances": ",".join(
                        f"{KINDS[s['kind']]}:{s['start']}:{s['end']}:{chances[s['kind'], s['votes']]:.3f}"
                        for s in sorted(row, key=lambda s: (s["kind"], s["start"]))
                    ),
                })
        return pa.array(out, kind)

    return decide


def find_personal_data(docs: DataFrame, how: Supervise = Supervise()) -> DataFrame:
    """doc_id, counts and digest of the strict spans, all spans, and the classifier's chance of
    every proposal, also of those it refuses.

    A null text is the empty one, without spans. Repeated rows stay and count in the
    statistics; ids may be null. Without any proposal nothing is trained and nothing added.
    """
    rows = written(docs.select("doc_id", proposals_udf(how)("text").alias("found")), "proposals")
    # At most 4 kinds x 3^6 vote patterns reach the driver, counted over all documents.
    seen = (
        rows.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", "votes").collect()
    )
    patterns = [(r["kind"], r["votes"]) for r in seen]
    chances = train_spans(patterns, np.array([r["n"] for r in seen], float), how)
    return rows.select("doc_id", decide_udf(chances, how)("found").alias("x")).select("doc_id", "x.*")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
