"""Secret scans through nested encodings.

A text is a layer. A worklist decodes URL escapes, Unicode escapes, base64 and compressed
bytes into further layers until nothing new appears; a layer that was met before at the same
place is not decoded again, so cycles end. Each layer is scanned whole, and what is found is
mapped back to the span of the original text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import table

#: Fixed values of the query's contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so a shorter one can be passed over

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: A run that is broken into lines, as in mail and key files.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Signs that are encoded over and over: what each more round adds, eight rounds or longer.
CHAIN = re.compile(r"(?i)(?:(?<=%)(?:25){9,}|(?<=\\)(?:u005c){9,}|(?<=\\)(?:x5c){9,}|(?<=&)(?:#38;){9,}|(?<=&)(?:#x26;){9,})")
UNITS = ("25", "u005c", "x5c", "#38;", "#x26;")
#: Where compressed bytes may begin within decoded ones.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


#: Bytes that may stand inside a match or an encoded run; inflated data is cut at others.
INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-%\\{}&#;\"':* \0"
#: UTF-16 text of Latin letters, either byte order.
WIDE = (re.compile(rb"(?:[\x01-\xff]\x00){8,}"), re.compile(rb"(?:\x00[\x01-\xff]){8,}"))
#: Where compressed bytes may begin under URL and other escapes, and one escaped or plain byte.
URL_MAGIC = re.compile(r"%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA])|x\^")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|(.)", re.S)


@dataclass(frozen=True)
class Unwrap:
    """piece: bytes of inflated data that are scanned at a time. A caller may also set the most
    characters of one decompressed layer and the most layers of a text; what is beyond them is
    counted as unscanned. Without them everything is scanned."""

    layer_chars: int | None = None
    layers: int | None = None
    piece: int = 1 << 24


@dataclass(frozen=True)
class Layer:
    """Text with the span of the original that each character came from, in 32 bits; without
    arrays the whole layer came from one span."""

    text: str
    start: np.ndarray | int
    end: np.ndarray | int

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.start, int):
            return self.start, self.end
        return int(self.start[a]), int(self.end[b - 1])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the plain patterns in a text."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that ``decode`` accepts replaced, or None without any."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    fixed = isinstance(layer.start, int)

    def keep(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if not fixed:
            starts.append(layer.start[a:b])
            ends.append(layer.end[a:b])

    for m in pattern.finditer(layer.text):
        new = decode(m)
        if not new:
            continue
        changed = True
        keep(at, m.start())
        parts.append(new)
        if not fixed:
            a, b = layer.span(m.start(), m.end())
            starts.append(np.full(len(new), a, np.int32))
            ends.append(np.full(len(new), b, np.int32))
        at = m.end()
    if not changed:
        return None
    keep(at, len(layer.text))
    if fixed:
        return Layer("".join(parts), layer.start, layer.end)
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _from_url(m: re.Match) -> str:
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _from_escape(m: re.Match) -> str:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def _is_packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and head[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda")


def _opened(blocks):
    """Blocks of what compressed blocks hold, all members of them; bytes that do not inflate stay."""
    tool, inside = zlib.decompressobj(47), False
    for block in blocks:
        while block:
            try:
                out = tool.decompress(block, BLOCK)
            except zlib.error:
                yield block
                yield from blocks
                return
            inside = True
            if out:
                yield out
            block = tool.unconsumed_tail
            if tool.eof:
                block, tool = tool.unused_data, zlib.decompressobj(47)
                inside = False
    if inside:
        yield tool.flush()


BLOCK = 1 << 16


def _inflated(blocks):
    """Blocks laid open layer by layer, as long as they begin like compressed ones."""
    seen = set()
    while True:
        blocks = iter(blocks)
        head = b""
        while len(head) < BLOCK and (block := next(blocks, None)) is not None:
            head += block
        mark = hashlib.sha1(head).digest()
        if not _is_packed(head) or mark in seen:
            return chain([head], blocks)
        seen.add(mark)
        blocks = _opened(chain([head], blocks))


def _pieces(blocks, size: int):
    """Blocks joined to pieces of about ``size`` that end where no match or run goes on."""
    held, n, target = [], 0, size
    for block in blocks:
        held.append(block)
        n += len(block)
        if n >= target:
            whole = b"".join(held)
            cut = len(whole.rstrip(INNER))
            if cut:
                yield whole[:cut]
            held, n = [whole[cut:]], len(whole) - cut
            target = max(size, 2 * n)
    if n:
        yield b"".join(held)


def _texts(raw: bytes):
    """Bytes as text: every pattern is ASCII, so Latin-1 shows what UTF-8 would; then UTF-16."""
    yield raw.decode("latin-1")
    if b"\0" in raw:
        for first, wide in enumerate(WIDE):
            yield "\n".join(m[0][first::2].decode("latin-1") for m in wide.finditer(raw))


def _layers_of(blocks, span: tuple[int, int], how: Unwrap, beyond: list):
    """Layers of the blocks, one after the other; a layer past ``layer_chars`` is noted."""
    left = how.layer_chars

    def guarded(blocks):
        nonlocal left
        for block in blocks:
            if left is not None and len(block) > left:
                beyond.append(span)
                yield block[:left]
                return
            left = None if left is None else left - len(block)
            yield block

    for piece in _pieces(guarded(_inflated(blocks)), how.piece):
        for text in _texts(piece):
            if text:
                yield Layer(text, *span)


def _shortened(m: re.Match) -> str:
    """Eight rounds of a chain; the others would only take off one unit each."""
    unit = next(u for u in UNITS if m[0].lower().startswith(u))
    return m[0][: 8 * len(unit)]


def _begins_packed(raw: bytes) -> list[int]:
    """Where, beyond the first byte, something begins that does inflate."""
    found = []
    for m in PACKED.finditer(raw, 1):
        try:
            if zlib.decompressobj(47).decompress(raw[m.start() : m.start() + 4096], 64):
                found.append(m.start())
        except zlib.error:
            pass
    return found


def _from_base64(layer: Layer, how: Unwrap, beyond: list):
    """Layers of the base64 runs, broken into lines or not.

    Characters of the alphabet may stand right before what was encoded, so a run is read in
    all four alignments; a single character left at its end says nothing.
    """
    for pattern in (WRAPPED, BASE64):
        for m in pattern.finditer(layer.text):
            body = m[0].rstrip("=")
            if pattern is WRAPPED:
                body = re.sub(r"[ \t\r\n]", "", body)
            body = body.replace("-", "+").replace("_", "/")
            for skip in range(4):
                part = body[skip:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                span = layer.span(m.start(), m.end())
                yield from _layers_of([raw], span, how, beyond)
                for at in _begins_packed(raw):
                    yield from _layers_of([raw[at:]], span, how, beyond)


def _byte_of(m: re.Match, kind: re.Pattern) -> int:
    if kind is URL_BYTE:
        return int(m[1], 16) if m[1] else ord(m[2])
    return ord(_from_escape(m) or "\uffff") if m.lastindex else ord(m[0])


ESCAPE_BYTE = re.compile(ESCAPE.pattern + "|.", re.S)


def _from_packed(layer: Layer, kind: re.Pattern, how: Unwrap, beyond: list):
    """Layers of compressed bytes that are written with escapes."""
    text, begins = layer.text, []
    for begin in (URL_MAGIC if kind is URL_BYTE else ESCAPE).finditer(text):
        two = [_byte_of(m, kind) for m in islice(kind.finditer(text, begin.start()), 2)]
        if max(two) < 256 and _is_packed(bytes(two)):
            begins.append(begin.start())
    if not begins:
        return
    tokens = [(m.start(), m.end(), _byte_of(m, kind)) for m in kind.finditer(text, begins[0])]
    place = {start: i for i, (start, _, _) in enumerate(tokens)}
    codes = np.array([code for _, _, code in tokens])
    raw, breaks = codes.astype(np.uint8).tobytes(), np.flatnonzero(codes > 255)
    done = 0
    for begin in begins:
        first = place.get(begin, -1)
        if first < done:
            continue
        next_break = np.searchsorted(breaks, first)
        stop = int(breaks[next_break]) if next_break < len(breaks) else len(raw)
        # The stream says itself where it ends; members may follow each other.
        at = first
        while _is_packed(raw[at : at + 2]) and at < stop:
            tool = zlib.decompressobj(47)
            feed = at
            try:
                while feed < stop and not tool.eof:
                    tail = raw[feed : min(stop, feed + BLOCK)]
                    feed += len(tail)
                    while tail and not tool.eof:
                        tool.decompress(tail, BLOCK)
                        tail = tool.unconsumed_tail
            except zlib.error:
                break
            if not tool.eof:
                break
            at = feed - len(tool.unused_data)
        # A stream that breaks off is opened as far as it goes.
        last = at if at > first else stop
        done = max(done, at)
        yield from _layers_of([raw[first:last]], layer.span(begin, tokens[last - 1][1]), how, beyond)


def scan(text: str, how: Unwrap = Unwrap()) -> tuple[list, list, int, int]:
    """Base spans, all spans, how many layers were scanned and in how many spans something was not."""
    base = base_spans(text)
    found, layers = set(base), 1
    beyond: list = []
    seen: set = set()

    def is_new(layer: Layer) -> bool:
        if isinstance(layer.start, int):
            place = (layer.start, layer.end)
        else:
            place = hashlib.sha1(layer.start.tobytes()).digest()
        mark = (hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(), place)
        new = mark not in seen
        seen.add(mark)
        return new

    def unwrapped(layer: Layer):
        """The layers within a layer, made one at a time."""
        if "%" in layer.text:
            yield from _from_packed(layer, URL_BYTE, how, beyond)
        if "\\" in layer.text or "&#" in layer.text:
            yield from _from_packed(layer, ESCAPE_BYTE, how, beyond)
        yield from _from_base64(layer, how, beyond)

    def decoded(layer: Layer) -> list[Layer]:
        """The layer with its escapes replaced, of one kind or the other."""
        if short := _substituted(layer, CHAIN, _shortened):
            return [short]
        kinds = []
        if "\\" in layer.text or "&#" in layer.text:
            kinds.append((ESCAPE, _from_escape))
        if "%" in layer.text:
            kinds.append((URL, _from_url))
        return [inner for kind in kinds if (inner := _substituted(layer, *kind))]

    # A layer is let go once its inner ones are made: of a chain of escapes one is held.
    work: list = []
    if "%" in text or "\\" in text or "&#" in text or BASE64.search(text):
        at = np.arange(len(text) + 1, dtype=np.int32)
        work.append(Layer(text, at[:-1], at[1:]))
    first = True
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):  # the rest of the layers within one
            inner = next(layer, None)
            if inner is None:
                continue
            work.append(layer)
            layer = inner
        if not is_new(layer):
            continue
        if not first:
            if how.layers is not None and layers >= how.layers:
                beyond.append(None)
                break
            layers += 1
            for a, kind, b in base_spans(layer.text):
                start, end = layer.span(a, b)
                found.add((start, kind, end))
        first = False
        work += decoded(layer)
        if "%" in layer.text or "\\" in layer.text or "&#" in layer.text or BASE64.search(layer.text):
            work.append(unwrapped(layer))
        del layer
    return base, sorted(found), layers, len(set(beyond))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_unscanned bigint"


def secrets_udf(how: Unwrap):
    kind = pa.struct([
        *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
        ("n_layers", pa.int64()), ("n_unscanned", pa.int64()),
    ])

    @F.arrow_udf(RESULT)
    def secrets(texts: pa.Array) -> pa.Array:
        out = []
        for first in range(0, len(texts), 256):
            for text in texts.slice(first, 256).to_pylist():
                base, spans, layers, beyond = scan(text or "", how)
                counts = np.bincount([k for _, k, _ in base], minlength=3)
                out.append({
                    **{f"n_{k}": int(n) for k, n in zip(KINDS, counts)},
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "spans": joined(spans), "n_layers": layers, "n_unscanned": beyond,
                })
        return pa.array(out, kind)

    return secrets


def find_secrets(docs: DataFrame, how: Unwrap = Unwrap()) -> DataFrame:
    """doc_id, the counts and digest of the base spans, all spans, layers and unscanned layers.

    A null text is the empty one: no spans, one layer. Repeated rows stay, ids may be null.
    """
    rows = docs.select("doc_id", secrets_udf(how)("text").alias("found"))
    return rows.select("doc_id", "found.*")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
