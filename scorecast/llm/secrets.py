"""Operator 8: secret scans with a recursive decoding worklist.

A text is scanned for secrets, and so is every layer that can be unwrapped from it: URL
escapes (also %u), backslash escapes (Unicode, bytes, octal, and those of JSON strings), HTML
entities, base64 (also wrapped over lines, or glued to a path), two-byte text (UTF-16), and gzip
or zlib data inside base64, escapes or other streams. Each layer
goes to a worklist with the place, in the original text, of every one of its characters;
layers of layers are unwrapped in turn until nothing new appears. A layer whose text was seen
before is not unwrapped again, which ends cycles. Finds in a layer are reported at the span of
the original text that they came from.

Spans are code points of the whole text, end exclusive. Finds in the text itself (depth 0)
stand as they are; deeper ones are added.

Edge cases: null counts as empty and has no finds; repeated rows have equal finds; an empty
table gives an empty result; other columns are not read. Streams are read whole at any size:
one of more than ``WINDOW`` bytes passes through in windows that overlap by ``OVERLAP``, streams
inside it are read as its bytes come, and memory does not grow with it. What is wrapped otherwise
(base64, escapes) in such a stream is unwrapped within each window. A stream with a wrong
checksum counts, a broken one is read to where it breaks. Streams of more than ``WINDOW`` bytes
inside each other are entered ``LEVELS`` deep. A chain of one escape escaped over and over
(%252525...) is halved at a time, so its layers are few.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import spans as S

# The kinds, in order, with their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Bytes of a stream that are one window, their overlap, and how deep larger streams nest.
WINDOW, OVERLAP, LEVELS = 1 << 20, 1 << 16, 40
_READ = 1 << 13
_ESCAPED = re.compile(
    r"(?P<chain>%25(?:25){8,}|&(?:amp;){8,}|\\u005c(?:u005c){8,}|\\x5c(?:x5c){8,})"
    r"|(?P<byte>%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2})"
    r"|(?P<code>[%\\]u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})"
    r"|(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|quot|apos|amp|lt|gt|equals|colon);)"
    r"|(?P<sign>\\[nrtbf\\/'\"])")
_LINK = re.compile(r"25|amp;|u005c|x5c")
#: The openings of streams as they are escaped; in %-escapes the x of zlib stands as it is.
_PACKED = re.compile(r"(?:%1f|\\x1f|\\037)(?:%8b|\\x8b|\\213)|(?:%78|\\x78|x)(?:%01|\\x01|\\001|%5e|\\x5e|\^|%9c|\\x9c|\\234|%da|\\xda|\\332)", re.I)
_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|\\[nrtbf\\/'\"]")
_NAMED = {"n": 10, "r": 13, "t": 9, "b": 8, "f": 12, "/": 47, "\\": 92, "'": 39, '"': 34}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(r"\r?\n[\x20\t]*")
_URL_SAFE = str.maketrans("-_", "+/")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Every secret, and every wrapping of one, is at least so long a stretch of ASCII, of one or two bytes a sign.
_WORTH = re.compile(rb"[\t\n\r\x20-\x7e]{14,}|(?:[\t\n\r\x20-\x7e]\x00){13}")
_WIDE = re.compile("(?:[\t\n\r\x20-\x7e]\x00){13,}[\t\n\r\x20-\x7e]?")


class Find(NamedTuple):
    start: int
    kind: int
    end: int
    depth: int


@dataclass
class Layer:
    """A text and the spans of the original that its characters came from: one each, one for
    all of them (``place``), or, for the original itself, their own."""

    text: str
    starts: array | None
    ends: array | None
    depth: int
    place: tuple[int, int] | None = None
    window: bool = False  # a part of a large stream

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.place:
            return self.place
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])

    def inside(self, text: str, start: int, end: int, window: bool = False) -> Layer:
        """A layer all of whose characters came from one span of this one."""
        return Layer(text, None, None, self.depth + 1, self.origin(start, end), window)


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the secrets that stand openly in a text."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield 1, m.start(), m.end()
    for m in _HEX.finditer(text):  # a run of 32 or more is a whole run
        yield 2, m.start(), m.end()


class _Spelled:
    """A layer as it is written, with the span that each of its characters came from."""

    def __init__(self, layer: Layer):
        self.layer, self.chars, self.starts, self.ends = layer, [], array("q"), array("q")

    def keep(self, a: int, b: int) -> None:
        """Characters of the layer as they stand."""
        layer = self.layer
        self.chars.append(layer.text[a:b])
        if not layer.place:
            self.starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
            self.ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    def put(self, some: str, a: int, b: int) -> None:
        """Characters that a span of the layer stands for."""
        self.chars.append(some)
        if not self.layer.place:
            place = self.layer.origin(a, b)
            self.starts.extend([place[0]] * len(some))
            self.ends.extend([place[1]] * len(some))

    def done(self) -> Layer:
        text, layer = "".join(self.chars), self.layer
        if layer.place:
            return Layer(text, None, None, layer.depth + 1, layer.place)
        return Layer(text, self.starts, self.ends, layer.depth + 1)


def _byte(escape: str) -> int:
    """The byte of a %, hexadecimal or octal escape, or of a named one."""
    if escape[0] == "%" or escape[1] == "x":
        return int(escape[-2:], 16)
    return _NAMED[escape[1]] if escape[1] in _NAMED else int(escape[1:], 8)


def _sign(kind: str, escape: str) -> str:
    """What one escape that is not of a byte stands for."""
    if kind == "chain":
        return escape[0] + _LINK.search(escape)[0] * (len(_LINK.findall(escape)) // 2)
    if kind == "entity":
        return html.unescape(escape)
    if kind == "sign":
        return chr(_NAMED[escape[1]])
    code = int(escape[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 else "\ufffd"


def _unescape(layer: Layer) -> Layer:
    """The whole layer with its escapes replaced; runs of bytes are read as UTF-8. Characters
    outside escapes keep their own spans, so a key stays beside its escaped value."""
    text, out, pos = layer.text, _Spelled(layer), 0
    m = _ESCAPED.search(text)
    while m is not None:
        out.keep(pos, m.start())
        pos = m.start()
        if m.lastgroup != "byte":
            out.put(_sign(m.lastgroup, m[0]), pos, m.end())
            pos = m.end()
        else:
            raw, stops, first = bytearray(), [], pos
            while m is not None and m.lastgroup == "byte":
                raw.append(_byte(m[0]))
                stops.append(m.end())
                m = _ESCAPED.match(text, m.end())
            done = 0
            for c in bytes(raw).decode("utf-8", "replace"):
                size = len(c.encode("utf-8", "replace")) if c != "�" else 1
                last = min(done + size, len(stops))
                out.put(c, stops[done - 1] if done else first, stops[max(last, 1) - 1])
                done = min(last, len(stops) - 1)
            pos = stops[-1]
        m = _ESCAPED.search(text, pos)
    out.keep(pos, len(text))
    return out.done()


def _text(raw: bytes) -> str:
    """The bytes as UTF-8; what is none becomes one lone surrogate a byte, which no pattern has."""
    return raw.decode("utf-8", "surrogateescape")


class _Feed:
    """Bytes that are read once and in order, some of them given back."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.taken = iter(parts), b"", 0

    def read(self) -> bytes:
        """Some bytes; none at the end."""
        part, self.held = self.held or next(self.parts, b""), b""
        self.taken += len(part)
        return part

    def at_least(self, size: int) -> bytes:
        """That many bytes or more, or all that are left."""
        out, have = [], 0
        while have < size and (part := self.read()):
            out.append(part)
            have += len(part)
        return b"".join(out)

    def back(self, part: bytes) -> None:
        self.held = part + self.held
        self.taken -= len(part)


def _header(head: bytes) -> int:
    """The length of a stream's header; 0 if there is none."""
    if not _STREAM.match(head):
        return 0
    if head[0] != 0x1F:
        return 2
    flags, at = head[3] if len(head) > 3 else 0, 10
    if flags > 31:
        return 0
    if flags & 4:
        at += 2 + int.from_bytes(head[at:at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            at = head.find(b"\0", at) + 1
            if not at:
                return 0
    return at + 2 if flags & 2 else at


def _salvage(stream, data: bytes) -> Iterator[bytes]:
    """What comes out before the stream breaks."""
    try:
        for i in range(len(data)):
            if part := stream.decompress(data[i:i + 1]):
                yield part
    except zlib.error:
        return


def _pieces(feed: _Feed) -> Iterator[bytes]:
    """What the stream at the feed's head holds, with all members that follow it. The feed goes
    on behind it. One that breaks, ends early or has a wrong checksum may be none: the feed then
    goes on behind the first sign of its header, unless it was longer than one read."""
    while n := _header(head := feed.at_least(_READ)):
        packed, sound = head[0] == 0x1F, False
        stream, data, start = zlib.decompressobj(-15), head[n:], feed.taken - len(head)
        check, total = zlib.crc32 if packed else zlib.adler32, 0 if packed else 1
        while True:
            before = stream.copy()
            try:
                part = stream.decompress(data, _READ)
            except zlib.error:
                yield from _salvage(before, data)
                break
            if part:
                total = check(part, total)
                yield part
            if stream.eof:
                feed.back(stream.unused_data)
                tail = feed.at_least(8 if packed else 4)
                sound = int.from_bytes(tail[:4], "little" if packed else "big") == total
                feed.back(tail[8 if packed else 4:])
                break
            data = stream.unconsumed_tail or (b"" if len(part) >= _READ else feed.read())
            if not data and len(part) < _READ:
                break
        if not sound:
            if feed.taken - start <= len(head):
                feed.back(head[1:feed.taken - start])
            return
    feed.back(head)


def _windows(parts: Iterator[bytes], ready: list[bytes]) -> Iterator[bytes]:
    """The parts as they are; windows of them are put into ``ready``."""
    some, have = [], 0
    for part in parts:
        some.append(part)
        have += len(part)
        if have >= WINDOW:
            ready.append(b"".join(some))
            some = [ready[-1][-OVERLAP:]]
            have = OVERLAP
        yield part
    ready.append(b"".join(some))


def _opened(parts: Iterator[bytes], seen: set, level: int) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whole) of a large stream: its windows, and the streams in it, whole if small."""
    ready: list[bytes] = []
    for inner in _within(_Feed(_windows(parts, ready)), seen, level):
        while ready:
            yield ready.pop(), False
        yield inner
    while ready:
        yield ready.pop(), False


def _within(feed: _Feed, seen: set, level: int) -> Iterator[tuple[bytes, bool]]:
    carry = b""
    while data := feed.read():
        data = carry + data
        m = _STREAM.search(data)
        if not m:
            carry = data[-2:]
            yield b"", False
            continue
        carry = b""
        feed.back(data[m.start():])
        at, out = feed.taken, _Feed(_pieces(feed))
        first = out.at_least(WINDOW)
        key = hashlib.blake2b(first, digest_size=16).digest()
        if len(first) < WINDOW:
            yield first, True
        elif level < LEVELS and key not in seen:
            seen.add(key)
            out.back(first)
            yield from _opened(iter(out.read, b""), seen, level + 1)
        while out.read():
            yield b"", False
        if feed.taken <= at:  # no stream: its first sign is passed over
            rest = feed.at_least(1)
            feed.back(rest[1:])


def _slices(raw: bytes, at: int) -> Iterator[bytes]:
    return (raw[i:i + _READ] for i in range(at, len(raw), _READ))


def _streams(raw: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, window) of the streams in the bytes and, with the same span, in those;
    a stream is one text or, if large, many windows."""
    work, seen = [(raw, None)], set()
    while work:
        raw, span = work.pop()
        done = 0
        for m in _STREAM.finditer(raw):
            if m.start() < done:
                continue
            feed, size = _Feed(_slices(raw, m.start())), 0
            for part in _pieces(feed):
                size += len(part)
            if not size:
                continue
            end = m.start() + max(feed.taken, 1)
            done = end
            place = span or (m.start(), end if feed.taken > 1 else len(raw))
            parts = _pieces(_Feed(_slices(raw, m.start())))
            inners = [(b"".join(parts), True)] if size < WINDOW else _opened(parts, seen, 1)
            for inner, whole in inners:
                key = hashlib.blake2b(inner, digest_size=16).digest(), place
                if inner and key not in seen:
                    seen.add(key)
                    if whole:
                        work.append((inner, place))
                    if _WORTH.search(inner):
                        yield _text(inner), *place, not whole


def _escaped_streams(layer: Layer) -> Iterator[Layer]:
    """The streams that stand in the layer as escaped bytes, maybe among plain ones."""
    raw, ends, pos, text = bytearray(), array("q"), 0, layer.text
    for m in [*_BYTE.finditer(text), None]:
        for i in range(pos, m.start() if m else len(text)):
            some = text[i].encode("utf-8", "surrogatepass")
            raw += some
            ends.extend([i + 1] * len(some))
        if m:
            raw.append(_byte(m[0]))
            ends.append(m.end())
            pos = m.end()
    for inner, a, b, window in _streams(bytes(raw)):
        yield layer.inside(inner, ends[a - 1] if a else 0, ends[b - 1], window)


def _debase(layer: Layer, start: int, run: str) -> Iterator[Layer]:
    """What a base64 run holds, read from each of its first four signs, since other words may be
    glued to either end: its text, and the streams in it."""
    run = run.rstrip("=")
    breaks = [(m.start(), m.end()) for m in _BREAK.finditer(run)]
    place = range(start, start + len(run))
    if breaks:
        edges = [0, *(x for pair in breaks for x in pair), len(run)]
        lines = list(zip(edges[::2], edges[1::2]))
        place = [start + i for a, b in lines for i in range(a, b)]
        run = "".join(run[a:b] for a, b in lines)
    run = run.translate(_URL_SAFE)
    for first in range(4):
        size = len(run) - first
        size -= size % 4 == 1
        raw = base64.b64decode(run[first:first + size] + "=" * (-size % 4))
        span = lambda a, b: (place[first + a * 8 // 6], place[first + min(size, -(-b * 8 // 6)) - 1] + 1)  # noqa: E731, B023
        if _WORTH.search(raw):
            out, byte = _Spelled(layer), 0
            for c in _text(raw):
                n = 1 if "\ud800" <= c <= "\udfff" else len(c.encode())
                out.put(c, *span(byte, byte + n))
                byte += n
            yield out.done()
        for inner, a, b, window in _streams(raw):
            yield layer.inside(inner, *span(a, b), window)


def _narrow(layer: Layer, start: int, end: int) -> Layer:
    """A stretch of two-byte text without the zero bytes."""
    out = _Spelled(layer)
    for i in range(start, end, 2):
        out.keep(i, i + 1)
    return out.done()


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside one."""
    text = layer.text
    if "%" in text or "\\" in text or "&" in text:
        if _ESCAPED.search(text):
            yield _unescape(layer)
        if _PACKED.search(text):
            yield from _escaped_streams(layer)
    if "\0" in text:
        for m in _WIDE.finditer(text):
            yield _narrow(layer, *m.span())
    for m in _BASE64.finditer(text):
        yield from _debase(layer, m.start(), m[0])


def _explore(top: Layer, found: dict, seen: set) -> None:
    """The finds of a layer and of all in it. A window of a large stream is done with at once,
    so that one is held at a time."""
    work = deque([top])
    while work:
        layer = work.popleft()
        for kind, start, end in scan(layer.text):
            a, b = layer.origin(start, end)
            found.setdefault((a, kind, b), layer.depth)
        for inner in unwrap(layer):
            key = hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.origin(0, 1)[0] if inner.text else 0
            if key not in seen:
                seen.add(key)
                if inner.window:
                    _explore(inner, found, seen)
                else:
                    work.append(inner)


def find_secrets(text: str) -> list[Find]:
    """All finds of a text and its layers, by start, kind and end; open ones first."""
    found: dict[tuple[int, int, int], int] = {}
    _explore(Layer(text, None, None, 0), found, set())
    return [Find(*k, depth) for k, depth in sorted(found.items())]


def redact(text: str, finds: list[Find]) -> str:
    """The text with each stretch of finds replaced by a mark of the first one's kind."""
    out, done = [], 0
    for f in sorted(finds):
        if f.start >= done:
            out += [text[done:f.start], f"[{KINDS[f.kind]}]"]
        done = max(done, f.end)
    return "".join(out) + text[done:]


def _scan(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = S.clean(batch["text"])
            for a, b in S.chunks(texts):
                finds = [find_secrets(t) for t in texts[a:b]]
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(), "spans": [
                    [{"kind": KINDS[f.kind], "start": f.start, "end": f.end, "depth": f.depth} for f in x] for x in finds]})
                if with_text:
                    out["redacted"] = [redact(t, x) if x else t for t, x in zip(texts[a:b], finds)]
                yield out
    return run


SPANS = "spans array<struct<kind:string,start:int,end:int,depth:int>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan(False), f"doc_id long, {SPANS}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows as they are, with the secrets of ``text`` (a null stays null) replaced by marks."""
    return docs.mapInArrow(S.arrow_rewrite(lambda text: redact(text, find_secrets(text))), docs.schema)
