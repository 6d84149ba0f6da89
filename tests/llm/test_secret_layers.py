"""Layers of secrets: further escapes, two-byte text, damaged and large streams, long chains."""

import base64
import gzip
import json
import random
import subprocess
import sys
import time
import zlib

import pytest

from scorecast.llm import secrets

SECRET = "password=hunter2hunter2"


def _b64(raw):
    return base64.b64encode(raw).decode()


def _deep(text):
    return [f for f in secrets.find_secrets(text) if f.depth and f.kind == 0]


_BAD = gzip.compress(SECRET.encode(), mtime=0)
_BAD = _BAD[:-8] + bytes(4) + _BAD[-4:]


@pytest.mark.parametrize("text", [
    json.dumps(json.dumps({"password": "hunter2hunter2"})),
    json.dumps(json.dumps(json.dumps({"password": "hunter2/hunter2"}))).replace("/", "\\/"),
    "password=&quot;hunter2hunter2&quot;", "password=&#104;unter2hunter2", "password=&#x68;unter2hunter2",
    "password&equals;hunter2hunter2", "password=&amp;quot;hunter2hunter2",
    "password=%u0068unter2hunter2", "password=\\U00000068unter2hunter2", "password=\\u{68}unter2hunter2",
    "password=\\150unter2hunter2", "".join(f"\\{b:03o}" for b in SECRET.encode()),
    "".join(f"\\{b:03o}" for b in gzip.compress(SECRET.encode())),
    *(f"x {_b64(SECRET.encode(c))} y" for c in ("utf-16", "utf-16-le", "utf-16-be")),
    f"x {_b64(gzip.compress(SECRET.encode('utf-16')))} y",
    f"x {_b64(_BAD)} y", f"x {_b64(gzip.compress(_BAD))} y",
    f"x {_b64(zlib.compress(SECRET.encode())[:-4] + b'abcd')} y",
    f"x {_b64(gzip.compress(random.Random(1).randbytes(50) + SECRET.encode() + b' ' + random.Random(2).randbytes(9000))[:-4000])} y"])
def test_further_layers(text):
    finds = _deep(f"é {text} ü")
    assert finds and all(0 <= f.start < f.end <= len(text) + 4 for f in finds)


def test_exact_places_of_escapes():
    for value in ("&#104;unter2hunter2", "\\150unter2hunter2", "%u0068unter2hunter2"):
        text = f"& a \\ b token: {value} end & %"
        f = _deep(text)[0]
        assert text[f.start:f.end] == f"token: {value}"
        assert secrets.redact(text, secrets.find_secrets(text)) == "& a \\ b [assign] end & %"


@pytest.mark.parametrize("text", ["&", "\\", "%", "&#1114112;", "&#x110000;", "\\U00110000", "\\u{110000}", "\\ud800", "&#0;",
                                  "\\777", "\0" * 60, "z\0" * 60, "x\x9c" * 99, _b64(b"x\x9c" * 99), _b64(b"\x1f\x8b\x08\xff" * 9)])
def test_broken_escapes_have_no_finds(text):
    assert secrets.find_secrets(text) == []


@pytest.mark.parametrize("link, head", [("25", "%"), ("amp;", "&"), ("u005c", "\\"), ("x5c", "\\")])
def test_long_chains_are_few_layers(link, head):
    last = {"25": "61bcdefgh1", "amp;": "#97;bcdefgh1", "u005c": "u0061bcdefgh1", "x5c": "x61bcdefgh1"}[link]
    start = time.time()
    for n in (1, 7, 8, 9, 10, 33, 20_000):
        text = "token=" + head + link * n + last
        assert any(f.start == 0 and f.end == len(text) for f in _deep(text)), n
    assert time.time() - start < 10


def _large(window, inner):
    """More than a window around something, so that it is cut by the window's end or near it."""
    return b"".join(b"line of words %d\n" % i for i in range(window // 16)) + inner


@pytest.mark.parametrize("window", [1 << 12, 1 << 14])
@pytest.mark.parametrize("wrap", [
    lambda s: s, gzip.compress, lambda s: zlib.compress(gzip.compress(s)), lambda s: base64.b64encode(s),
    lambda s: gzip.compress(_large(1 << 14, gzip.compress(_large(1 << 15, s)) + b"tail")),
    lambda s: gzip.compress(_large(1 << 14, b"")) + gzip.compress(s)])
def test_windows_find_what_whole_streams_hold(monkeypatch, window, wrap):
    monkeypatch.setattr(secrets, "WINDOW", window)
    monkeypatch.setattr(secrets, "OVERLAP", 256)
    monkeypatch.setattr(secrets, "_READ", 512)
    for shift in range(0, 600, 37):
        raw = gzip.compress(_large(window, b" " * shift + b"x\x9c no stream \x1f\x8b\x08 " + wrap(SECRET.encode()) + b" more " * 99))
        text = f"see {_b64(raw)} end"
        finds = _deep(text)
        assert {(f.start, f.kind) for f in finds} == {(4, 0)}, shift
        assert all(len(text) - 8 <= f.end <= len(text) - 4 for f in finds)


def test_streams_that_hold_themselves_or_nest_deeply_end():
    raw = SECRET.encode()
    for _ in range(1500):
        raw = zlib.compress(raw, 1)
    assert _deep(f"x {_b64(raw)} y")


_MEASURE = """
import base64, gzip, io, resource, sys, zlib
from scorecast.llm import secrets
def bomb(n, tail):
    stream = zlib.compressobj(9, zlib.DEFLATED, 31)
    out = [stream.compress(bytes(1 << 20)) for _ in range(n)]
    return b"".join(out + [stream.compress(tail), stream.flush()])
raw = bomb(400, b" token=abcdefgh1234 ")
raw = bomb(2, raw)
finds = secrets.find_secrets("a " + base64.b64encode(raw).decode())
assert [f.kind for f in finds] == [0], finds
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_does_not_grow_with_a_stream():
    got = subprocess.run([sys.executable, "-c", _MEASURE], capture_output=True, text=True, timeout=300, check=True)
    assert int(got.stdout) < 500
