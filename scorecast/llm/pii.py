"""Operator 10: format-preserving pseudonyms for personal data by keyed Feistel permutations.

Numbers and dates are found by their format and validated (checksums, ranges, calendar). A
valid value is ranked within its format, the rank is permuted by a keyed Feistel network with
cycle walking, and the permuted rank is written in the same format, with its checksum. Equal
values have equal pseudonyms in every document, different ones have different pseudonyms, and
the holder of the key can turn each back. Nothing is shared between rows, so the work is one
pass without a shuffle.

Kinds: e-mail addresses (letters and digits of the local part, each within its class), payment
cards (Luhn; the first digit and the length stay), phone numbers (the country code and signs
stay), IPv4 addresses, US social security numbers, IBANs (the country stays, check digits
follow), dates (YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY or MM/DD/YYYY; one date has one pseudonym
in all formats).

Edge cases: null stays null; empty texts stay; values that fail their check stay; repeated
rows get equal texts; an empty table gives an empty result; other columns are not read. Of
overlapping finds the leftmost counts, and of those the first kind in the order above.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import spans as S

KEY = b"pseudonyms-1"
ROUNDS = 8

# The kinds in order of precedence, with their patterns.
KINDS = ("email", "card", "phone", "ipv4", "ssn", "iban", "date")
_PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A),
    "card": re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
                        r"|(?<![\w+.-])\+\d{8,15}(?![\w-])|(?<![\w+.-])\+\d(?:[ .-]?\(\d{1,4}\)|[ .-]?\d){6,14}(?![\w-])", re.A),
    "ipv4": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d)", re.A),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])", re.A),
}
_DIGIT = re.compile(r"\d")
#: Country codes of one and of two digits (ITU-T E.164); all others have three.
_ONE = {"1", "7"}
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Lengths of the IBANs of the countries in the registry.
_IBAN_LENGTH = dict(x.split(":") for x in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28
CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22
IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30
NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28
TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30""".split())


@lru_cache(maxsize=100_000)
def permute(value: int, n: int, kind: str, key: bytes = KEY, forward: bool = True) -> int:
    """The place of ``value`` in the keyed permutation of 0..n-1 of a kind, or the way back."""
    if n < 2:
        return value
    half = -(-(n - 1).bit_length() // 2)
    mask, size = (1 << half) - 1, -(-half // 8)

    def turn(r: int, x: int) -> int:
        h = hashlib.blake2b(b"%d:%d:%d" % (r, n, x), key=key, person=kind.encode()[:16], digest_size=max(1, size))
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if forward:
            for r in range(ROUNDS):
                left, right = right, left ^ turn(r, right)
        else:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ turn(r, left), left
        value = left << half | right
        if value < n:
            return value


#: Digits and letters permuted as one number; a longer value is permuted in blocks.
WHOLE, BLOCK = 200, 64

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_signs(text: str, kind: str, key: bytes, forward: bool) -> str:
    """Digits and letters permuted together, each within its class; other signs stay.

    More than ``WHOLE`` of them are permuted in blocks of ``BLOCK``, each under a tweak of the
    kind, their number and the block's place, so a value of any length takes linear time."""
    at = [i for i, c in enumerate(text) if any(c in s for s in _CLASSES)]
    if len(at) > WHOLE:
        cuts = [0, *at[BLOCK::BLOCK], len(text)]
        tweaks = (hashlib.blake2b(f"{kind}|{len(at)}|{k}".encode(), digest_size=8).hexdigest()[:13] for k in range(len(cuts)))
        return "".join(permute_signs(text[i:j], tweak, key, forward) for i, j, tweak in zip(cuts[:-1], cuts[1:], tweaks))
    digits = [(i, c, next((s for s in _CLASSES if c in s), None)) for i, c in enumerate(text)]
    value, n, shape = 0, 1, []
    for i, c, signs in digits:
        if signs:
            value, n = value * len(signs) + signs.index(c), n * len(signs)
            shape.append((i, signs))
    value, out = permute(value, n, kind + str(len(shape)), key, forward), list(text)
    for i, signs in reversed(shape):
        value, k = divmod(value, len(signs))
        out[i] = signs[k]
    return "".join(out)


def _fill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _email(text: str, key: bytes, forward: bool) -> str:
    local, _, domain = text.rpartition("@")
    return permute_signs(local, "email", key, forward) + "@" + domain


def _card(text: str, key: bytes, forward: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[0] + permute_signs(d[1:-1], "card", key, forward)
    return _fill(text, body + str(luhn(body)))


def _country(digits: str) -> int:
    """How many digits the country code has with which an international number begins."""
    return 1 if digits[0] in _ONE else 2 if digits[:2] in _TWO else 3


def _phone(text: str, key: bytes, forward: bool) -> str | None:
    """The digits after the country code, permuted; a number without one is read as it stands
    after +1, whose form it has, so all forms of a number share a pseudonym."""
    digits = re.sub(r"\D", "", text)
    code = _country(digits) if text[0] == "+" else 0
    if not code < len(digits) or text[0] == "+" and not 7 <= len(digits) <= 15:
        return None
    return _fill(text, digits[:code] + permute_signs(digits[code:], "phone", key, forward))


def _ipv4(text: str, key: bytes, forward: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", key, forward)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, forward: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, 898 * 99 * 9999, "ssn", key, forward), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def _iban_end(text: str) -> int:
    """Where the IBAN at the start of a find ends by its country's length; words may follow it."""
    left = int(_IBAN_LENGTH.get(text[:2], 0))
    for i, c in enumerate(text):
        left -= c != " "
        if not left and text[i + 1:i + 2] in ("", " "):
            return i + 1
    return len(text)


def _iban(text: str, key: bytes, forward: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_signs(plain[4:], "iban", key, forward)
    it = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body)
    return "".join(c if c == " " else next(it) for c in text)


_YEARS = (dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal())


def _date(text: str, key: bytes, forward: bool) -> str | None:
    formats = {"-": ("%Y-%m-%d",), ".": ("%d.%m.%Y",), "/": ("%d/%m/%Y", "%m/%d/%Y")}[re.search(r"\D", text)[0]]
    for form in formats:
        try:
            day = dt.datetime.strptime(text, form).date().toordinal()
        except ValueError:
            continue
        if not _YEARS[0] <= day < _YEARS[1]:
            return None
        moved = _YEARS[0] + permute(day - _YEARS[0], _YEARS[1] - _YEARS[0], "date", key, forward)
        return dt.date.fromordinal(moved).strftime(form)
    return None


_WRITERS = {"email": _email, "card": _card, "phone": _phone, "ipv4": _ipv4, "ssn": _ssn, "iban": _iban, "date": _date}


def find_personal(text: str, key: bytes = KEY, forward: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values of a text, not overlapping."""
    number = _DIGIT.search(text) is not None
    found = []
    for rank, kind in enumerate(KINDS):
        if ("@" in text) if kind == "email" else number:
            pos = 0
            while m := _PATTERNS[kind].search(text, pos):
                value, pos = m[0], m.end()
                other = _WRITERS[kind](value[:_iban_end(value)] if kind == "iban" else value, key, forward)
                if kind == "iban":
                    if other is not None:
                        value = value[:_iban_end(value)]
                    else:
                        other = _iban(value, key, forward)
                    # What was cut off, or is no IBAN as a whole, may hold another one.
                    pos = m.start() + (len(value) if other is not None else 4)
                if other is not None:
                    found.append((m.start(), rank, m.start() + len(value), other))
    out, done = [], 0
    for start, rank, end, other in sorted(found):
        if start >= done:
            out.append((start, end, KINDS[rank], other))
            done = end
    return out


def replace(text: str, finds: list[tuple[int, int, str, str]]) -> str:
    out, done = [], 0
    for start, end, _, other in finds:
        out += [text[done:start], other]
        done = end
    return "".join(out) + text[done:]


def _pseudonyms(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = S.clean(batch["text"])
            for a, b in S.chunks(texts):
                finds = [find_personal(t, key) for t in texts[a:b]]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(),
                    "text": [replace(t, f) if isinstance(o, str) else None
                             for t, f, o in zip(texts[a:b], finds, batch["text"].iloc[a:b])],
                    "spans": [[{"kind": k, "start": s, "end": e, "pseudonym": p} for s, e, k, p in f] for f in finds]})
    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, spans) for every row; spans are of the original text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _pseudonyms(key), "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,pseudonym:string>>")
