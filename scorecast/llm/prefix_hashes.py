"""Operator 3: document fingerprints from prefix polynomial hashes.

The hash of a text's first p code points is kept for every p, modulo two primes. From these
arrays the hash of any span follows in constant time, so spans are compared without reading
them, and the longest common extension of two positions is found by binary search.

A fingerprint holds the length, the hash of the whole text, and the hashes of its prefixes
and suffixes of the lengths of a fixed ladder (two steps an octave). Two fingerprints agree
on a prefix length exactly where the texts do, so a binary search over the ladder finds the
longest rung that both share at either end; the likeness is the shared part of the longer
text (1 for equal texts).

``fingerprint_edits`` compares every text with an edited copy and with the next document.
Rows are dealt by ranges of (doc_id, text hash) and sorted, so that the next document is the
next row; a range's last row meets the next range's first in a table of two rows a range.

Edge cases: null counts as empty; an empty text has length 0 and likeness 1 to an empty one,
0 to others; repeated rows are neighbours of each other; rows with a null ``doc_id`` come
first; a table of one row is its own next document; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scorecast.llm.scratch import shuffle_partitions, written

#: Primes below 2^31 and a base for each.
PRIMES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
#: Digits of a rung's hash in a fingerprint.
RUNG_DIGITS = 6

_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, prime: int, n: int) -> np.ndarray:
    """base^i modulo prime for i < n, doubled until long enough."""
    table = _powers.get((base, prime), np.ones(1, dtype=np.uint64))
    while len(table) < n:
        step = np.uint64(pow(base, len(table), prime))
        table = np.concatenate((table, table * step % np.uint64(prime)))
    _powers[base, prime] = table
    return table[:n]


class PrefixHashes:
    """Prefix hashes of one text: ``prefix[k][p]`` is that of its first p code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []
        for prime, base in PRIMES:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            # Each term is below 2^31, so 2^33 of them add up without overflow.
            np.cumsum(points * _power(base, prime, self.n) % np.uint64(prime), out=sums[1:])
            self.prefix.append(sums % np.uint64(prime))

    def span(self, starts, ends) -> np.ndarray:
        """62-bit hashes of spans; equal spans of any texts have equal hashes."""
        out = np.zeros(np.shape(starts), dtype=np.uint64)
        for (prime, base), sums in zip(PRIMES, self.prefix):
            p = np.uint64(prime)
            back = _power(pow(base, -1, prime), prime, self.n + 1)[starts]
            out = out << np.uint64(31) | (sums[ends] + p - sums[starts]) % p * back % p
        return out

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        a = self.span(np.array([start]), np.array([start + length]))
        return bool(a[0] == other.span(np.array([other_start]), np.array([other_start + length]))[0])

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """How far the texts agree from the two positions on, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        """length:whole:prefix rungs:suffix rungs, in hexadecimal."""
        rungs = ladder(self.n)
        zero = np.zeros(len(rungs), dtype=np.int64)
        whole = self.span(np.array([0]), np.array([self.n]))[0]
        mask = (1 << 4 * RUNG_DIGITS) - 1
        ends = ["".join(f"{int(h) & mask:0{RUNG_DIGITS}x}" for h in x)
                for x in (self.span(zero, rungs), self.span(self.n - rungs, zero + self.n))]
        return f"{self.n:x}:{int(whole):016x}:{ends[0]}:{ends[1]}"


def ladder(n: int) -> np.ndarray:
    """Lengths 1, 2, 3, 4, 6, 8, 12, ... up to n: two an octave."""
    out, octave = [1], 2
    while octave <= n:
        out += [octave, octave * 3 // 2]
        octave *= 2
    return np.array(sorted({x for x in out if x <= n}), dtype=np.int64)


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the two fingerprints show as common, 0 to 1."""
    (n_a, whole_a, *ends_a), (n_b, whole_b, *ends_b) = a.split(":"), b.split(":")
    n_a, n_b = int(n_a, 16), int(n_b, 16)
    if n_a == n_b and whole_a == whole_b:
        return 1.0
    rungs, common = ladder(min(n_a, n_b)), 0
    for x, y in zip(ends_a, ends_b):
        low, high = 0, len(rungs)
        while low < high:  # agreement on a rung implies agreement on all shorter ones
            middle = (low + high + 1) // 2
            at = slice((middle - 1) * RUNG_DIGITS, middle * RUNG_DIGITS)
            low, high = (middle, high) if x[at] == y[at] else (low, middle - 1)
        common += int(rungs[low - 1]) if low else 0
    return min(1.0, common / max(n_a, n_b, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = PrefixHashes(changed).fingerprint()
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own, changed_print,
            likeness(own, changed_print), likeness(own, next_print))


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare each row with the row after it; the first and last rows of a range go on with
    their texts, to meet those of its neighbours."""
    here, held = TaskContext.get().partitionId(), None
    columns = [*_RESULT, "range", "end", "text"]
    for batch in batches:
        out, size = [], 0
        for doc, text in zip(batch["doc_id"], batch["text"]):
            doc, text = None if pd.isna(doc) else int(doc), text if isinstance(text, str) else ""
            own = PrefixHashes(text).fingerprint()
            if held is None:
                out.append((doc, len(text), "", own, "", 0.0, 0.0, here, "first", text))
            else:
                out.append((*compare(*held, text, own), here, "", None))
            held = (doc, text, own)
            size += len(text)
            if size > 4_000_000:
                yield _frame(out, columns)
                out, size = [], 0
        if out:
            yield _frame(out, columns)
    if held is not None:
        yield _frame([(held[0], len(held[1]), "", held[2], "", 0.0, 0.0, here, "last", held[1])], columns)


def _join_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([compare(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, r.fingerprint, r.next_text, r.next_print)
                      for r in batch.itertuples()], _RESULT)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited copy, and their likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    walked = written(
        rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text").mapInPandas(_walk, f"{_SCHEMA}, range int, end string, text string"), "prefix-hashes")
    lasts = walked.filter("end = 'last'")
    firsts = walked.filter("end = 'first'")
    # Two rows a range: the next range that has rows, and the first range after the last.
    ranges = firsts.select("range")
    order = ranges.select("range", F.lead("range").over(W.orderBy("range")).alias("next_range"))
    order = order.join(F.broadcast(ranges.agg(F.min("range").alias("least")))).select(
        "range", F.coalesce("next_range", "least").alias("next_range"))
    ends = (lasts.join(order, "range").join(
        firsts.select(F.col("range").alias("next_range"), F.col("text").alias("next_text"),
                      F.col("fingerprint").alias("next_print")), "next_range")
        .select("doc_id", "text", "fingerprint", "next_text", "next_print"))
    return walked.filter("end = ''").select(*_RESULT).unionByName(ends.mapInPandas(_join_ends, _SCHEMA))
