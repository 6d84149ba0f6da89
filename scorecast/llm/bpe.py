"""Operator 6: byte-level BPE by prefix-sharing trie traversal.

A text is split into words by the vocabulary's public pre-tokenisation rule. The distinct
words of a batch, in byte order, are the depth-first order of their trie: a word keeps the
states of the prefix it shares with the word before and extends them byte by byte. A state
is the last token of the prefix's encoding. Exactly one token that ends the prefix is right:
the one that, joined to the last token of what stands before it, is left as it is by the
merge rules. So the encoding of a shared prefix is computed once, and a word's ids are read
back along its chain of last tokens.

Edge cases: null texts count as empty; an empty text has no ids; ``<|endoftext|>`` in a text
is the vocabulary's special token (as in the tokenizers library unless told otherwise);
repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import spans as S

#: Entries of the memo of token pairs kept per Python worker.
MEMO = 400_000
#: Distinct words whose encodings one worker keeps from batch to batch.
KEEP_WORDS = 300_000
#: Code points whose distinct words are looked up together.
CHUNK = 600_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
# Contractions that the pre-tokenisation rule splits off.
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    gap = 0xE000 - 0xD800
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            first, last = (x + gap if x >= 0xD800 else x for x in (m.start(), m.end() - 1))
            table[first:last + 1] = kind
    return table


def split_words(points: np.ndarray, bounds: np.ndarray, text: str) -> np.ndarray:
    """Starts of all words in ``points``, ascending; a word ends where the next one starts.

    Words are: a contraction tail; letters, numbers or other signs with at most one blank
    before them; white space, of which the last character before a sign stands alone or,
    as a blank, goes to the sign.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start |= edge[:-1]
    sign = kind != _SPACE
    # The last white-space character before a sign of the same document starts a word;
    # if it is a blank, the sign joins it.
    last = np.zeros(n, dtype=bool)
    last[:-1] = ~sign[:-1] & sign[1:] & ~edge[1:n]
    start |= last
    joined = np.flatnonzero(last & (points == 32)) + 1
    start[joined] = False
    _contractions(text, points, kind, start, edge)
    return np.flatnonzero(start)


def _contractions(text: str, points: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    """Move the starts around apostrophes that open a contraction tail at a word's start.

    A tail counts only where the scan stands at the apostrophe: not after a blank, and not
    inside a run of other signs. What follows it starts a word of its own.
    """
    at = text.find("'")
    free_from = 0
    while at >= 0:
        if at >= free_from and start[at]:
            for tail in _TAILS:
                end = at + 1 + len(tail)
                if text.startswith(tail, at + 1) and not edge[at + 1:end].any():
                    start[at + 1:end] = False
                    if end < len(points) and not edge[end]:
                        # A run of letters or other signs goes on as a word of its own.
                        start[end] = True
                    free_from = end
                    break
            else:
                # The apostrophe opens a run of other signs; later ones in it are inside.
                free_from = at + 1
        at = text.find("'", at + 1)


class Vocabulary:
    """A byte-level BPE vocabulary file with its merge rules."""

    def __init__(self, path: str):
        self.path, model = path, self._read(path)
        raw = self._raw()
        self.ids = {raw(t): i for t, i in model["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self._whole: dict[bytes, bool] = {}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    @staticmethod
    def _read(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    @classmethod
    def _raw(cls):
        to_byte = cls._byte_signs()
        return lambda token: bytes(to_byte[c] for c in token)

    # The merge rules are most of a vocabulary's memory: read only where they are applied.
    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        raw, ranks = self._raw(), {}
        for rank, pair in enumerate(self._read(self.path)["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks[raw(left), raw(right)] = rank
        return ranks

    @cached_property
    def made(self) -> dict[bytes, tuple[bytes, bytes, int]]:
        made: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (left, right), rank in self.ranks.items():
            made.setdefault(left + right, (left, right, rank))
        return made

    @staticmethod
    def _byte_signs() -> dict[str, int]:
        """The sign that stands for each byte in the file: printable Latin-1 signs for
        themselves, the others in order from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE: join the adjacent pair of least rank until none has a rule."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: bytes) -> bool:
        """The merge rules build ``token`` from its bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(token) == [token]
        return known

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is built, from the single
        byte on, each with the rank at which a merge takes it up (ranks ascend)."""
        known = self._edges.get((token, right))
        if known is None:
            known, part = [(token, 1 << 60)], token
            while len(part) > 1:
                a, b, rank = self.made[part]
                part = b if right else a
                known.append((part, rank))
            known = self._edges[token, right] = known[::-1]
        return known

    def fits(self, left: int, right: int) -> bool:
        """The merge rules leave the two tokens beside each other as they are: at no time
        is there a rule for the parts on both sides of the border whose turn comes before
        a merge takes up one of them."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            a, b, i, j = self.edge(self.bytes[left], True), self.edge(self.bytes[right], False), 0, 0
            while known is None:
                (x, x_until), (y, y_until) = a[i], b[j]
                cross = self.ranks.get((x, y), 1 << 60)
                if cross < x_until and cross <= y_until and cross < 1 << 60:
                    known = False  # of equal ranks the leftmost goes first
                elif x_until == y_until == 1 << 60:
                    known = True
                elif x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self._fits[left, right] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each of the sorted distinct ``words``: depth-first over their trie."""
        ids, longest, fits = self.ids, self.longest, self._fits
        last: list[int] = [0]   # last[d]: id of the last token of the prefix of d bytes
        size: list[int] = [0]   # its length
        out, before = [], b""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:], size[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = ids.get(word[begin:end])
                    if token is None:
                        continue
                    if not begin:
                        if self.whole(word[:end]):
                            break
                    else:
                        known = fits.get((last[begin], token))
                        if (known if known is not None else self.fits(last[begin], token)) \
                                and (end - begin == 1 or self.whole(word[begin:end])):
                            break
                last.append(token)
                size.append(end - begin)
            at, back = len(word), []
            while at:
                back.append(last[at])
                at -= size[at]
            out.append(tuple(back[::-1]))
            before = word
        return out

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, and their ids (None for text)."""
        found: list[tuple[str, int | None]] = [(text, None)]
        for sign, token in self.special.items():
            if sign in text:
                found = [y for x, t in found for y in (
                    [(x, t)] if t is not None else
                    [z for k, part in enumerate(x.split(sign)) for z in ([(sign, token)] * bool(k) + [(part, None)])])]
        return found

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
        """For each chunk of rows: (first row, last row, distinct words, index of every word
        in them, first word of every row). A special token is a word of its own."""
        for a, b in S.chunks(texts, CHUNK):
            parts, row_of, tokens = [], [], []
            for i in range(a, b):
                for part, token in self.pieces(texts[i]) if any(s in texts[i] for s in self.special) else ((texts[i], None),):
                    parts.append(part)
                    row_of.append(i - a)
                    tokens.append(token)
            points, bounds = S.join_points(parts)
            text = "".join(parts)
            starts = split_words(points, bounds, text)
            part_of = S.owner(bounds, starts)
            special = np.array([t is not None for t in tokens], dtype=bool)
            keep = ~special[part_of] | (starts == bounds[part_of])
            starts, part_of = starts[keep], part_of[keep]
            ends = np.append(starts[1:], len(points))
            hashes = S.span_hashes(S.symbol_table(False)[points], starts, ends)
            hashes[special[part_of]] ^= S.U64(S.BASE)  # not the same word as its letters
            _, where, index = np.unique(hashes, return_index=True, return_inverse=True)
            words = [text[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            if special.any():
                words = [SpecialWord(w) if special[part_of[k]] else w for w, k in zip(words, where.tolist())]
            firsts = np.searchsorted(np.array(row_of)[part_of], np.arange(b - a + 1)) if len(starts) else np.zeros(b - a + 1, int)
            yield a, b, words, index, firsts

    def word_ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words, kept from call to call within ``KEEP_WORDS``."""
        cache = self.cache
        new = sorted(b for w in words if not isinstance(w, SpecialWord)
                     and (b := w.encode("utf-8", "replace")) not in cache)
        if len(cache) + len(new) > KEEP_WORDS:
            cache.clear()
            new = sorted({w.encode("utf-8", "replace") for w in words if not isinstance(w, SpecialWord)})
        cache.update(zip(new, self.encode_words(new)))
        return [(self.special[str(w)],) if isinstance(w, SpecialWord) else cache[w.encode("utf-8", "replace")] for w in words]


class SpecialWord(str):
    """A special token's text in a list of words."""


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path, loaded once per Python worker."""
    return Vocabulary(path)


def flatten(ids: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes


def gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the ids of all distinct words of a chunk, one after another, and their counts: the
    ids of all words in order, and where each word's ids begin (and the end)."""
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    each = sizes[index]
    ends = np.concatenate(([0], np.cumsum(each)))
    return flat[np.repeat(at[index] - ends[:-1], each) + np.arange(ends[-1])], ends


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = S.clean(batch["text"])
            for a, b, words, index, firsts in vocab.encode_batch(texts):
                chunk, ends = gather(*flatten(vocab.word_ids(words)), index)
                own = [chunk[ends[lo]:ends[hi]].astype(np.int32) for lo, hi in zip(firsts[:-1], firsts[1:])]
                plain = [b"".join(map(vocab.bytes.__getitem__, x.tolist())).decode("utf-8", "replace") for x in own]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(),
                                    "ids": own, "decoded": plain})
    return run


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """One row per document: its ids, and the text that they decode to."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        _encode(vocab_path), "doc_id long, ids array<int>, decoded string")


def encode_texts(texts: list[str], vocab_path: str) -> list[list[int]]:
    """Ids of a list of texts (the operator without Spark, for small uses and tests)."""
    vocab, out = vocabulary(vocab_path), []
    for _, _, words, index, firsts in vocab.encode_batch(texts):
        ids = vocab.word_ids(words)
        chunk, ends = gather(*flatten(ids), index)
        out += [chunk[ends[lo]:ends[hi]].tolist() for lo, hi in zip(firsts[:-1], firsts[1:])]
    return out


def decode_ids(ids: list[int], vocab_path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    vocab = vocabulary(vocab_path)
    return b"".join(vocab.bytes[i] for i in ids).decode("utf-8", "replace")
