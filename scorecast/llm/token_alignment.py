"""Operator 12: alignment of two tokenizers by sparse incidence products.

A text's tokens under tokenizer A are the rows of a sparse matrix whose columns are the
text's bytes, and so are its tokens under B. The row products A . B^T (Gustavson's method on
hand-built CSR arrays: each row gathers the rows of the other matrix that its entries name)
are the links of tokens that overlap, with the number of bytes they share. Overlapping tokens
whose ranges end together cut the bytes into groups; the incidence of tokens and groups, in
a second product, gives the links of tokens that share a group.

A text is cut into words, from a run of blanks behind a sign to the next. Both tokenizers
treat such words apart: A by its pre-tokenisation rule, B because no piece has a blank behind
another sign (checked when the model is loaded; else whole texts are encoded). So both end a
token at every word's end, and the distinct words of a chunk are encoded and multiplied once;
a text's links and groups are those of its words, one after another. How often an id pair
ends together is counted over the corpus: blocks of texts count their distinct pairs, Spark
adds them up and sends each block the counts of its own pairs. The table of pairs is bounded
by the vocabularies.

Edge cases: null and empty texts, and texts that a tokenizer does not give back byte for byte
(U+2581 in the text, for example), have no tokens: zeros and an empty digest; special tokens'
strings are plain text; repeated rows count each; a null ``doc_id`` stays null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import blocks, bpe
from scorecast.llm import spans as S
from scorecast.llm.backoff_lm import pack, unpack
from scorecast.llm.scratch import released_shuffles, shuffle_partitions, written

#: Code points whose distinct words are aligned together, and whose links are counted together
#: before they leave a task.
CHUNK, BLOCK_POINTS = 1_500_000, 4_000_000
BLANK = "▁"
# A's pre-tokenisation rule, which the library applies to short ASCII words; other
# words are split by ``bpe`` (classes of every code point, no backtracking over long runs).
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LONG_WORD = 1000
_LOW = (1 << 32) - 1


# ---- sparse matrices ----------------------------------------------------------------------

@dataclass
class CSR:
    """Rows of (column, value); a row's columns ascend."""

    starts: np.ndarray   # of each row in ``columns``, and the end
    columns: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> CSR:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return CSR(starts, self.rows()[order], self.values[order], len(self.starts) - 1)


def incidence(ends: np.ndarray) -> CSR:
    """Tokens by the bytes of their ranges; the ranges follow one another up to their ``ends``."""
    n = int(ends[-1]) if len(ends) else 0
    return CSR(np.concatenate(([0], ends)), np.arange(n), np.ones(n, dtype=np.int32), n)


def membership(group: np.ndarray, groups: int) -> CSR:
    """Tokens by the group that each belongs to."""
    return CSR(np.arange(len(group) + 1), group, np.ones(len(group), dtype=np.int32), groups)


def row_products(left: CSR, right: CSR) -> CSR:
    """left . right: each row of ``left`` adds up the rows of ``right`` that its columns name."""
    sizes = np.diff(right.starts)[left.columns]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(right.starts[left.columns] - (ends - sizes), sizes)
    keys = np.repeat(left.rows(), sizes) * right.width + right.columns[at]
    values = np.repeat(left.values, sizes) * right.values[at]
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    row, column = np.divmod(keys[first], max(1, right.width))
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(left.starts) - 1)))).astype(np.int64)
    return CSR(starts, column, np.add.reduceat(values, first) if len(first) else values, right.width)


class Alignment:
    """The tokens of texts one after another, which both tokenizers cover byte for byte."""

    def __init__(self, a_ids: np.ndarray, a_sizes: np.ndarray, b_ids: np.ndarray, b_sizes: np.ndarray):
        self.a_ids, self.b_ids = a_ids, b_ids
        self.a_ends, self.b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        self.overlap = row_products(incidence(self.a_ends), incidence(self.b_ends).transposed())
        row = self.overlap.rows()
        together = self.a_ends[row] == self.b_ends[self.overlap.columns]
        #: Links of tokens that end together, as places of A's and of B's tokens.
        self.a_link, self.b_link = row[together], self.overlap.columns[together]
        #: Byte offsets behind each group, and the group of each token.
        self.cuts = self.a_ends[self.a_link]
        self.a_group, self.b_group = np.searchsorted(self.cuts, self.a_ends), np.searchsorted(self.cuts, self.b_ends)

    def group_links(self) -> CSR:
        """Links of all tokens that share a group."""
        n = len(self.cuts)
        return row_products(membership(self.a_group, n), membership(self.b_group, n).transposed())

    def pairs(self) -> np.ndarray:
        """The id pair of each link of tokens that end together."""
        return self.a_ids[self.a_link].astype(np.int64) << 32 | self.b_ids[self.b_link].astype(np.int64)


# ---- encoding -------------------------------------------------------------------------------

class Tokenizer:
    """Ids of words, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], token_bytes: list[bytes]):
        self.encode, self.bytes = encode, token_bytes
        self.sizes = np.array([len(b) for b in token_bytes], dtype=np.int64)

    def coded(self, words: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after another, each word's number of ids, and which words (``raw``
        in bytes) are not given back byte for byte."""
        ids = self.encode(words)
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        ends = np.cumsum(counts)
        covered = np.concatenate(([0], np.cumsum(self.sizes[flat])))
        lost = covered[ends] - covered[ends - counts] != np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        table = self.bytes.__getitem__
        if lost.any() or b"".join(map(table, flat.tolist())) != b"".join(raw):
            lost = np.array([b"".join(map(table, np.frombuffer(i, dtype=np.uint32).tolist())) != r for i, r in zip(ids, raw)], dtype=bool)
        return flat, counts, lost


class WordBook:
    """Ids of both tokenizers for the words that the running task has seen, up to a number of them."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.sides = (a, b)
        self.forget()

    def forget(self) -> None:
        self.places: dict[int, int] = {}
        self.flat = [np.zeros(0, np.uint32)] * 2
        self.counts = [np.zeros(0, np.int64)] * 2
        self.lost = np.zeros(0, dtype=bool)

    def places_of(self, hashes: list[int], word: Callable[[int], str]) -> np.ndarray:
        """Places of distinct words in the book; ``word`` gives the text of one of them."""
        new = [k for k, h in enumerate(hashes) if h not in self.places]
        if len(self.places) + len(new) > bpe.KEEP_WORDS:
            self.forget()
            new = list(range(len(hashes)))
        if new:
            words = [word(k) for k in new]
            raw = [w.encode() for w in words]
            lost = np.zeros(len(new), dtype=bool)
            for i, side in enumerate(self.sides):
                flat, counts, bad = side.coded(words, raw)
                self.flat[i], self.counts[i] = np.concatenate((self.flat[i], flat)), np.concatenate((self.counts[i], counts))
                lost |= bad
            self.places.update(zip((hashes[k] for k in new), range(len(self.lost), len(self.lost) + len(new))))
            self.lost = np.concatenate((self.lost, lost))
        return np.fromiter(map(self.places.__getitem__, hashes), dtype=np.int64, count=len(hashes))


@lru_cache(maxsize=2)
def _byte_tokenizer(path: str) -> Tokenizer:
    import tiktoken

    vocab = bpe.Vocabulary(path)
    vocab.special = {}  # special tokens' strings are plain text
    one, every_word = (tiktoken.Encoding("words", pat_str=p, mergeable_ranks=vocab.ids, special_tokens={}).encode_ordinary
                       for p in (r"[\s\S]+", ASCII_WORDS))

    def encode(words: list[str]) -> list[bytes]:
        plain = [w.isascii() and len(w) <= LONG_WORD for w in words]
        rest = iter(split([w for w, p in zip(words, plain) if not p]))
        return [array("I", every_word(w)).tobytes() if p else next(rest) for w, p in zip(words, plain)]

    def split(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, _, parts, index, firsts in vocab.encode_batch(words):
            ids = [array("I", one(w)).tobytes() for w in parts]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            flat, ends = bpe.gather(np.frombuffer(b"".join(ids), dtype=np.uint32), sizes, index)
            every, cuts = flat.tobytes(), (4 * ends[firsts]).tolist()
            out += [every[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        return out
    return Tokenizer(encode, [vocab.bytes.get(i, b"") for i in range(max(vocab.bytes) + 1)])


@lru_cache(maxsize=2)
def _piece_tokenizer(path: str) -> tuple[Tokenizer, bool]:
    """The tokenizer, and whether words from a run of blanks to the next can be encoded apart."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    apart = not any(BLANK in p.lstrip(BLANK) for p in pieces)
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]

    def encode(words: list[str]) -> list[bytes]:
        # The model puts a blank before what it encodes, unless that is empty; the words begin with theirs.
        alone = array("I", [model.piece_to_id(BLANK)]).tobytes()
        return [array("I", i).tobytes() if w != " " else alone
                for w, i in zip(words, model.encode([w[1:] for w in words], num_threads=1))] if words else []
    return Tokenizer(encode, table), apart


@lru_cache(maxsize=2)
def _word_book(a_path: str, b_path: str) -> WordBook:
    return WordBook(_byte_tokenizer(a_path), _piece_tokenizer(b_path)[0])


def _blank_words(texts: list[str], apart: bool) -> tuple[list[int], Callable[[int], str], np.ndarray, np.ndarray]:
    """Distinct words (hashes, and a function that gives a word's text) of texts that begin with
    a blank, each word's place among them, and each text's first word (and the end)."""
    points, bounds = S.join_points(texts)
    text = "".join(texts)
    begins = np.zeros(len(points), dtype=bool)
    if apart and len(points):
        # Behind other white space a blank is in the middle of A's word.
        begins[1:] = (points[1:] == 32) & ~(bpe._classes()[points[:-1]] == bpe._SPACE)
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    hashes = S.span_hashes(S.symbol_table(False)[points], starts, ends)
    distinct, where, index = np.unique(hashes, return_index=True, return_inverse=True)
    starts_of, ends_of = starts[where].tolist(), ends[where].tolist()
    return distinct.tolist(), lambda k: text[starts_of[k]:ends_of[k]], index, np.searchsorted(starts, bounds)


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a batch: the alignment of their distinct words, where each
    word's tokens begin under A and B (and the ends), the texts' words by place among them, and
    each text's first word (and the end). Texts that are not given back have no words."""

    first: int
    last: int
    words: Alignment
    a_begin: np.ndarray
    b_begin: np.ndarray
    index: np.ndarray
    firsts: np.ndarray

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        """Sums of a word's figure over each text's words."""
        sums = np.concatenate(([0], np.cumsum(of_word[self.index])))[self.firsts]
        return np.diff(sums)

    def links_of_words(self) -> np.ndarray:
        """The word in which each link of tokens that end together lies."""
        return np.searchsorted(self.a_begin, self.words.a_link, side="right") - 1


def aligned_chunks(texts: list[str], a_path: str, b_path: str) -> Iterator[Chunk]:
    """The texts' alignments, in chunks of rows."""
    a_side, (b_side, apart) = _byte_tokenizer(a_path), _piece_tokenizer(b_path)
    book = _word_book(a_path, b_path)
    full = [" " + t if t else "" for t in texts]
    for first, last in S.chunks(full, CHUNK):
        hashes, word, index, firsts = _blank_words(full[first:last], apart)
        places = book.places_of(hashes, word)
        lost = book.lost[places]
        a_ids, a_begin = bpe.gather(book.flat[0], book.counts[0], places)
        b_ids, b_begin = bpe.gather(book.flat[1], book.counts[1], places)
        if lost.any():
            good = np.ones(last - first, dtype=bool)
            good[np.searchsorted(firsts, np.flatnonzero(lost[index]), side="right") - 1] = False
            sizes = np.diff(firsts)
            index, firsts = index[np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))
            # The words lost cover other bytes under A and B, so they stay out of the product.
            a_ids, b_ids = a_ids[np.repeat(~lost, np.diff(a_begin))], b_ids[np.repeat(~lost, np.diff(b_begin))]
            a_begin, b_begin = (np.concatenate(([0], np.cumsum(np.where(lost, 0, np.diff(x))))) for x in (a_begin, b_begin))
        yield Chunk(first, last, Alignment(a_ids, a_side.sizes[a_ids], b_ids, b_side.sizes[b_ids]), a_begin, b_begin, index, firsts)


@lru_cache(maxsize=2)
def _decimals(a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in decimals with the sign after them, eight bytes each, and their lengths: A inside
    a group, A at its side's end, B inside, B at the group's end."""
    parts = [b"%d%c" % (i, sign) for size, signs in ((a_size, b",|"), (b_size, b",;")) for sign in signs for i in range(size)]
    if max(map(len, parts)) > 8:
        raise ValueError("ids of more than seven digits")
    return (np.frombuffer(b"".join(p.ljust(8, b"\0") for p in parts), dtype="<u8"),
            np.array([len(p) for p in parts], dtype=np.int64))


def group_texts(x: Alignment, a_begin: np.ndarray, b_begin: np.ndarray, a_size: int, b_size: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of each word: decimal ids of A and B in order, by group."""
    table, lengths = _decimals(a_size, b_size)
    n = len(x.cuts)
    a_in, b_in = np.bincount(x.a_group, minlength=n), np.bincount(x.b_group, minlength=n)
    a_through, b_through = np.cumsum(a_in), np.cumsum(b_in)
    entries = np.empty(len(x.a_ids) + len(x.b_ids), dtype=np.int64)
    a_last, b_last = np.zeros(len(x.a_ids), bool), np.zeros(len(x.b_ids), bool)
    a_last[a_through - 1], b_last[b_through - 1] = True, True
    entries[np.arange(len(x.a_ids)) + (b_through - b_in)[x.a_group]] = x.a_ids + a_last * np.int64(a_size)
    entries[np.arange(len(x.b_ids)) + a_through[x.b_group]] = x.b_ids + np.int64(2 * a_size) + b_last * np.int64(b_size)
    padded = table[entries].view(np.uint8)
    text = padded[padded != 0].tobytes()
    cuts = np.concatenate(([0], np.cumsum(lengths[entries])))[a_begin + b_begin].tolist()
    return [text[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


# ---- DataFrame operators ------------------------------------------------------------------------

ALIGNED = ("doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, "
           "a_group array<int>, b_group array<int>, overlap array<struct<a:int,b:int,bytes:int>>, "
           "shared_group array<struct<a:int,b:int>>")


def _ids(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(d) else int(d) for d in column]


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's tokens under A and B with the ends of their byte ranges (in blank +
    text), their groups, and the links by places: of overlapping tokens with the bytes that
    they share, and of tokens that share a group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = _byte_tokenizer(a_path), _piece_tokenizer(b_path)[0]
        for batch in batches:
            texts = S.clean(batch["text"])
            docs = _ids(batch["doc_id"])
            for c in aligned_chunks(texts, a_path, b_path):
                a_flat, a_ends = bpe.gather(c.words.a_ids, np.diff(c.a_begin), c.index)
                b_flat, b_ends = bpe.gather(c.words.b_ids, np.diff(c.b_begin), c.index)
                for k, (i, j) in enumerate(zip(c.firsts[:-1], c.firsts[1:])):
                    a, b = a_flat[a_ends[i]:a_ends[j]], b_flat[b_ends[i]:b_ends[j]]
                    x = Alignment(a, a_side.sizes[a], b, b_side.sizes[b])
                    links, shared = x.overlap, x.group_links()
                    yield pd.DataFrame({
                        "doc_id": pd.array([docs[c.first + k]], dtype="Int64"), "a_ids": [a.astype(np.int32)], "a_ends": [x.a_ends],
                        "b_ids": [b.astype(np.int32)], "b_ends": [x.b_ends], "a_group": [x.a_group], "b_group": [x.b_group],
                        "overlap": [[{"a": a, "b": b, "bytes": v} for a, b, v in zip(links.rows(), links.columns, links.values)]],
                        "shared_group": [[{"a": a, "b": b} for a, b in zip(shared.rows(), shared.columns)]]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, ALIGNED)


BLOCK = ("block long, pairs array<long>, times array<long>, word_links binary, link_pairs binary, index binary, n_words binary, "
         "n_a binary, n_b binary, n_groups binary, n_links binary, digests string, docs binary, nulls binary")
#: Counts of a row kept as 64-bit integers.
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _digest(texts: list[bytes]) -> str:
    """Of the groups' text without the sign behind the last one."""
    return hashlib.sha256(b"".join(texts)[:-1]).hexdigest() if texts else ""


def _summary(c: Chunk, docs: list, a_size: int, b_size: int) -> dict:
    x, word = c.words, c.links_of_words()
    n = len(c.a_begin) - 1
    texts = group_texts(x, c.a_begin, c.b_begin, a_size, b_size)
    ordered, firsts = [texts[i] for i in c.index.tolist()], c.firsts.tolist()
    links = np.bincount(word, minlength=n)
    groups = np.bincount(np.searchsorted(c.a_begin, np.searchsorted(x.a_group, np.arange(len(x.cuts))), side="right") - 1, minlength=n)
    return {"docs": docs[c.first:c.last], "pairs": x.pairs(), "times": np.bincount(c.index, minlength=n)[word], "word_links": links,
            "index": c.index, "n_words": np.diff(c.firsts), "n_a": c.per_text(np.diff(c.a_begin)), "n_b": c.per_text(np.diff(c.b_begin)),
            "n_groups": c.per_text(groups), "n_links": c.per_text(links),
            "digests": [_digest(ordered[i:j]) for i, j in zip(firsts[:-1], firsts[1:])]}


def _block(number: int, parts: list[dict]) -> pd.DataFrame:
    every, link_pairs = np.unique(np.concatenate([p["pairs"] for p in parts]), return_inverse=True)
    times = np.bincount(link_pairs, weights=np.concatenate([p["times"] for p in parts]), minlength=len(every))
    joined = {c: np.concatenate([p[c] for p in parts]).astype(np.int64).tobytes() for c in (*_COUNTS, "n_words")}
    docs = [d for p in parts for d in p["docs"]]
    # Chunks have words of their own: numbered on from chunk to chunk.
    before = np.cumsum([0, *(len(p["word_links"]) for p in parts)])
    return pd.DataFrame([{
        "block": (TaskContext.get().partitionId() << 32) + number, "pairs": every, "times": times.astype(np.int64),
        "word_links": pack(np.concatenate([p["word_links"] for p in parts]).astype(np.uint32)),
        "link_pairs": pack(link_pairs.astype(np.uint32)),
        "index": pack(np.concatenate([p["index"] + b for p, b in zip(parts, before)]).astype(np.uint32)),
        **joined, "digests": ",".join(d for p in parts for d in p["digests"]),
        "docs": np.array([d or 0 for d in docs], dtype=np.int64).tobytes(),
        "nulls": np.array([d is None for d in docs], dtype=bool).tobytes()}])


def _to_blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = _byte_tokenizer(a_path), _piece_tokenizer(b_path)[0]
        number, size, parts = 0, 0, []
        for batch in batches:
            docs, texts = _ids(batch["doc_id"]), S.clean(batch["text"])
            for c in aligned_chunks(texts, a_path, b_path):
                parts.append(_summary(c, docs, len(a_side.bytes), len(b_side.bytes)))
                size += sum(map(len, texts[c.first:c.last])) + c.last - c.first
                if size >= BLOCK_POINTS:
                    yield _block(number, parts)
                    number, size, parts = number + 1, 0, []
        if parts:
            yield _block(number, parts)
        _word_book(a_path, b_path).forget()  # the worker lives on; its next task has its own words
    return run


def alignment_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a block of documents: its distinct id pairs that end together with their
    number of links, its words' links as places among them, the documents' words, and each
    document's counts and group digest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_to_blocks(a_path, b_path), BLOCK)


def _exploded(aligned: DataFrame) -> DataFrame:
    return (aligned.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, pair, links, best): how many links of the corpus hold each id pair, and
    whether none of the B id's pairs has more. At most one row for each pair of vocabulary ids."""
    counts = (_exploded(aligned).groupBy("pair").agg(F.sum("times").alias("links"))
              .withColumn("b_id", F.col("pair").bitwiseAND(F.lit(_LOW))))
    most = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(most, "b_id").select(F.shiftright("pair", 32).alias("a_id"), "b_id", "pair", "links",
                                            (F.col("links") == F.col("most")).alias("best"))


STATISTICS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in blocks.segments(batches, ["block"]):
        for first, last in blocks.groups(part, ["block"]):
            head = part.iloc[first]
            count = {c: np.frombuffer(head[c], dtype=np.int64) for c in _COUNTS}
            answers = part.iloc[first + 1:last]
            pair, per_word = unpack(head["link_pairs"]), unpack(head["word_links"]).astype(np.int64)
            index, n_words = unpack(head["index"]), np.frombuffer(head["n_words"], dtype=np.int64)
            out = {}
            for name, of_pair in (("n_best", answers["best"]), ("count_sum", answers["links_of_pair"])):
                # Whole numbers, so sums of differences are exact.
                sums = np.concatenate(([0], np.cumsum(of_pair.to_numpy().astype(np.int64)[pair])))
                ends = np.cumsum(per_word)
                of_word = sums[ends] - sums[ends - per_word]
                sums = np.concatenate(([0], np.cumsum(of_word[index])))
                ends = np.cumsum(n_words)
                out[name] = sums[ends] - sums[ends - n_words]
            ids = pd.array(np.frombuffer(head["docs"], dtype=np.int64), dtype="Int64")
            ids[np.frombuffer(head["nulls"], dtype=bool)] = pd.NA
            yield pd.DataFrame({"doc_id": ids, **count, **out, "groups_sha256": head["digests"].split(",")})


def alignment_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: tokens, groups, links that end together, those that are their B id's most
    frequent in the corpus, the sum of the links' corpus counts, and the groups' digest."""
    spark = docs.sparkSession
    with released_shuffles(spark):
        aligned = written(alignment_blocks(docs, a_path, b_path), "aligned-blocks")
        counts = written(pair_counts(aligned), "pair-counts")
    answers = (_exploded(aligned).join(counts, "pair")
               .select("block", "pair", F.col("links").alias("links_of_pair"), "best"))
    heads = aligned.select("block", F.lit(-1).cast("long").alias("pair"), F.lit(0).cast("long").alias("links_of_pair"),
                           F.lit(False).alias("best"), "word_links", "link_pairs", "index", "n_words", *_COUNTS, "digests",
                           "docs", "nulls")
    parts = heads.unionByName(answers, allowMissingColumns=True)
    tasks = max(shuffle_partitions(spark), aligned.count() // 4)
    return (parts.repartition(tasks, "block").sortWithinPartitions("block", "pair").mapInPandas(_statistics, STATISTICS))
