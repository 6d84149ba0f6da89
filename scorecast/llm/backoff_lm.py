"""Operator 11: language-model scores by a weighted backoff automaton.

Words (and one end a document) are counted up to three in a row over the training documents.
The n-grams are the arcs of an automaton: a state is the longest context that was seen, an
arc carries the smoothed log-probability of its word there, and a failure arc leads to the
state of the context without its first word and carries the log of the weight that smoothing
leaves for unseen words. One left-to-right traversal of a text carries the state and adds up
the weights.

Smoothing interpolates each order with the one below. The lower order's share is a function
of the context's count alone, so the probabilities of all words and of the one unknown word
sum to one in every state::

    p(w | h) = (1 - b(h)) * count(h, w) / count(h) + b(h) * p(w | h'),   b(h) = 1 / (1 + (count(h) / k) ** POWER)
    p(w)     = (count(w) + 0.1) / (N + 0.1 * (V + 1))

The model is never in one place. Documents are cut into blocks of about ``BLOCK_TOKENS``
tokens. A block asks for the counts of its own distinct n-grams (64-bit hashes, sorted, one
binary slice for each shard of the hash space) and brings its own training counts along; a
shard adds up and answers every block; a block then builds the part of the automaton that
its texts can reach and traverses them. Words and pairs are asked for first; the answer also
says which of them no other block has, and a triple with such a pair need not be asked for,
because the block's own count is the corpus's. A frequent n-gram is one entry a block, so
shards are even whatever the words; a shard holds about ``SHARD_KEYS`` entries at any size.

Edge cases: null texts are empty, and an empty text is its end alone; a null ``doc_id`` is
held out and stays null; rows that repeat an id are texts of their own; a word of any length
is one token; without training tokens every token has probability one of the unknown word;
an empty table gives no rows; other columns are not read. Words are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import spans as S
from scorecast.llm.scratch import released_shuffles, shuffle_partitions, written

#: Documents whose id's crc32 is divisible by this are not learned from.
FOLDS = 10
#: Tokens of a block (a longer document is a block of its own) and entries of a shard, about.
BLOCK_TOKENS, SHARD_KEYS = 400_000, 3_000_000
#: Context counts at which half of the weight goes to the next lower order, for one and two words.
HALF_ONE, HALF_TWO, POWER = 1000.0, 10.0, 0.35
ADDED = 0.1

_U = np.uint64
END, BEGIN = _U(0x656E64), _U(0x626567696E)  # not in the range of mixed word hashes but by chance
BLOCK_SCHEMA = ("block long, n_tokens long, n_train long, train_docs long, words binary, ids binary, "
                "sizes binary, held binary, docs binary, nulls binary")
REQUEST_SCHEMA = "shard int, block long, keys binary, counts binary"
ANSWER_SCHEMA = "block long, shard int, counts binary, shared binary, known long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that small ones take little room."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)
    return pack(counts.astype(kind))


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def token_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of each text's words and its end."""
    for a, b in S.chunks(texts):
        points, bounds = S.join_points(texts[a:b])
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        starts, ends = S.runs(~blank, bounds)
        hashes = S.mix64(S.span_hashes(S.symbol_table(True)[points], starts, ends))
        cuts = np.searchsorted(starts, bounds)
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield np.append(hashes[i:j], END)


def _block_row(number: int, docs: list, held: list, sizes: list, hashes: list) -> dict:
    tokens = np.concatenate(hashes)
    words, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    # Frequent words first: their numbers are small and take less room.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    held, sizes = np.array(held, dtype=bool), np.array(sizes, dtype=np.int64)
    return {"block": (TaskContext.get().partitionId() << 32) + number, "n_tokens": len(tokens),
            "n_train": int(sizes[~held].sum()), "train_docs": int((~held).sum()), "words": words[order].tobytes(),
            "ids": pack(place[ids]), "sizes": sizes.tobytes(), "held": held.tobytes(),
            "docs": np.array([d or 0 for d in docs], dtype=np.int64).tobytes(),
            "nulls": np.array([d is None for d in docs], dtype=bool).tobytes()}


def _to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number, size, docs, held, sizes, hashes = 0, 0, [], [], [], []
    for batch in batches:
        ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
        for doc, out, tokens in zip(ids, batch["held"].tolist(), token_hashes(S.clean(batch["text"]))):
            docs.append(doc), held.append(out), sizes.append(len(tokens)), hashes.append(tokens)
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield pd.DataFrame([_block_row(number, docs, held, sizes, hashes)])
                number, size, docs, held, sizes, hashes = number + 1, 0, [], [], [], []
    if docs:
        yield pd.DataFrame([_block_row(number, docs, held, sizes, hashes)])


def token_blocks(docs: DataFrame) -> DataFrame:
    """The documents as blocks of numbered tokens, one row a block."""
    out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held"))
    return rows.mapInPandas(_to_blocks, BLOCK_SCHEMA)


class Block:
    """A block's distinct n-grams: words, pairs and triples, each with the numbers of its parts.

    A pair starts with a word or, at a document's start, with ``begin`` (the number after the
    last word); a triple is a pair and the word after it.
    """

    def __init__(self, row):
        self.words = np.frombuffer(row["words"], dtype=np.uint64)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        held = np.frombuffer(row["held"], dtype=bool)
        self.ids = unpack(row["ids"]).astype(np.int64)
        self.learned = np.repeat(~held, self.sizes).astype(np.float64)
        self.begin, n = len(self.words), len(self.ids)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty(n, dtype=np.int64)
        before[1:] = self.ids[:-1]
        before[self.starts] = self.begin
        self.before = before
        pairs, self.pair_of = np.unique(before * (self.begin + 1) + self.ids, return_inverse=True)
        self.left, self.right = np.divmod(pairs, self.begin + 1)

    def find_triples(self) -> None:
        inner = np.ones(len(self.ids), dtype=bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        triples, self.triple_of = np.unique(self.pair_of[self.inner - 1] * (self.begin + 1) + self.ids[self.inner],
                                            return_inverse=True)
        self.pair, self.last = np.divmod(triples, self.begin + 1)
        # The pair that each triple ends with: that of any place where the triple stands.
        self.ending = np.empty(len(triples), dtype=np.int64)
        self.ending[self.triple_of] = self.pair_of[self.inner]

    def _pair_hashes(self) -> np.ndarray:
        hashed = np.append(self.words, BEGIN)
        return S.mix64(S.mix64(hashed[self.left]) + hashed[self.right])

    def short_keys(self) -> np.ndarray:
        """Keys of words and pairs: hashes with the kind in the two lowest bits."""
        return np.concatenate(((S.mix64(self.words) & ~_U(3)) | _U(1), (self._pair_hashes() & ~_U(3)) | _U(2)))

    def short_counts(self) -> np.ndarray:
        """Occurrences of words and pairs in the block's training documents."""
        return np.concatenate([np.bincount(x, weights=self.learned, minlength=n) for x, n in (
            (self.ids, len(self.words)), (self.pair_of, len(self.left)))]).astype(np.int64)

    def triple_keys(self, some: np.ndarray) -> np.ndarray:
        return (S.mix64(S.mix64(self._pair_hashes()[self.pair[some]]) + self.words[self.last[some]]) & ~_U(3)) | _U(3)

    def triple_counts(self) -> np.ndarray:
        return np.bincount(self.triple_of, weights=self.learned[self.inner], minlength=len(self.pair)).astype(np.int64)


def _slices(keys: np.ndarray, counts: np.ndarray, block: int, bits: int) -> pd.DataFrame:
    """A block's requests: keys in order, cut by shard (their highest bits)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    shard = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    shards, firsts = np.unique(shard, return_index=True)
    cuts = list(zip(firsts, [*firsts[1:], len(keys)]))
    return pd.DataFrame({"shard": shards.astype(np.int32), "block": np.full(len(shards), block),
                         "keys": [pack_sorted(keys[a:b]) for a, b in cuts], "counts": [pack_counts(counts[a:b]) for a, b in cuts]})


def _answered(keys: np.ndarray, answers: list[dict], column: str) -> np.ndarray:
    """What the shards answered, in the order of ``keys`` as they were asked for."""
    out = np.empty(len(keys), dtype=np.int64)
    if len(keys):
        out[np.argsort(keys, kind="stable")] = np.concatenate([unpack(r[column]) for r in answers])
    return out


def _short_requests(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row)
                yield _slices(block.short_keys(), block.short_counts(), row["block"], bits)
    return run


def _asked_triples(block: Block, shared: np.ndarray) -> np.ndarray:
    """Triples whose pairs are both in other blocks too; the others are in this block alone."""
    pairs = shared[len(block.words):].astype(bool)
    return np.flatnonzero(pairs[block.pair] & pairs[block.ending])


def _triple_requests(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (head, *answers) in _runs_of(batches, "block"):
            block = Block(head)
            shared = _answered(block.short_keys(), answers, "shared")
            block.find_triples()
            asked = _asked_triples(block, shared)
            yield _slices(block.triple_keys(asked), block.triple_counts()[asked], head["block"], bits)
    return run


def _runs_of(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal ``key``, which come one after another."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_dict("records"):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corpus-wide training counts of each block's slice of a shard, and which keys several
    blocks have."""
    for shard, rows in _runs_of(batches, "shard"):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        cuts = np.cumsum([0, *map(len, keys)])
        every, place, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        total = np.bincount(place, weights=np.concatenate([unpack(r["counts"]) for r in rows])).astype(np.int64)
        shared = (blocks > 1).astype(np.uint8)
        known = np.zeros(len(rows), dtype=np.int64)
        known[0] = int(((every & _U(3) == _U(1)) & (total > 0)).sum())
        yield pd.DataFrame({"block": [r["block"] for r in rows], "shard": np.full(len(rows), shard, dtype=np.int32),
                            "counts": [pack_counts(total[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])],
                            "shared": [pack(shared[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], "known": known})


def lower_share(count: np.ndarray, half: float) -> np.ndarray:
    """The weight that a context seen ``count`` times leaves to the next lower order."""
    return 1.0 / (1.0 + (count / half) ** POWER)


class Automaton:
    """The part of the model that a block's texts can reach.

    State 0 is the empty context; state i + 1 is word i, then comes a document's begin, then
    the pairs. Only what was seen in training is a state or an arc. An arc is an n-gram: a
    triple leaves the state of its pair, a pair that of its word, a word the empty context.
    ``failure`` is the state that takes over, at the price of ``backoff``, where a state has no
    arc for the next word.
    """

    def __init__(self, block: Block, one: np.ndarray, two: np.ndarray, three: np.ndarray, tokens: int, known: int, documents: int):
        n = len(block.words)
        self.block, self.one, self.two, self.three = block, one, two, three
        context = np.append(one, documents)
        p1 = (one + ADDED) / (tokens + ADDED * (known + 1))
        share1, share2 = lower_share(context, HALF_ONE), lower_share(two, HALF_TWO)
        p2 = (1 - share1[block.left]) * two / np.maximum(context[block.left], 1) + share1[block.left] * p1[block.right]
        p3 = (1 - share2[block.pair]) * three / np.maximum(two[block.pair], 1) + share2[block.pair] * p2[block.ending]
        self.weights = [np.log10(p) for p in (p1, p2, p3)]
        self.pairs_from, self.begin = n + 2, n + 1 if documents else 0
        self.failure = np.concatenate(([0], np.zeros(n + 1, dtype=np.int64), block.right + 1))
        self.backoff = np.concatenate(([0.0], np.log10(share1), np.log10(share2)))

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every text, and of its words alone.

        Left to right, a token is read in the state that the token before it led to: the state
        of the pair, word or nothing that its arc ended with. All texts of the block are read
        at once, so the carried states are an array; tokens without an arc go on to the failure
        state, three times at most."""
        block = self.block
        seen = self.two[block.pair_of] > 0
        led_to = np.where(seen, self.pairs_from + block.pair_of, np.where(self.one[block.ids] > 0, block.ids + 1, 0))
        state = np.empty_like(led_to)
        state[1:] = led_to[:-1]
        state[block.starts] = self.begin
        # The arc of each token for a context of one word and of two: a number, or none.
        pair_arc = np.where(seen, block.pair_of, -1)
        triple_arc = np.full(len(state), -1)
        triple_arc[block.inner] = np.where(self.three[block.triple_of] > 0, block.triple_of, -1)
        gained = np.zeros(len(state))
        for arc, weight, least in ((triple_arc, self.weights[2], self.pairs_from), (pair_arc, self.weights[1], 1)):
            here = state >= least
            found = here & (arc >= 0)
            gained[found] += weight[arc[found]]
            missed = here & (arc < 0)
            gained[missed] += self.backoff[state[missed]]
            state[missed] = self.failure[state[missed]]
            state[found] = -1  # read
        plain = self.weights[0][block.ids]
        rest = state == 0
        gained[rest] += plain[rest]
        return np.add.reduceat(gained, block.starts), np.add.reduceat(plain, block.starts)


def _score(tokens: int, known: int, documents: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (head, *answers) in _runs_of(batches, "block"):
            block = Block(head)
            short, n = block.short_keys(), len(block.words)
            first, second = ([r for r in answers if r["stage"] == k] for k in (1, 2))
            counts = _answered(short, first, "counts")
            block.find_triples()
            three = block.triple_counts()
            asked = _asked_triples(block, _answered(short, first, "shared"))
            three[asked] = _answered(block.triple_keys(asked), second, "counts")
            score, base = Automaton(block, counts[:n], counts[n:], three, tokens, known, documents).traverse()
            ids = pd.array(np.frombuffer(head["docs"], dtype=np.int64), dtype="Int64")
            ids[np.frombuffer(head["nulls"], dtype=bool)] = pd.NA
            yield pd.DataFrame({
                "doc_id": ids, "held_out": np.frombuffer(head["held"], dtype=bool), "n_tokens": block.sizes,
                "n_known": np.add.reduceat((counts[:n] > 0)[block.ids].astype(np.int64), block.starts),
                "base_score": base, "score": score})
    return run


_HEAD = ["words", "ids", "sizes", "held"]


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document:
    log10 probabilities under the words alone and under the automaton, both learned from the
    documents that are not held out."""
    spark = docs.sparkSession
    with released_shuffles(spark):
        blocks = written(token_blocks(docs), "lm-blocks")
        # Four numbers, whatever the corpus.
        size = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "train_docs")],
                          F.count(F.lit(1)).alias("blocks")).first()
        bits = max(0, math.ceil(math.log2(max(1, 2 * size["n_tokens"] / SHARD_KEYS))))
        tasks = max(shuffle_partitions(spark), size["blocks"] // 4, (1 << bits) // 4)

        def answered(requests: DataFrame, name: str) -> DataFrame:
            return written(requests.repartition(tasks, "shard").sortWithinPartitions("shard", "block")
                           .mapInPandas(_answers, ANSWER_SCHEMA), name)

        def by_block(*columns: str) -> DataFrame:
            """Blocks, each before the answers to it."""
            parts = blocks.select("block", F.lit(0).alias("stage"), F.lit(0).alias("shard"), *_HEAD, *columns)
            for stage, answers in enumerate(done, 1):
                parts = parts.unionByName(answers.select("block", F.lit(stage).alias("stage"), "shard", "counts", "shared"),
                                          allowMissingColumns=True)
            return parts.repartition(tasks, "block").sortWithinPartitions("block", "stage", "shard")

        short = blocks.select("block", *_HEAD).mapInPandas(_short_requests(bits), REQUEST_SCHEMA)
        done = [answered(short, "lm-words-and-pairs")]
        done.append(answered(by_block().mapInPandas(_triple_requests(bits), REQUEST_SCHEMA), "lm-triples"))
    known = done[0].agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    scores = by_block("docs", "nulls").mapInPandas(_score(size["n_train"], known, size["train_docs"]), SCORE_SCHEMA)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["n_train"]).cast("long").alias("train_tokens"),
                         "base_score", "score")
