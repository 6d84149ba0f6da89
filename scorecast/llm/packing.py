"""Operator 4: vector bin packing of documents into training sequences.

A document's ids, with a closing id 0, are cut into pieces. A full piece is a sequence of its
own; the rests are packed under three limits at once: tokens, segments and loss-bearing
tokens. A sequence takes, among the waiting pieces that fit all limits, the one whose demand
has the largest dot product with what the sequence has left (both as shares of the limits);
when none fits, one piece is cut to fill the gap. Every task packs the rows of its own input
split from a bounded pool, so nothing is shuffled and at most one sequence of a task is not
full.

Edge cases: null and empty texts are the closing id alone; repeated rows are packed each;
an empty table gives no pieces; a null ``doc_id`` stays null; other columns are not read.
A text is encoded whole, by its distinct words: the pre-tokenisation rule's words do not
influence each other. A word's ids come from tiktoken with the ranks of the vocabulary file,
which is several times as fast as the tokenizers library on single words; the ids are the same
(tested against that library).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import bpe
from scorecast.llm import spans as S

CLOSING_ID = 0
#: Distinct words whose ids a task keeps (some 300 bytes each).
KEEP_WORDS = 100_000
SCHEMA = ("doc_id long, start long, length long, loss_tokens long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. 512 segments fill a sequence with documents of two ids, the
    shortest ones with a text; of empty documents alone it has half its length, a power of two."""

    tokens: int = 1024
    segments: int = 512
    loss_tokens: int = 1024


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Ids of one word, the vocabulary, and the words that the running task has seen."""
    import tiktoken

    vocab = bpe.vocabulary(path)
    # Texts are split before, so one pattern takes a whole word; ids are ranks.
    words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocab.ids, special_tokens={})
    return words.encode_ordinary, vocab, {}


def document_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Ids of each whole text as the tokenizers library gives them, and the closing id."""
    encode, vocab, cache = _encoder(path)
    for _, _, words, index, firsts in vocab.encode_batch(texts):
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > KEEP_WORDS:
            cache.clear()
            new = words
        cache.update((w, array("I", [vocab.special[w]] if isinstance(w, bpe.SpecialWord) else encode(w)).tobytes())
                     for w in new)
        ids = [cache[w] for w in words]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        chunk, ends = bpe.gather(np.frombuffer(b"".join(ids), dtype=np.uint32), sizes, index)
        for first, end in zip(firsts[:-1], firsts[1:]):
            yield np.append(chunk[ends[first]:ends[end]], np.uint32(CLOSING_ID))


class Packer:
    """Packs pieces into sequences, one open sequence at a time, from a bounded pool."""

    def __init__(self, limits: Limits, pool: int, first_sequence: int):
        self.limits, self.pool, self.sequence = limits, pool, first_sequence
        self.items: list[tuple] = [()] * (pool + 1)  # doc, start, ids, loss-bearing mask, doc_tokens
        self.need = np.zeros((pool + 1, 3))       # tokens, segments, loss-bearing tokens
        self.free = list(range(pool + 1))
        self.out: list[tuple] = []

    def add(self, doc, start: int, ids: np.ndarray, loss: np.ndarray, total: int) -> None:
        slot = self.free.pop()
        self.items[slot] = (doc, start, ids, loss, total)
        self.need[slot] = (len(ids), 1, int(loss.sum()))
        while len(self.free) <= 1:
            self.fill()

    def _emit(self, slot: int, taken: int, offset: int) -> None:
        doc, start, ids, loss, total = self.items[slot]
        self.out.append((doc, start, taken, int(loss[:taken].sum()), total, self.sequence, offset,
                         ids[:taken].astype("<u4").tobytes()))
        if taken == len(ids):
            self.need[slot] = 0
            self.items[slot] = ()
            self.free.append(slot)
        else:
            self.items[slot] = (doc, start + taken, ids[taken:], loss[taken:], total)
            self.need[slot] = (len(ids) - taken, 1, int(loss[taken:].sum()))

    def fill(self) -> None:
        """Fill and close one sequence."""
        whole = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=float)
        left, offset = whole.copy(), 0
        while left[0] >= 1 and left[1] >= 1 and len(self.free) <= self.pool:
            waiting = self.need[:, 0] > 0
            fits = waiting & (self.need <= left).all(axis=1)
            if fits.any():
                score = (self.need / whole) @ (left / whole)
                slot = int(np.argmax(np.where(fits, score, -1)))
                taken = int(self.need[slot, 0])
            else:
                # Nothing fits whole: the shortest waiting piece is cut to fill the gap.
                slot = int(np.argmin(np.where(waiting, self.need[:, 0], np.inf)))
                _, _, ids, loss, _ = self.items[slot]
                taken = min(int(left[0]), int(np.searchsorted(np.cumsum(loss), left[2], side="right")))
                if not taken:
                    break
                left[0] = taken  # the sequence closes with it
            spent = (taken, 1, int(self.items[slot][3][:taken].sum()))
            self._emit(slot, taken, offset)
            left -= spent
            offset += taken
        self.sequence += 1

    def close(self) -> None:
        while len(self.free) <= self.pool:
            self.fill()

    def flush(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _pack(path: str, limits: Limits, pool: int, has_loss: bool):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(limits, pool, TaskContext.get().partitionId() << 32)
        cut = min(limits.tokens, limits.loss_tokens)
        for batch in batches:
            texts = S.clean(batch["text"])
            docs = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            bearing = batch["loss"].tolist() if has_loss else [None] * len(texts)
            for doc, trained, ids in zip(docs, bearing, document_ids(texts, path)):
                loss = np.ones(len(ids), dtype=bool)
                if trained is not None and trained == trained:
                    loss[:max(0, len(ids) - int(trained))] = False
                for start in range(0, len(ids), cut):
                    packer.add(doc, start, ids[start:start + cut], loss[start:start + cut], len(ids))
                if len(packer.out) >= 2000:
                    yield _frame(packer.flush(), columns)
        packer.close()
        _encoder(path)[2].clear()  # the worker lives on; its next task has its own words
        yield _frame(packer.flush(), columns)
    return S.giving_back(run)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), pool: int = 1024,
                   loss_column: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence.

    ``loss_column`` names a column with the number of a document's last ids (closing id
    included) that bear loss; without it, or where it is null, all do.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    if loss_column:
        columns.append(F.col(loss_column).cast("long").alias("loss"))
    return docs.select(*columns).mapInPandas(_pack(tokenizer_path, limits, pool, bool(loss_column)), SCHEMA)
