"""Operator 9: quality by random-indexing word vectors and a small network.

Tokens are a text's words (lower case, marked where they stand in capitals), the runs of signs
between them, and a mark of each token's shape (case, length class, whether it repeats the one
before). Tokens are hashed to ``WORDS`` rows. Each row has a sparse random index vector (one
plus and one minus component); over the whole corpus a row's word vector adds up its own index
and those of the tokens within ``WINDOW`` places. This sum is made per task and added up by
slices of rows: its size is bounded by the table of word vectors.

A document is the mean and the spread of its tokens' unit vectors. A two-layer numpy network
learns from a bounded sample of labelled rows, drawn evenly by class and weighted back to the
classes' shares; one fold of them sets the temperature of its probabilities.

Edge cases: null and empty texts have the zero vector and get the network's score for it;
repeated rows get equal scores; without labelled rows of both classes every score is the base
rate (0 where there are none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import bpe
from scorecast.llm import spans as S
from scorecast.llm.labelled import held_out, training_rows
from scorecast.llm.scratch import shuffle_partitions

WORDS, DIMENSIONS, WINDOW = 8192, 32, 4
SLICES = 64
PER_CLASS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.01, 1e-4
CALIBRATION_FOLD = 1
U64 = S.U64


def tokens(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of rows: (first row, last row, row of each token, its word row); every
    word or run of signs is followed by the token of its shape."""
    for a, b in S.chunks(texts):
        points, bounds = S.join_points(texts[a:b])
        kind = bpe._classes()[points]
        word = (kind == bpe._LETTER) | (kind == bpe._NUMBER)
        sign = ~word & (kind != bpe._SPACE)
        w0, w1 = S.runs(word, bounds)
        s0, s1 = S.runs(sign, bounds)
        starts, ends = np.concatenate((w0, s0)), np.concatenate((w1, s1))
        is_sign = np.concatenate((np.zeros(len(w0), bool), np.ones(len(s0), bool)))
        order = np.argsort(starts, kind="stable")
        starts, ends, is_sign = starts[order], ends[order], is_sign[order]
        # A run of signs counts with its first three, so that long rulers are alike.
        hashes = S.mix64(S.span_hashes(S.symbol_table(True)[points], starts, np.where(is_sign, np.minimum(ends, starts + 3), ends)))
        large = np.concatenate(([0], np.cumsum((points >= 65) & (points <= 90))))
        small = np.concatenate(([0], np.cumsum((points >= 97) & (points <= 122))))
        number = np.concatenate(([0], np.cumsum(kind == bpe._NUMBER)))
        up, low, digits = (x[ends] - x[starts] for x in (large, small, number))
        size = ends - starts
        capital = (up > 1) & (low == 0)
        row = S.owner(bounds, starts)
        again = np.zeros(len(row), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        shape = (is_sign * 1 + capital * 2 + (digits > 0) * 4 + ((up == 1) & (low > 0)) * 8 + again * 16
                 + np.minimum(3, size // 5) * 32).astype(U64)
        both = np.empty(2 * len(row), dtype=U64)
        both[0::2] = S.mix64(hashes + capital.astype(U64)) % U64(WORDS)
        both[1::2] = S.mix64(shape + U64(0xABCDEF)) % U64(WORDS)
        yield a, b, np.repeat(row, 2), both.astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place of the plus and of the minus component of each row's index vector."""
    h = S.mix64(np.arange(WORDS, dtype=U64) + U64(99))
    plus = (h % U64(DIMENSIONS)).astype(np.int64)
    return plus, (plus + 1 + ((h >> U64(32)) % U64(DIMENSIONS - 1)).astype(np.int64)) % DIMENSIONS


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plus, minus = index_vectors()
    total = np.zeros(WORDS * DIMENSIONS, dtype=np.int64)
    for batch in batches:
        for _, _, row, word in tokens(S.clean(batch["text"])):
            for step in range(WINDOW + 1):
                here, there = (word, word) if not step else (word[:-step], word[step:])
                same = slice(None) if not step else row[:-step] == row[step:]
                here, there = here[same], there[same]
                for x, y in ((here, there), (there, here)) if step else ((here, there),):
                    total += np.bincount(x * DIMENSIONS + plus[y], minlength=len(total))
                    total -= np.bincount(x * DIMENSIONS + minus[y], minlength=len(total))
    parts = total.reshape(SLICES, -1)
    some = [k for k in range(SLICES) if parts[k].any()]
    yield pd.DataFrame({"slice": some, "sums": [parts[k].tobytes() for k in some]})


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One running sum per slice: memory is bounded by the table of word vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch["slice"], batch["sums"]):
            part = np.frombuffer(sums, dtype=np.int64)
            total[k] = total[k] + part if k in total else part
    yield pd.DataFrame({"slice": list(total), "sums": [x.tobytes() for x in total.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all rows, from the tokens of all documents."""
    parts = docs.select("text").mapInPandas(_contexts, "slice int, sums binary")
    n = min(SLICES, shuffle_partitions(docs.sparkSession))
    for by in (("slice", "turn"), ("slice",)):
        if by[-1] == "turn":
            parts = parts.withColumn("turn", F.spark_partition_id() % 16)
        parts = parts.repartition(n, *by).select("slice", "sums").mapInPandas(_add_up, "slice int, sums binary")
    vectors = np.zeros((SLICES, WORDS * DIMENSIONS // SLICES))
    for r in parts.collect():  # at most SLICES rows of the bounded table
        vectors[r["slice"]] += np.frombuffer(r["sums"], dtype=np.int64)
    vectors = vectors.reshape(WORDS, DIMENSIONS)
    # What all tokens share says nothing about one of them.
    vectors = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    used = np.abs(vectors).sum(axis=1) > 0
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
    return (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's token vectors."""
    out = np.zeros((len(texts), 2 * DIMENSIONS), dtype=np.float32)
    for a, b, row, word in tokens(texts):
        first = np.searchsorted(row, np.arange(b - a + 1))
        full = np.flatnonzero(first[1:] > first[:-1])
        if not len(full):
            continue
        own, n = vectors[word], (first[1:] - first[:-1])[full, None]
        mean = np.add.reduceat(own, first[:-1][full], axis=0) / n
        square = np.add.reduceat(own * own, first[:-1][full], axis=0) / n
        out[a + full, :DIMENSIONS] = mean
        out[a + full, DIMENSIONS:] = np.sqrt(np.maximum(0, square - mean * mean))
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # input weights and bias, output weights and bias
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, (x - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, calibration: np.ndarray, seed: int = 11) -> Network:
    """Train on the rows outside ``calibration``; that part sets the temperature."""
    rng, width = np.random.default_rng(seed), 2 * DIMENSIONS
    rate = float(np.average(y, weights=weight)) if len(y) else 0.0
    if not 0 < rate < 1:
        flat = [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([30.0 if rate else -30.0])]
        return Network(np.zeros(width), np.ones(width), flat)
    use = ~calibration if (~calibration).any() else np.ones(len(y), bool)
    x1, y1, g1 = x[use].astype(float), y[use].astype(float), weight[use]
    net = Network(x1.mean(axis=0), x1.std(axis=0) + 1e-3, [
        rng.standard_normal((width, HIDDEN)) * np.sqrt(2 / width), np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.array([np.log(rate / (1 - rate))])])
    z = (x1 - net.center) / net.scale
    mean, square, t = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for epoch in range(EPOCHS):
        speed = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for batch in np.array_split(rng.permutation(len(y1)), max(1, len(y1) // BATCH)):
            w1, b1, w2, b2 = net.layers
            before = z[batch] @ w1 + b1
            hidden = np.maximum(0, before)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -30, 30)))
            g = (p - y1[batch]) * g1[batch] / g1[batch].sum()
            back = np.outer(g, w2) * (before > 0)
            grads = [z[batch].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ g + DECAY * w2, np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                net.layers[k] = net.layers[k] - speed * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.999 ** t)) + 1e-8)
    if calibration.any():
        logits, y2, g2 = net.logits(x[calibration]), y[calibration], weight[calibration]
        loss = lambda t: np.average(np.logaddexp(0, -(2 * y2 - 1) * logits / t), weights=g2)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pooled(S.clean(batch["text"]), vectors)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "fold": batch["fold"], "x": [v.tobytes() for v in x]})
    return run


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", per_class: int = PER_CLASS) -> Network:
    """Fit on a bounded sample of the labelled documents that may be learned from."""
    rows = training_rows(docs, labels, label, per_class).mapInPandas(
        _pool(vectors), "doc_id long, y int, fold int, x binary").toPandas().sort_values("doc_id", kind="stable")
    share = {r["y"]: r["n"] for r in labels.filter(~held_out()).groupBy(F.col(label).cast("int").alias("y"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    y = rows["y"].to_numpy(dtype=np.int64)
    drawn = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
    weight = np.array([share.get(k, 0) / drawn[k] for k in y.tolist()], dtype=float)
    x = np.array([np.frombuffer(v, dtype=np.float32) for v in rows["x"]]).reshape(-1, 2 * DIMENSIONS)
    return fit(x, y, weight, (rows["fold"] == CALIBRATION_FOLD).to_numpy(dtype=bool))


def _score(vectors: np.ndarray, net: Network):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(),
                                "score": net.scores(pooled(S.clean(batch["text"]), vectors))})
    return run


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """(doc_id, score) for every row; word vectors and network (about 1 MB) go with the code."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _score(vectors, net), "doc_id long, score double")


def filter_documents(docs: DataFrame, vectors: np.ndarray, net: Network, least: float) -> DataFrame:
    """The rows, with all columns, whose score reaches the limit."""
    return docs.mapInArrow(S.arrow_filter(lambda texts: net.scores(pooled(texts, vectors)) >= least), docs.schema)
