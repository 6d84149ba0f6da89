"""Operator 5: toxicity by a factorization machine over hashed terms.

A text's terms are its words (lower case) and their openings of four and five letters, as
64-bit hashes, each once. On a bounded sample of labelled rows the terms whose share of toxic
documents differs clearly from the rest are kept, and those of pairs whose common share differs
clearly more than either member's alone; a factorization machine learns a weight
for each and a vector whose dot products are the weights of all pairs: two terms that are
harmless alone (an insult used of a thing, a mention of a group) can weigh together. Scoring
is one pass over the documents with the fitted arrays.

The fit uses numpy on the driver: its input is bounded by ``per_class`` documents and
``TERMS`` terms. Only texts are inputs of a score.

Edge cases: null and empty texts have no terms and get the model's base score; repeated rows
get equal scores; without labelled rows of both classes every score is the base rate (0 where
there are none); an empty table gives an empty result; other columns are not read.
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
from scorecast.llm.scratch import written

#: Labelled rows of either class that are learned from, at most.
PER_CLASS = 5000
#: Terms the model keeps, at most, and how clearly (standard errors) a term must differ.
TERMS, CLEAR = 4096, 4.0
#: How clearly a pair must differ, of the millions that are tried, and so in how many documents
#: its members are, at least. Columns of a block of pair counts.
PAIR_CLEAR, COLUMNS = 6.0, 512
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 256, 0.03, 1e-4
OPENINGS = (4, 5)


def term_hashes(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk of rows: (first row, last row, row of each term, hash), not yet distinct."""
    for a, b in S.chunks(texts):
        points, bounds = S.join_points(texts[a:b])
        kind = bpe._classes()[points]
        starts, ends = S.runs((kind == bpe._LETTER) | (kind == bpe._NUMBER), bounds)
        values, row = S.symbol_table(True)[points], S.owner(bounds, starts)
        rows, hashes = [row], [S.mix64(S.span_hashes(values, starts, ends))]
        for k in OPENINGS:
            longer = ends - starts > k
            rows.append(row[longer])
            hashes.append(S.mix64(S.span_hashes(values, starts[longer], starts[longer] + k) + S.U64(k)))
        yield a, b, np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    terms: np.ndarray    # sorted hashes
    base: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n documents with the given (row, index of term) pairs."""
        v = self.factor[term]
        out = self.base + np.bincount(row, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            out += 0.5 * (np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n))
        return out

    def known(self, row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, index of term) pairs of the terms that the model has."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        pair = np.unique(row[hit] * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, documents, toxic documents) of each batch."""
    for batch in batches:
        y = batch["y"].to_numpy(dtype=np.int64)
        for a, b, row, hashes in term_hashes(S.clean(batch["text"])):
            terms, index = np.unique(hashes, return_inverse=True)
            pair = np.unique(row * len(terms) + index)
            row, index = pair // max(1, len(terms)), pair % max(1, len(terms))
            yield pd.DataFrame({"term": terms.view(np.int64), "every": np.bincount(index, minlength=len(terms)),
                                "pos": np.bincount(index, y[a + row], len(terms)).astype(np.int64)})


def choose_terms(sample: DataFrame, n: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the at most ``TERMS`` terms whose share of documents differs most
    clearly between the n1 toxic and the other documents of the sample, and of all terms that
    are in enough documents for a clear pair."""
    counts = (sample.select("text", "y").mapInPandas(_counts, "term long, every long, pos long")
              .groupBy("term").agg(F.sum("every").alias("every"), F.sum("pos").alias("pos")))
    share, n0 = F.col("every") / n, n - n1
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1 / n)) * (1 / n1 + 1 / n0))
    clear = F.abs(F.col("pos") / n1 - (F.col("every") - F.col("pos")) / n0) / error
    best = (counts.select("term", clear.alias("clear")).filter(F.col("clear") >= CLEAR)
            .orderBy(F.desc("clear"), "term").limit(TERMS).collect())
    common = counts.select("term").filter(F.col("every") >= PAIR_CLEAR ** 2).collect()
    clear, common = (np.sort(np.array([r["term"] for r in x], dtype=np.int64).view(S.U64)) for x in (best, common))
    return clear, common


def _clear(every: np.ndarray, pos: np.ndarray, n: int, n1: int) -> np.ndarray:
    share, n0 = every / n, n - n1
    error = np.sqrt(np.maximum(share * (1 - share), 1 / n) * (1 / n1 + 1 / n0))
    return np.abs(pos / n1 - (every - pos) / n0) / error


def joint_terms(row: np.ndarray, term: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Indices of the at most ``TERMS`` terms in pairs that are clear together: at least by
    ``PAIR_CLEAR``, and by ``CLEAR`` more than either member. The pairs are counted in blocks."""
    n, n1 = len(y), int(y.sum())
    alone = _clear(np.bincount(term, minlength=size), np.bincount(term, y[row], size), n, n1)
    order = np.argsort(term, kind="stable")
    row, first = row[order], np.searchsorted(term[order], np.arange(size + 1))
    toxic, gain = y == 1, np.zeros(size)

    def block(lo: int, hi: int) -> np.ndarray:
        out = np.zeros((n, hi - lo), dtype=np.float32)
        out[row[first[lo]:first[hi]], np.repeat(np.arange(hi - lo), np.diff(first[lo:hi + 1]))] = 1
        return out

    for lo in range(0, size, COLUMNS):
        hi = min(size, lo + COLUMNS)
        left = block(lo, hi)
        for at in range(lo, size, COLUMNS):
            to = min(size, at + COLUMNS)
            right = left if at == lo else block(at, to)
            pos = (left[toxic].T @ right[toxic]).astype(float)
            every = pos + left[~toxic].T @ right[~toxic]
            clear = _clear(every, pos, n, n1)
            more = clear - np.maximum(alone[lo:hi, None], alone[None, at:to])
            more[(clear < PAIR_CLEAR) | (more < CLEAR)] = 0
            gain[lo:hi] = np.maximum(gain[lo:hi], more.max(axis=1))
            gain[at:to] = np.maximum(gain[at:to], more.max(axis=0))
    best = np.argsort(-gain, kind="stable")[:TERMS]
    return np.sort(best[gain[best] > 0])


def fit(terms: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Fit on documents 0..len(y)-1 that have the distinct (row, index of term) pairs, sorted by
    row; ``weight`` scales each document's loss, so that a sample drawn by class keeps the
    classes' true shares."""
    y, n = y.astype(float), len(y)
    rate = float(np.average(y, weights=weight)) if n else 0.0
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    if not n or not 0 < rate < 1:
        return Model(np.zeros(0, S.U64), base, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    model = Model(terms, base, np.zeros(len(terms)), 0.02 * rng.standard_normal((len(terms), FACTORS)))
    first = np.searchsorted(row, np.arange(n + 1))
    size = 1 + FACTORS
    params = np.hstack([model.weight[:, None], model.factor])
    squares, base_square = np.full(params.shape, 1e-8), 1e-8
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            many = first[batch + 1] - first[batch]
            ends = np.cumsum(many)
            at = np.repeat(first[batch] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            own, t = np.repeat(np.arange(len(batch)), many), term[at]
            model.weight, model.factor = params[:, 0], params[:, 1:]
            p = 1 / (1 + np.exp(-np.clip(model.logits(own, t, len(batch)), -30, 30)))
            g = (p - y[batch]) * weight[batch] / weight[batch].sum()
            v = params[t, 1:]
            sums = np.stack([np.bincount(own, v[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            grad = np.empty((len(t), size))
            grad[:, 0] = g[own]
            grad[:, 1:] = g[own, None] * (sums[own] - v)
            step = np.stack([np.bincount(t, grad[:, k], len(terms)) for k in range(size)], axis=1) + DECAY * params
            squares = 0.99 * squares + 0.01 * step * step
            params = params - RATE * step / np.sqrt(squares + 1e-10)
            base_square = 0.99 * base_square + 0.01 * g.sum() ** 2
            model.base -= RATE * g.sum() / np.sqrt(base_square + 1e-10)
    model.weight, model.factor = params[:, 0].copy(), params[:, 1:].copy()
    return model


def _known_terms(terms: np.ndarray):
    lookup = Model(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, row, hashes in term_hashes(S.clean(batch["text"])):
                row, term = lookup.known(row, hashes, b - a)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                part = batch.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"],
                                    "terms": [term[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]})
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled documents that may be learned from.

    The sample is written once; term counts are made by Spark, and the driver gets at most
    ``TERMS`` clear terms and the common ones and, per document of the sample, which it has."""
    sample = written(training_rows(docs, labels, label, per_class), "labelled")
    drawn = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {r["y"]: r["n"] for r in labels.filter(~held_out()).groupBy(F.col(label).cast("int").alias("y"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n1 = sum(drawn.values()), drawn.get(1, 0)
    none = np.zeros(0, S.U64)
    clear, common = choose_terms(sample, n, n1) if 0 < n1 < n else (none, none)
    terms = np.union1d(clear, common)
    rows = sample.select("doc_id", "text", "y").mapInPandas(
        _known_terms(terms), "doc_id long, y int, terms binary").toPandas().sort_values("doc_id", kind="stable")
    has = [np.frombuffer(x, dtype=np.int32) for x in rows["terms"]]
    y = rows["y"].to_numpy(dtype=np.int64)
    weight = np.array([share.get(k, 0) / drawn[k] for k in y.tolist()], dtype=float)
    row = np.repeat(np.arange(len(has)), [len(x) for x in has])
    term = np.concatenate([*has, np.zeros(0, np.int32)]).astype(np.int64)
    use = np.isin(terms, clear)
    if len(common):
        use[joint_terms(row, term, y, len(terms))] = True
    hit = use[term]
    return fit(terms[use], row[hit], (np.cumsum(use) - 1)[term[hit]], y, weight)


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b, row, hashes in term_hashes(texts):
        logits = model.logits(*model.known(row, hashes, b - a), b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    return out


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(),
                                "score": _scores(model, S.clean(batch["text"]))})
    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _score(model), "doc_id long, score double")


def filter_documents(docs: DataFrame, model: Model, below: float) -> DataFrame:
    """The rows, with all columns, whose score is below the limit."""
    return docs.mapInArrow(S.arrow_filter(lambda texts: _scores(model, texts) < below), docs.schema)
