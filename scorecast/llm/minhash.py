"""Operator 7: near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so half the hash evaluations fill a signature. Bands of the signature are the keys
of a candidate table. Documents with equal sets are one class from the start. Within a band
key, pairs whose signatures agree often enough join candidate families (only spanning links
leave a task), and inside a family every pair is judged on the full sets. Band keys and
families of any size are cut into blocks, and each pair of blocks is a unit of work of
bounded size: no cap, no sampling, and no table of all pairs. Blocks of a band key are compared
with each other only where their documents are not yet of one family (``candidate_families``).

64 permutations give 128 values. The rows of a band and the agreement that signatures need are
derived from the wanted similarity (``scheme``), so that a pair at that similarity shares no
band with probability below ``MISS``, and its signatures agree too little with the same: 25
bands of 5 at 0.85, 32 bands of 4 at 0.80. A similarity that 128 values cannot serve is refused.

Edge cases: null, empty or white-space texts have an empty set and link with nothing; fewer
than five words are one shingle, the whole sequence; repeated rows and equal texts share a
class; a null ``doc_id`` links with nothing and is kept; rows that repeat a ``doc_id`` with
other text are one vertex with the links of both; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecast.llm import spans as S
from scorecast.llm.blocks import PAIR, Forest, dealt, groups, segments
from scorecast.llm.components import connected_components
from scorecast.llm.scratch import released_shuffles, written

SHINGLE = 5
PERMUTATIONS = 64
#: How often the bands, and how often the signatures, may miss a pair at the limit.
MISS = 1e-6
#: Documents of one band key, and shingles of one family, that a block holds.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1_000_000
U64 = S.U64

_BLANK = np.zeros(0x110000, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEPS = S.mix64(np.arange(1, SHINGLE + 1, dtype=U64) * U64(S.BASE)) | U64(1)
_TURNS = S.mix64(np.arange(1, PERMUTATIONS + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


class Scheme(NamedTuple):
    rows: int   # values of a band
    bands: int
    agree: int  # values on which a candidate pair's signatures agree, at least


def scheme(percent: int) -> Scheme:
    """The longest bands, and the largest agreement, that miss a pair at the limit with at most
    ``MISS`` (the values taken as independent)."""
    values, share = 2 * PERMUTATIONS, percent / 100
    if not 0 < share <= 1:
        raise ValueError(f"percent is {percent}, not above 0 and at most 100")
    fitting = [r for r in range(1, values + 1) if (1 - share ** r) ** (values // r) <= MISS]
    if not fitting:
        raise ValueError(f"{values} signature values cannot serve a similarity of {percent} percent")
    agree, below = 0, 0.0
    while agree < values:
        below += math.comb(values, agree) * share ** agree * (1 - share) ** (values - agree)
        if below > MISS:
            break
        agree += 1
    return Scheme(max(fitting), values // max(fitting), agree)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's 5-word shingles."""
    for a, b in S.chunks(texts):
        points, bounds = S.join_points(texts[a:b])
        starts, ends = S.runs(~_BLANK[points], bounds)
        words = S.span_hashes(S.symbol_table(True)[points], starts, ends)
        first = np.searchsorted(S.owner(bounds, starts), np.arange(b - a + 1))
        n = len(words)
        slid = np.zeros(max(0, n - SHINGLE + 1), dtype=U64)
        for k in range(SHINGLE):
            slid += S.mix64(words[k:k + len(slid)]) * _STEPS[k]
        slid = S.mix64(slid)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= SHINGLE:
                yield np.unique(slid[lo:hi - SHINGLE + 1])
            elif hi > lo:
                short = S.mix64(words[lo:hi]) * _STEPS[:hi - lo]
                yield S.mix64(np.array([short.sum(dtype=U64) + U64(hi - lo)], dtype=U64))
            else:
                yield np.zeros(0, dtype=U64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of each set under every permutation; one row per nonempty set."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))[:-1]
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=U64)
    for k, turn in enumerate(_TURNS):
        turned = flat * turn
        out[:, 2 * k] = np.minimum.reduceat(turned, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(turned, at)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign(plan: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = S.clean(batch["text"])
            for a, b in S.chunks(texts):
                sets = list(shingle_sets(texts[a:b]))
                full = [x for x in sets if len(x)]
                sign = signatures(full) if full else np.zeros((0, 2 * PERMUTATIONS), dtype=U64)
                bands = np.zeros((len(full), plan.bands), dtype=U64)
                for k in range(plan.bands):
                    for j in range(plan.rows):
                        bands[:, k] = S.mix64(bands[:, k] * U64(31) + sign[:, k * plan.rows + j] + U64(k))
                small = (S.mix64(sign) >> U64(56)).astype(np.uint8)
                rows, at = [], 0
                for x in sets:
                    if len(x):
                        rows.append((len(x), int(_signed(S.mix64(x + U64(1)).sum(dtype=U64, keepdims=True))[0]),
                                     int(_signed(np.bitwise_xor.reduce(S.mix64(x + U64(7)), keepdims=True))[0]),
                                     small[at].tobytes(), _signed(bands[at])))
                        at += 1
                    else:
                        rows.append((0, 0, 0, b"", np.zeros(0, np.int64)))
                out = pd.DataFrame(rows, columns=["n_shingles", "sum_hash", "xor_hash", "sig", "bands"])
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].astype("Int64").to_numpy())
                yield out
    return S.giving_back(run)


def _candidates(need: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spanning links, per band key and block pair, of pairs whose signatures agree."""
        for part in segments(batches, PAIR):
            sig = np.frombuffer(b"".join(part["sig"]), dtype=np.uint8).reshape(len(part), -1)
            ids, block = part["doc_id"].to_numpy(), part["block"].to_numpy()
            left, right = part["left"].to_numpy(), part["right"].to_numpy()
            component = part["component"].to_numpy() if "component" in part else None
            out = []
            for lo, hi in groups(part, PAIR):
                forest, across = Forest(hi - lo), left[lo] != right[lo]
                for i in range(lo, hi - 1):
                    agree = (sig[i + 1:hi] == sig[i]).sum(axis=1) >= need
                    if across:
                        agree &= block[i + 1:hi] != block[i]
                    if component is not None:
                        agree &= component[i + 1:hi] != component[i]
                    for j in np.flatnonzero(agree):
                        forest.link(i - lo, i + 1 + int(j) - lo)
                out += [(ids[lo + x], ids[lo + y]) for x, y in forest.links]
            yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])
    return S.giving_back(run)


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = S.clean(batch["text"])
        for a, b in S.chunks(texts):
            out = batch.iloc[a:b].drop(columns=["text"])
            out["shingles"] = [x.tobytes() for x in shingle_sets(texts[a:b])]
            yield out


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spanning links, per family and block pair, of pairs at the similarity."""
        for part in segments(batches, PAIR):
            ids, block = part["doc_id"].to_numpy(), part["block"].to_numpy()
            left, right = part["left"].to_numpy(), part["right"].to_numpy()
            out = []
            for lo, hi in groups(part, PAIR):
                sets = [np.frombuffer(x, dtype=U64) for x in part["shingles"].iloc[lo:hi]]
                links = confirmed_links(sets, percent, block[lo:hi] if left[lo] != right[lo] else None)
                out += [(ids[lo + x], ids[lo + y]) for x, y in links]
            yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])
    return S.giving_back(run)


def confirmed_links(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among ``sets`` of pairs with 100 * intersection >= percent * union,
    only between different blocks where blocks are given. Postings count the intersections
    of a set with all later ones at once."""
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    flat = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(len(sets)), n[order])
    _, shingle = np.unique(flat, return_inverse=True)
    by = np.argsort(shingle, kind="stable")          # postings ascend by set
    posting, first = owner[by], np.searchsorted(shingle[by], np.arange(shingle.max() + 2))
    at, size, forest = np.concatenate(([0], np.cumsum(n[order]))), n[order], Forest(len(sets))
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    blocks = None if block is None else block[order]
    for i in range(len(sets) - 1):
        own = slice(at[i], at[i + 1])
        lo, hi = rank[own] + 1, first[shingle[own] + 1]
        many = hi - lo
        total = int(many.sum())
        if not total:
            continue
        ends = np.cumsum(many)
        later = posting[np.repeat(lo - (ends - many), many) + np.arange(total)]
        common = np.bincount(later - i, minlength=1)
        j = np.flatnonzero(100 * common >= percent * (size[i] + size[i:i + len(common)] - common))
        for k in j.tolist():
            if k and (blocks is None or blocks[i] != blocks[i + k]):
                forest.link(i, i + k)
    return [(int(order[x]), int(order[y])) for x, y in forest.links]


def _in_blocks(rows: DataFrame, n_blocks: str) -> DataFrame:
    """Each row once for every pair of blocks its own block is in."""
    return (rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col(n_blocks)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(n_blocks) - 1).cast("int"))))
            .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
            .drop("other", n_blocks))


def _released(df: DataFrame, name: str) -> DataFrame:
    with released_shuffles(df.sparkSession):
        return written(df, name)


def candidate_families(reps: DataFrame, need: int) -> DataFrame:
    """(node, component) over ``reps`` (doc_id, xor_hash, sig, bands): every two documents that
    share a band and whose signatures agree on ``need`` values are in one component.

    First each block of a band key is compared within itself; blocks are dealt anew for every
    key, so the bands of a large family join it. Then keys of several blocks whose documents
    are still in different components are compared across: the documents of the key's largest
    component only with the others. A family costs its rows once for each band, not once for
    each pair of its blocks.
    """
    banded = reps.select("doc_id", "xor_hash", F.explode("bands").alias("key"))
    signs = reps.select("doc_id", "xor_hash", "sig")
    shared = _released(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                       .select("key", F.ceil(F.col("n") / BLOCK_DOCS).alias("n_blocks")), "near-keys")
    place = F.xxhash64("doc_id", "key")
    within = (banded.join(shared, "key").withColumn("block", F.pmod(place, F.col("n_blocks")).cast("int"))
              .withColumn("left", F.col("block")).withColumn("right", F.col("block")).drop("n_blocks"))
    edges = "a long, b long"
    found = connected_components(_released(
        dealt(within.join(signs, ["doc_id", "xor_hash"])).mapInPandas(_candidates(need), edges).distinct(), "near-within"))

    rows = (banded.join(shared.filter("n_blocks > 1").select("key"), "key")
            .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component", F.coalesce("component", "doc_id")))
    split = (rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
             .filter(F.col("n") > F.col("main.n"))
             .select("key", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK_DOCS).alias("n_main"),
                     F.ceil((F.col("n") - F.col("main.n")) / BLOCK_DOCS).alias("n_rest")))
    inside = F.col("component") == F.col("main")
    last = (F.col("n_main") + F.col("n_rest") - 1).cast("int")
    across = (rows.join(split, "key")
              .withColumn("block", F.when(inside, F.pmod(place, F.col("n_main")))
                          .otherwise(F.col("n_main") + F.pmod(place, F.col("n_rest"))).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.when(inside, F.col("n_main")).otherwise(F.lit(0)).cast("int"), last)))
              .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
              .select("doc_id", "xor_hash", "key", "component", "block", "left", "right"))
    more = _released(
        dealt(across.join(signs, ["doc_id", "xor_hash"])).mapInPandas(_candidates(need), edges).distinct(), "near-across")
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    plan = scheme(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.mapInPandas(
        _sign(plan), "doc_id long, n_shingles long, sum_hash long, xor_hash long, sig binary, bands array<long>"), "minmax")
    same = ["n_shingles", "sum_hash", "xor_hash"]
    sized = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy(*same).agg(F.min("doc_id").alias("class_id"))
    # Written, as the queries of the families read it several times: so each has a short plan.
    reps = _released(sized.join(classes, same).filter("doc_id = class_id").dropDuplicates(["doc_id", *same])
                     .drop("class_id"), "near-reps")

    hung = candidate_families(reps, plan.agree)
    family = hung.union(hung.select(F.col("component").alias("node"), "component").distinct())
    member = family.select(F.col("node").alias("doc_id"), F.col("component").alias("key"))
    member = member.join(reps.groupBy("doc_id").agg(F.sum("n_shingles").alias("n_shingles")), "doc_id")
    size = member.groupBy("key").agg(F.sum("n_shingles").alias("n")).select(
        "key", F.ceil(F.col("n") / BLOCK_SHINGLES).alias("n_blocks"))
    member = member.drop("n_shingles").join(size, "key")
    sets = (texts.withColumn("text_hash", F.xxhash64("text")).join(member, "doc_id")
            .dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")
            .mapInPandas(_shingles, "doc_id long, key long, n_blocks long, shingles binary"))
    links = _released(dealt(_in_blocks(sets, "n_blocks")).mapInPandas(_confirm(percent), "a long, b long"), "near-links")

    # A document with several texts is one vertex with the links of all of them.
    repeated = (signed.filter("doc_id is not null").select("doc_id", *same).distinct()
                .groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"))
    own = (sized.join(repeated, "doc_id", "left_semi").join(classes, same).filter("doc_id <> class_id")
           .select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    found = connected_components(links.unionByName(own))
    of_class = classes.join(found, F.col("class_id") == F.col("node"), "left").select(
        *same, F.coalesce("component", "class_id").alias("component_id"))
    full = signed.filter("n_shingles > 0").select("doc_id", *same).join(of_class, same, "left")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles").join(
        found.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id"), "doc_id", "left")
    rows = full.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return rows.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
