"""Operator 2: a reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, text checksum), without one task seeing
them all. A keyed four-round Feistel network permutes the smallest square domain of an even
number of bits that holds n; a value outside 0..n-1 is permuted again until it falls inside
(cycle walking), so the row numbers are permuted among themselves. Shard and slot of a
permuted number p are p mod shards and p div shards: any row's place can be computed from n,
the key and its number alone, shard counts differ by one at most, and slots have no gaps.

Edge cases: a null text has no bytes and the checksum of an empty one; rows with a null
``doc_id`` come first; rows equal in both sort keys are numbered in either order, which
leaves the result the same; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scorecast.llm import spans as S
from scorecast.llm.scratch import shuffle_partitions, written

ROUNDS = 4
U64 = S.U64


def half_bits(n: int) -> int:
    """Bits of one half of the network's domain, the smallest that holds n values."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _network(x: np.ndarray, half: int, key: int, forward: bool) -> np.ndarray:
    mask = U64((1 << half) - 1)
    left, right = x >> U64(half), x & mask
    for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        turn = U64(S.mix_int(key * 8 + r))
        if forward:
            left, right = right, left ^ (S.mix64(right ^ turn) & mask)
        else:
            left, right = right ^ (S.mix64(left ^ turn) & mask), left
    return left << U64(half) | right


def permute(numbers: np.ndarray, n: int, key: int, forward: bool = True) -> np.ndarray:
    """The place of each of ``numbers`` (all below n) in the keyed permutation of 0..n-1;
    with ``forward`` false, the number at each place."""
    half = half_bits(n)
    out = _network(numbers.astype(U64), half, key, forward)
    outside = np.flatnonzero(out >= U64(n))
    while len(outside):
        out[outside] = _network(out[outside], half, key, forward)
        outside = outside[out[outside] >= U64(n)]
    return out.astype(np.int64)


def _placed(n: int, key: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(place=permute(batch["row_number"].to_numpy(), n, key)).drop(columns=["row_number"])
    return run


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with 0..n-1 in ``order``: sorted ranges, whose sizes (one small row each) give
    every range's first number."""
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id()),
                     "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(
        F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    # One row per range on the small side, so its broadcast is bounded by the partitions.
    return (ranged.withColumn("_in", within).join(F.broadcast(before), "_range")
            .withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_range", "_in", "_before"))


def shard_documents(docs: DataFrame, shards: int = 8, key: int = 20_261) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, place, shard, slot) for every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    rows = written(numbered(rows, ["doc_id", "text_crc32", "size"], "row_number"), "numbered")
    n = rows.count()
    placed = rows.withColumn("number", F.col("row_number")).mapInPandas(
        _placed(n, key), "doc_id long, size long, text_crc32 long, number long, place long")
    return placed.select("doc_id", "size", "text_crc32", F.col("number").alias("row_number"), "place",
                         (F.col("place") % shards).cast("int").alias("shard"),
                         F.floor(F.col("place") / shards).cast("long").alias("slot"))
