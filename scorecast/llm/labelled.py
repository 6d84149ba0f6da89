"""The labelled rows that a classifier may learn from, as a bounded, reproducible sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text divisible by FOLDS."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, fold) of at most ``per_class`` labelled documents of either class, the
    first by a hash of the id; fold is crc32 of the id mod FOLDS (1 to FOLDS - 1).

    The ids drawn are bounded by the parameter, so they are broadcast.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    present = known.join(docs.filter("doc_id is not null and text is not null").select("doc_id"), "doc_id", "left_semi")
    drawn = None
    for y in (0, 1):
        some = present.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    fold = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS).cast("int")
    # Rows that repeat an id count once, so the sample stays bounded: with the text of the least
    # hash, whichever row comes first.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    return (rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .withColumn("fold", fold).select("doc_id", "text", "y", "fold"))
