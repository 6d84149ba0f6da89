"""A corpus pipeline: filter toxic and poor documents, keep one of each group of near copies,
mask secrets, pack into training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame that
is written as Parquet and read again as the next one's ``docs``. Rows with a null ``doc_id`` go
through every filter by their own text: they are never dropped for want of an id.

Edge cases: extra columns stay to the end (packing returns pieces); null texts are scored as
empty ones and stay null; rows equal in ``doc_id`` (or without one) and text are copies, of
which near-dedup keeps one; other texts of an id are documents of their own; an empty table
goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.llm import minhash, packing, quality, queries, secrets, toxicity
from scorecast.llm.scratch import ship_package, written


#: Shared 5-word shingles of two texts, in percent of all that they have, from which near_dedup takes them as copies.
NEAR_PERCENT = 80

_TEXT_HASH, _KEY, _ID, _FIRST, _LAST = "__text_hash", "__key", "__id", "__first_text", "__last_text"


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit."""
    ship_package(spark)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.filter_documents(docs, model, queries.TOXIC_FROM)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the limit."""
    ship_package(spark)
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, queries.table(spark, sf_dir, "labels"), vectors)
    return quality.filter_documents(docs, vectors, network, queries.QUALITY_FROM)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for every text: its ``doc_id``, or, for texts without an id and for
    further texts of an id, a number above all ids made from both."""
    rows = docs.withColumn(_TEXT_HASH, F.xxhash64("text"))
    several = (rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias(_ID))
               .agg(F.min(_TEXT_HASH).alias(_FIRST), F.max(_TEXT_HASH).alias(_LAST)).filter(F.col(_FIRST) != F.col(_LAST)))
    # Written, so that the planner knows how few they are and the texts are not shuffled for them.
    j = rows.join(written(several, "several-texts"), F.col("doc_id") == F.col(_ID), "left")
    other = F.col("doc_id").isNull() | (F.col(_TEXT_HASH) != F.col(_FIRST))
    made = F.xxhash64("doc_id", _TEXT_HASH).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return j.withColumn(_KEY, F.when(other, made).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, _KEY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Texts without an
    id, and several texts of one id, are compared each for itself."""
    ship_package(spark)
    keyed = _keyed(docs)
    kept = minhash.near_duplicates(keyed.select(F.col(_KEY).alias("doc_id"), "text"), NEAR_PERCENT).filter("kept").select(
        F.col("doc_id").alias(_KEY)).distinct()
    # Rows of one key are equal in id and text: any one stays.
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced by marks; ``n_chars`` follows."""
    ship_package(spark)
    masked = secrets.redact_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 1024 tokens."""
    ship_package(spark)
    pieces = packing.pack_documents(docs, queries.tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Fitted models, signatures and byte-pair encoding are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
