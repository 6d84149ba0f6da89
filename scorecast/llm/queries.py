"""The registered queries of the operators, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecast.llm import (backoff_lm, bpe, burst_trie, embeddings, minhash, packing, pii, prefix_hashes, quality, secrets,
                           sharding, token_alignment, toxicity)
from scorecast.llm.labelled import held_out
from scorecast.llm.scratch import ship_package

# The score from which a document counts as label 1.
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), at_least=0.9)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "loss_tokens")


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), TOXIC_FROM)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def _count(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    counts = [_count(base, k) for k in secrets.KINDS]
    return scanned.select("doc_id", *counts, F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"),
                          _listed(F.col("spans")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, table(spark, sf_dir, "labels"), vectors)
    return _scored(quality.score_quality(docs, vectors, network), QUALITY_FROM)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"))
    counts = [_count("spans", k) for k in pii.KINDS]
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"), *counts,
                        _listed(F.col("spans")).alias("spans"))


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_statistics(table(spark, sf_dir, "documents"), tokenizer_path(),
                                                tokenizer_path("piece_bpe_32k.model"))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.prefix_trie(burst_trie.rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_sharding": op2_sharding,
    "op3_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_minhash": op7_minhash,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_backoff_lm": op11_backoff_lm,
    "op12_token_alignment": op12_token_alignment,
    "op13_burst_trie": op13_burst_trie,
    "pipeline": pipeline,
}
