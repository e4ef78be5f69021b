"""The registered queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampere.llm import (alignment, decontamination, extraction, fingerprints, licenses, ngram_join, packing,
                        pii, repair, sharding, substring_dedup, topk, toxicity)
from ampere.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op10_ngram_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def word_vocabulary() -> str:
    """Path of the public word-BPE vocabulary, the default of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())


@query
def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_gear_chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op7_ratio_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op5_license_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", "source", "lang", shelf, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.withColumn("path", path))


@query
def op11_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.align_documents(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, names))


@query
def op12_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op13_weight_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


ORACLES["op8_jump_shards"] = sharding.ORACLE_SQL
ORACLES["op5_license_paths"] = licenses.oracle_sql("""SELECT doc_id, source || '/' || lang || '/' ||
  CAST(CAST(FLOOR(doc_id / 1000) AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents""")
ORACLES["op4_chosen_path_join"] = ngram_join.ORACLE_SQL
ORACLES["op13_weight_repair"] = repair.ORACLE_SQL
ORACLES["op12_block_pruning"] = topk.ORACLE_SQL
