"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graticule.llm import (
    best_fit_packing, chat_format, collocations, embedding_dedup, exact_dedup, license_scan, minhash_dedup, quality_rules, source_mixing,
    structure_repair, substring_dedup, token_counts, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and whether the rules, certified together, keep it."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), joint=True).drop("text_hash")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every text."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest role repair of every conversation, rendered."""
    return chat_format.repair(table(spark, sf_dir, "conversations"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict of every URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after repeated 35-word passages are removed."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by the production mixture."""
    return source_mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "epoch", "domain", "lang", "source", "n_tokens"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text before and after private data is masked."""
    return token_counts.edited(table(spark, sf_dir, "documents"), token_counts.masks)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after rows were damaged."""
    turns = table(spark, sf_dir, "conversations")
    return structure_repair.audit(turns, structure_repair.damaged(turns))


QUERIES = [
    op1_quality_rules, op2_license_scan, op3_embedding_dedup, op4_chat_format, op5_url_filter, op6_minhash_dedup, op7_substring_dedup,
    op8_best_fit_packing, op9_source_mixing, op10_token_counts, op11_exact_dedup, op12_collocations, op13_structure_repair,
]
