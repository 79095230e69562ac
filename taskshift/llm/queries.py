"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from taskshift.llm import bpe, collocations, cotraining, lsh_forest, quality_rules, range_shards, secret_scan, source_mix, spelling_variants, suffix_dedup, token_counts, tool_calls, vp_tree
from taskshift.llm.common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; values as hashes."""
    docs = read(spark, sf_dir, "documents")
    labelled = secret_scan.stand_in_findings(docs, read(spark, sf_dir, "labels"))
    found = secret_scan.scan(docs.withColumn("path", F.col("source")), labelled, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "p_secret", "is_secret")


def op2_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the word-end BPE file."""
    return bpe.document_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from two co-trained views."""
    return cotraining.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and best score of every document over the 32k piece vocabulary."""
    return token_counts.document_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove 50-byte strings that an earlier document holds, from every document."""
    return suffix_dedup.document_suffix_dedup(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning verdict and base figures of every document."""
    return quality_rules.document_quality(read(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and results of all conversations: linked, ordered, checked, serialised."""
    return tool_calls.link(*tool_calls.stand_in(spark, sf_dir))


def op9_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all, exact (factor 1)."""
    return vp_tree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Sainte-Lague mix takes of every document."""
    return source_mix.document_mix(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents."""
    return spelling_variants.variants(read(spark, sf_dir, "documents"))


def op13_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document: eight shards of near-equal bytes by sampled splitters."""
    return range_shards.document_shards(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": op1_secret_scan,
        "op2_minhash_lsh_forest": op2_minhash_lsh_forest,
        "op3_bpe": op3_bpe,
        "op4_cotraining": op4_cotraining,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_tool_calls": op8_tool_calls,
        "op9_vp_tree": op9_vp_tree,
        "op10_source_mix": op10_source_mix,
        "op11_collocations": op11_collocations,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_range_shards": op13_range_shards,
    }


def oracle_sql() -> dict[str, str]:
    from taskshift.llm.oracle import ORACLE
    return {**ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
