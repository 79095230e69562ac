"""Corpus preparation: the training-data operators as one pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs. All but the last return the
columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskshift.llm import bpe, lsh_forest, quality_rules, secret_scan, source_mix
from taskshift.llm.common import WORD, delete, read, scratch, written

VOCABULARY = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failed lines leave the text, rejected documents go."""
    judged = quality_rules.quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    d = quality_rules.accepted(judged)
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (five-word shingles, similarity 0.8): one document of each group stays, the one with the smallest doc_id.

    Rows are told apart by doc_id and text: rows that share a doc_id but not
    their text are judged by their texts, rows without a doc_id come after all
    others of their group. Of rows that share both, one stays, the least by its
    other columns. Documents without words all stay. Columns may be of any type.
    """
    groups = lsh_forest.near_groups(docs)
    kept = groups.where("stays and n_shingles > 0").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select("doc_id", lsh_forest.text_md5(), row.alias("row"), (F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("")).alias("rest"), F.col("text").rlike(WORD).alias("words"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_md5") == F.col("__md5"))
    one = d.where("words").join(kept, same, "left_semi").groupBy("doc_id", "text_md5").agg(F.min_by("row", "rest").alias("row")).select("row.*")
    return one.unionByName(d.where(~F.coalesce("words", F.lit(False))).select("row.*"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: values that the forest takes for secrets are replaced in the texts."""
    labelled = secret_scan.stand_in_findings(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return secret_scan.redact(docs, labelled, public_tokenizers.path(VOCABULARY), "source")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mix: each document's words in the blocks that the mix takes, in up to two rows."""
    return source_mix.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids of every text, their number, and the hash of the text decoded from them."""
    d = bpe.encode_documents(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(VOCABULARY))
    return d.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: Near-dedup, the forest and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table. What a stage wrote for itself goes when its result is written, a result when the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = written(out, f"pipeline-{k}")
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
