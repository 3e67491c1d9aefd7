"""Cleaning a document corpus, stage by stage, with the operators of ``retentia.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared checkpoint folder and reads it back for the next one.
All stages but the last return the columns of ``documents``, extra columns
included. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import decontamination, jaccard_join, langid, packing, secrets
from retentia.llm.common import materialize, read_table, unused

#: A document is rejected if no language reaches this share of its positions.
MIN_LANGUAGE_SCORE = 0.3
#: Near copies: five-word shingles, and four fifths of them in common.
NEAR = jaccard_join.Rule(shingle=5, num=80, den=100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts and texts without letters go."""
    prefix = "seen_"
    while any(unused(docs, f"{prefix}{c}") != f"{prefix}{c}" for c in ("letters", "lang_pred", "score")):
        prefix = f"_{prefix}"
    seen = langid.labelled(docs, langid.train(docs), prefix)
    return seen.where((F.col(f"{prefix}lang_pred") != langid.UND) & (F.col(f"{prefix}score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id, rows without an id last.

    Rows are numbered once and told apart by that number, so rows that share a doc_id, or
    have none, are documents of their own; of equal ids in a group the first row stays.
    """
    row = unused(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keys = numbered.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("id"))
    groups = jaccard_join.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"), NEAR)
    named = groups.select(F.col("doc_id").alias("number"), "component_id").join(keys, "number")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first"))
    first = kept.select(F.col("first.number").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    name = unused(docs, "key")
    key = F.xxhash64("doc_id", "text")
    judged = decontamination.decontaminate(docs.select(key.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack(materialize(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Trained models and token ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
