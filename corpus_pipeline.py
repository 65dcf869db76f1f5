"""Corpus pipeline: quality rules, toxicity, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import dedup, jaccard, packing, quality, toxicity
from cohortlens.llm.common import crc_remainder, materialize, placed, table, without_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language.

    A null or empty text has no words and fails the base rules.
    """
    rows, lang = placed(docs), F.col("lang")
    slim = rows.select("file", "row", "doc.doc_id", quality.language("doc.lang").alias("lang"), "doc.text")
    measured = materialize(quality.measure(slim).drop("text"), "quality")
    cutoffs = quality.thresholds(measured, table(spark, sf_dir, "labels"), lang)
    rejected = quality.judge(measured, cutoffs, lang).where("NOT kept").select("file", "row")
    return without_rows(rows, materialize(rejected, "quality-rejected"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, model, score_col="__score", offending_col="__offending")
    return scored.where("__score < 0.3").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return dedup.deduplicate(docs).kept()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that hang together by links the document with the least id."""
    return jaccard.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1,024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "cut")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard", near_duplicates),
    ("packing", packing_stage),
]

# The tokenizer, the trained scorer and the similarity groups are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
