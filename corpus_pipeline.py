"""A training-data pipeline over ``documents``; each stage is one operator of ``tripwire.llm``.

A stage takes and returns a table with the columns of documents, whatever further columns
there are; the last one returns token counts and digests. Nulls in any column are no harm:
a null text counts as empty. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import bpe, decontam, jaccard, quality, secrets
from tripwire.llm.common import documents, fresh, in_fold, temporary, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~in_fold(F.col("doc_id"), 4, 2))
    (score,) = fresh(docs, "quality_score")
    return quality.score(docs, model, score).filter(F.col(score) >= 0.7).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, a similarity of 0.8 or more)."""
    return jaccard.drop_copies(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words from the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars``, if there, is that of the new text."""
    masked = secrets.mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and digest of the text decoded from them."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_copy),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself is deleted once its result is stored."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
