"""A corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. Stages are written as Parquet between each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import jaccard, packing, quality, queries, secrets, toxicity
from dossierlake.llm.common import shared_dir, table

GOOD, TOXIC = 0.3, 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``GOOD``, repeated rows and null ids alike.

    Null and empty texts have the base score of the calibration, which decides for all of them.
    """
    return _kept(docs, quality.filter_texts(docs, queries.quality_model(spark, sf_dir), lambda score: score >= GOOD))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under ``TOXIC``; null and empty texts have no toxic term and stay."""
    return _kept(docs, quality.filter_texts(docs, queries.toxicity_model(spark, sf_dir), lambda score: score < TOXIC))


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the least doc_id.

    Documents without words are copies of nothing and stay; of rows that repeat an id with its text one
    stays; rows of one id whose texts differ are judged by themselves. No rows from no rows.
    """
    return jaccard.one_of_each(docs, width=5, num=8, den=10)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked out; null and empty texts stay as they are. No rows from no rows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 4096 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", blank_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # classifiers, the join's merging and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
