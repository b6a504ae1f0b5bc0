"""The corpus pipeline: quality rules, near duplicates, personal data, mixing and packing, one written stage after another.

Every stage reads all that the one before it kept and returns the columns of documents, but for the last, which returns
the packed pieces. run() writes each stage to the shared folder and reads it back, so that a lost executor repeats one
stage at most; the tables that a stage wrote on its way are removed with it.

Every stage takes null and empty texts, null ids, sources and languages, repeated rows, empty tables, and extra columns of
any name: quality_rules drops texts under its word count, empty ones among them; near_duplicates keeps one row of equal
ones; personal_data and mixture keep null and empty texts as they are, mixture once each; packing gives each row its end
token at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import mixing, ngram_join, packing, pii, quality
from skeinwork.llm.common import scope, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word sets are linked by a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", sequences)]

#: SQL can't express the pivotal rounding, the tokens or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scope(spark):
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
