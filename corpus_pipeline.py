"""A training corpus from the table documents: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last keep the columns of documents, whatever others there are.

Null and empty texts are documents without words: the classifier scores them like others, they are near no other text,
no window of a benchmark item occurs in them, nothing is redacted, and packing gives them the end id alone. Rows with a
null doc_id are near no other and stay. Rows of one doc_id stay or go together as near duplicates. An empty table gives
an empty result; without labels the classifier rejects nothing, and without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorline.llm import decontaminate, neardup, packing, pii, quality
from moorline.llm.common import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, similarity 0.8)."""
    return neardup.distinct_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and where they lie in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_distinct), ("decontamination", drop_leaks), ("personal_data", hide_personal), ("packing", pack)]

#: SQL can neither fit the classifier nor encode texts; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
