"""From raw documents to encoded training text in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyleaf.llm.mixing import mixed_documents
from tallyleaf.llm.ngram_join import one_of_each_group
from tallyleaf.llm.pii import mask_personal_data
from tallyleaf.llm.piece_transducer import encode_documents
from tallyleaf.llm.quality import judge
from tallyleaf.llm.queries import piece_model, table
from tallyleaf.session import scratch_path

ORACLE_SQL = None  # boosted trees, masking and the transducer cannot be stated in SQL; tests/llm compares with brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the boosted trees reject go; rows of a rejected ``doc_id`` with other texts stay."""
    return judge(docs, table(spark, sf_dir, "labels")).where("_kept").select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest ``doc_id`` (null last), then the first by text."""
    return one_of_each_group(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is masked."""
    return mask_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: a row for each pass taken of a document."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip``."""
    return encode_documents(docs, piece_model())


STAGES = [("quality", quality), ("unique", unique), ("private", private), ("mixed", mixed), ("encoded", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
