"""A training corpus in four stages: quality, near duplicates, source mix, packed bins.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
run() writes each stage's result as Parquet into the shared folder and reads it back as the next one's docs; each table goes
when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import jaccard, mixing, packing, quality
from tickweave.store import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.where(~quality.held_out()), labels)
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document, by id, of each group of near duplicates."""
    return jaccard.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target sizes."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into bins of several capacities."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("mix", mixed), ("pack", packed)]

#: The classifier is learned, so SQL cannot give the rows; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), *spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
