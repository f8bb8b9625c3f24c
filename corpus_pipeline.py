"""The corpus pipeline: its stages, in order, each on the table that the one before has left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, ngram_join, packing, pii, toxicity
from quillmark.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return ngram_join.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", copies_out),
    ("benchmark_decontamination", leaks_out),
    ("pii", personal_data_out),
    ("best_fit_packing", packed),
]

#: The tokenizer, the fitted regression and the exact join of texts have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table of documents; each stage's rows are written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
