"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Every stage gets all documents that its predecessor kept and returns the columns of documents,
extra ones too; the last one returns tokens. Null and empty texts, nulls in other columns,
repeated rows and very long texts pass as the docstrings of the stages say, and an empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import bpe, common, decontam, linededup, nearjoin, quality
from rasterloom.llm.queries import tokenizer_path

#: The classifier's scores and the trees of statistics have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is judged as an empty one, equal texts alike."""
    return quality.quality_filter(docs, common.table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; every document stays, with its new length, and null texts stay null."""
    found = linededup.dedup_lines(docs, counts=False)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; texts without words go only for an equal row."""
    return nearjoin.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; a null text has none."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document; a null text has no tokens."""
    found = bpe.bpe_encode(docs, tokenizer_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what one returns is written as Parquet and read by the next.

    A stage's table is deleted when the next one is written; the last one's stays for the caller.
    """
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        common.remove(spark, [before] if before else [])
        before = f"{folder}/{name}"
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
