"""From raw documents to a training mix: five stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and works on all of
it. All but the last return the columns of documents. Rows with nulls, empty texts and repeated rows are treated
as the operators' docstrings say; in a filtering stage a row without a doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import base, decontaminate, line_dedup, mixing, near_dedup, quality_classifier

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores below LEAST_QUALITY."""
    trees = quality_classifier.train(docs, base.table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, trees, "__tw_score").filter(F.col("__tw_score") >= LEAST_QUALITY).drop("__tw_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines of 20 code points or more that three documents hold, but in the last of them."""
    cut = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, similarity of 0.8 or more."""
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    copies = found.filter("NOT kept").select(F.col("doc_id").alias("__tw_id")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("__tw_id"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, base.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, times."""
    return mixing.taken(docs, weights=(5, 2, 1), max_epochs=3)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]

#: SQL can't express the classifier's trees; tests/llm/test_pipeline.py holds each stage against brute force and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's result written and read again."""
    work = base.Scratch(spark, "pipeline")
    docs = base.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with base.released():  # what the stage's operator wrote isn't read again
            docs = work.keep(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
