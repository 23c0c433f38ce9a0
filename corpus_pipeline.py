"""A training corpus from raw documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import leaks, lines, mixing, near, quality
from trackloom.llm.common import shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject. Null and empty texts have the score of a text without words."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated and near-repeated lines. A null text stays null; a document may become empty, but stays."""
    return lines.line_dedup(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; null and empty texts are one class."""
    return near.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of ``benchmark`` leaks; null and empty texts stay."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how much of each, and where it goes.

    As in each stage: null and empty texts, repeated rows, an empty table and further columns are as the operator's docstring says.
    """
    return mixing.mix(docs).where("taken > 0").withColumn("shards", F.expr(mixing.PIECES)).drop("pieces")


STAGES = [
    ("quality", good_quality),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier, the signatures and the draws are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    run_id = spark.range(1).select(F.expr("uuid()")).head()[0]
    for name, stage in STAGES[:-1]:
        path = f"{folder}/corpus-{run_id}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
