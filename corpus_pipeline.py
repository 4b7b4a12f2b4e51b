"""A corpus pipeline of five stages: rules, line dedup, near duplicates, decontamination, mixing.

Rows with a null doc_id pass the stages on their own merits: they are no one's copy, and their lines stay. Null and empty texts
fail the rules. Of equal copies the smallest doc_id stays; repeated rows of one doc_id stay or go together. Columns beside
those of documents are carried to the last stage. Empty tables give no rows. Texts are judged whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from loomdex.llm.common import materialise, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged against references from these documents."""
    return quality_rules.keep_good(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    return line_dedup.without_repeats(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and into which shards."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("draws", mixing.draws_text(mixed["draws"]))


STAGES = [("quality", _quality), ("line_dedup", _lines), ("near_duplicates", _near), ("decontamination", _decontaminate), ("mixing", _mix)]
#: SQL can't state the distances of the first stage; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
