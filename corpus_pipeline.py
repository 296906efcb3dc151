"""The corpus pipeline: from the table `documents` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of `docs`. A stage's operator says how it treats nulls, empty and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import decontaminate as leaks
from bookflow.llm import line_dedup, near_dedup, packing, quality_model
from bookflow.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go but for one copy, and with them documents that have nothing else; n_chars follows the text."""
    cleaned = line_dedup.drop_spread_lines(docs)
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cleaned = cleaned.filter((F.col("_removed") == 0) | worded)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: SQL expresses neither the classifier's training nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
