"""A corpus pipeline of five of the operators; every stage works on what the one before kept.

Defined cases of every stage: a null text counts as empty, which the first stage rejects for too few words; rows with a
null or repeated doc_id are documents of their own, of which the third stage leaves one where their texts are near copies
(the least doc_id, then the least hash of the text); very long texts are worked on whole; extra columns, also clashing
ones, go with the first stage; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueflow.llm import dedup, packing, pairwise, pii, rules
from cueflow.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, whatever the order of the rules."""
    return rules.keep(docs).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the score's threshold; all of them where a label is missing among the training rows."""
    return pairwise.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return dedup.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars follows the text."""
    return pii.mask(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]

#: The stages for near copies and packing are beyond SQL; a test holds every stage against plain Python or its operator,
#: near copies against all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written to the shared folder and read again."""
    docs, keep = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = keep.write(stage(spark, docs, sf_dir), name)
        keep.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
