"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; each works on all its predecessor kept.

Quality rules and the quality classifier remove documents, line deduplication
shortens texts, near-duplicate removal keeps the document with the smallest id of
every group, and packing places what is left into sequences.

Defined cases, of the whole: a null text is an empty one, which the rules reject; a null
language or source is one of its own to the rules; rows without an id are judged like
others, and of copies among them one stays; rows equal in id and text are copies; rows of
one id with different texts are judged by their texts; texts of any length are read
whole; columns beyond those of ``documents`` travel along up to the last stage; an empty
table passes every stage and gives no pieces.  Each stage states its own cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavec.llm import line_dedup, near_copies, packing, quality_rules, subword_classifier
from stratavec.llm.common import stored, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_regular(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # learned from all documents: the rules before may leave examples of one class only
    return subword_classifier.keep_good(
        docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    )


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.shorten(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

# a classifier and an iterated estimate cannot be put in SQL; tests/llm compares
# the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
