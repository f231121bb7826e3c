"""From raw documents to packed training sequences: identify, filter, deduplicate, decontaminate, pack.

Each stage works on what the one before kept and is written before the next reads it; what a stage wrote on its way goes when it is done. The
result has the token ids of every piece, so that a sequence is its pieces by ``offset``.

Defined cases: null, empty and blank texts and those without a letter go in the first stage (without languages to learn from, all do); a text of any length passes whole; repeated rows
and near copies leave one row, of ties the smallest id, then the smallest hash of the text; without labels nothing reaches the quality that is asked for, so
all goes; without a benchmark nothing goes there; an empty table gives no pieces; extra columns, whatever their names, reach the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphvec.llm import decontaminate, language_id, packing, quality_classifier, simhash_dedup
from graphvec.llm.common import passing, settle, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return language_id.keep_identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be bad go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of the stages; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing(spark):
            docs = settle(stage(spark, docs, sf_dir), instead_of=docs, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
