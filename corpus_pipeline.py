"""Corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; between stages the table is written as Parquet and read again, so a
stage never recomputes another and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lignum.llm import langid, mixing, outliers, packing, simhash
from lignum.llm.common import DOC_COLUMNS, read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a dominant recognised language; textless and mixed-up ones go."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose statistics are no outliers for their language and source."""
    return outliers.keep_inliers(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal tokens from each source; a source that has fewer gives all."""
    return mixing.keep_mixture(docs, fill=True)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of a fixed number of tokens in the mixture's proportions."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("packing", window_packing),
]

#: The trained labeller, the MCD and the LSH forest have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
