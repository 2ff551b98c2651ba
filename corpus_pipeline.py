"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Quality rules drop documents and take boilerplate lines out; of near-duplicates one stays;
repeated byte strings go; personal data is replaced by its kind; token pieces are packed.
Stages before the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm.common import stored, table
from assetloom.llm.neardup import NearDup, without_near_duplicates
from assetloom.llm.packing import pack
from assetloom.llm.pii import redact
from assetloom.llm.quality import apply_quality
from assetloom.llm.suffixdedup import without_repeats

#: Similarity from 0.8 on; 48 bands of 6 miss a pair there about 5 times in 10 million.
NEAR = NearDup(threshold_percent=80, bands=48)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, NEAR)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the near-duplicate stage nor tokens; the tests run it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
