"""The corpus pipeline: five stages, each over all that the one before it kept.

Toxicity drops the documents that it rejects, line dedup and suffix-array dedup shorten texts and keep all rows,
near dedup keeps the document of least id of each group of near copies (five-word shingles, similarity 0.8 or more), and
packing places what is left in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.llm import lines, packing, shingles, suffixes, toxicity
from stratiform.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.dedup(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.dedup(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("packing", pack_batches),
]

#: The learned scores of the first stage and the shingles of the third have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
