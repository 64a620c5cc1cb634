"""A cleaning pipeline over ``documents``: each stage works on the rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeworks.llm import decontaminate, near_dedup, pii, piece_sampling, quality
from gradeworks.llm.common import cut
from gradeworks.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject. Null and empty texts have too few words and go; an empty table stays empty."""
    return quality.stage(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies at 0.8. Rows without text or id stay; rows that repeat id and text are one."""
    return near_dedup.stage(docs, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item, or nearly. Null and empty texts hold none and stay."""
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind in brackets. Null texts stay null."""
    return pii.stage(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text; the last stage, so its columns are its own."""
    return piece_sampling.stage(docs, tokenizer("piece_bpe_32k.model"), 2)


STAGES = [
    ("quality rules", good_quality),
    ("near-dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("segmentation", segmented),
]

#: Learned votes and sampled segmentations are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
