"""Five stages over documents, each applied to what the one before it kept: quality, near copies, repeats, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm import common, mixing, quality, sentencepieces, simhash, suffixes


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, predicts to be good."""
    return quality.good_ones(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies, by fingerprints and by five-word shingles."""
    return simhash.keep_one(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that stand in an earlier place."""
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, once for each copy."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the figures of a round trip."""
    return sentencepieces.encoded(docs)


STAGES = [("quality classifier", good_quality), ("simhash near-dedup", one_of_copies), ("suffix-array dedup", no_repeats), ("mixing sources", mixed), ("sentencepiece", encoded)]

#: Fitting, fingerprints, and tokenising are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, what each keeps written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
