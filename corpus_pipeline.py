"""From raw documents to packed sequences: quality, exact copies, near copies, benchmark leaks, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents; each works on everything that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontaminate, exact_dedup, minhash, packing, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_documents(docs, common.load(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts stays."""
    common.tune(spark)
    return exact_dedup.distinct_documents(docs)


#: Near copies of the stage: words of a shingle, and the least similarity in per cent. The query op10 has its own.
NEAR = {"shingle": 5, "similarity": 80}


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    common.tune(spark)
    return minhash.representatives(docs, **NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.clean_documents(docs, common.load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    common.tune(spark)
    return packing.pack_documents(docs, packing.TOKENIZER)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", leaks), ("packing", packed)]

#: The classifier, MinHash and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    return docs
