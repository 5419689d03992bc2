"""Term frequencies, vocabularies and bags of n-grams, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: the occurrences that an n-gram of the vocabulary has in the corpus.
MIN_FREQUENCY = 15


def term_counts(df: DataFrame, ngrams: str = "ngrams") -> DataFrame:
    """Occurrences, not documents, of each n-gram. Partial counts are combined before the exchange."""
    return df.select(F.explode(ngrams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("frequency"))


def vocabulary(df: DataFrame, ngrams: str = "ngrams", minimum: int = MIN_FREQUENCY) -> DataFrame:
    return term_counts(df, ngrams).filter(F.col("frequency") >= minimum)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer partitions than there are cores (a small file that can't be split).

    For scans: of a plan with exchanges, adaptive execution would run them to count its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def long_grams(df: DataFrame, tokens: Column, carry: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Carried columns and ngram, a row for each occurrence.

    Each token becomes a row with the ones after it, and each row its n-grams: generated code all through, where
    arrays of n-grams would be built by interpreted lambdas.
    """
    names = [f"_w{k}" for k in range(high)]
    own = df.select(*carry, tokens.alias("_t"))
    shifted = [F.slice("_t", k + 1, F.greatest(F.size("_t"), F.lit(1))).alias(n) for k, n in enumerate(names)]
    rows = own.select(*carry, F.inline(F.arrays_zip(*shifted)))
    out = rows.select(*carry, F.explode(F.array(*X.gram_list([F.col(n) for n in names], low))).alias("ngram"))
    return out.filter("ngram is not null")


def bag(df: DataFrame, row_id: str, ngrams: str = "ngrams", carry: list[str] | None = None) -> DataFrame:
    """row id, carried columns, ngram, tf. Partial counts are combined before the exchange."""
    keep = [row_id, *(carry or [])]
    return df.select(*keep, F.explode(ngrams).alias("ngram")).groupBy(*keep, "ngram").agg(F.count("*").alias("tf"))


def restrict(long: DataFrame, words: DataFrame) -> DataFrame:
    """Only n-grams of the vocabulary; it can be large, so it is left to the optimizer how it is joined."""
    return long.join(words.select("ngram"), "ngram", "left_semi")


def feature_reduction(counts: DataFrame, minimum: int = MIN_FREQUENCY) -> DataFrame:
    """How many n-grams there are before and after the frequency filter, and the percentage that goes."""
    out = counts.agg(F.count("*").alias("before"), F.count_if(F.col("frequency") >= minimum).alias("after"))
    return out.withColumn("reduction_pct", 100.0 * (F.col("before") - F.col("after")) / F.nullif("before", F.lit(0)))
