"""Reports: counts, pivots, top lists, themes, and the data-quality audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Nulls are not counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def counts_by_index(df: DataFrame, column: str) -> DataFrame:
    """value_counts in the order of the values, with their place."""
    out = value_counts(df, column)
    return out.withColumn("place", F.row_number().over(Window.orderBy(column))).orderBy(column)  # one row a value


def pivot_counts(df: DataFrame, row: Column, column: str, values: list) -> DataFrame:
    """Counts by row and listed value, 0 where there are none."""
    return df.groupBy(row.alias("row")).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def monthly(df: DataFrame, day: str) -> DataFrame:
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def yearly(df: DataFrame, date_text: str) -> DataFrame:
    return df.groupBy(F.substring(date_text, 1, 4).alias("year")).agg(F.count("*").alias("n"))


def rate_statistics(rates: DataFrame) -> DataFrame:
    """Range of the rates and number of entries of each year."""
    return rates.groupBy(F.year("date").alias("year")).agg(F.min("rate").alias("low"), F.max("rate").alias("high"), F.count("*").alias("n"))


def column_profile(df: DataFrame, date: str, content: str) -> DataFrame:
    """One row: rows, nulls of each column, range of dates, mean length."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(F.count("*").alias("n"), *nulls, F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.avg(F.length(content)).alias("mean_length"))


def quality_audit(df: DataFrame, content: str = "content", url: str = "url", truncated_at: int = 3000) -> DataFrame:
    """One row: contents, lengths, suspected truncation, repeated addresses, score and grade."""
    size = F.when(F.coalesce(F.length(content), F.lit(0)) > 0, F.length(content))
    facts = df.agg(
        F.count("*").alias("total"),
        F.count_if(size.isNull()).alias("missing"),
        F.count_if(size == truncated_at).alias("truncated"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(0.0)).alias("median_length"),
        F.coalesce(F.min(size), F.lit(0)).cast("long").alias("min_length"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_length"),
    )
    urls = df.filter(F.coalesce(url, F.lit("")) != "").groupBy(url).agg(F.count("*").alias("n"))
    urls = urls.agg(F.count_if(F.col("n") > 1).alias("duplicate_urls"), F.count("*").alias("unique_urls"))
    out = facts.join(F.broadcast(urls))  # one row each
    n = F.nullif("total", F.lit(0))
    off = (20.0 * F.col("missing") + 10.0 * F.col("truncated") + 10.0 * F.col("duplicate_urls")) / n
    out = out.withColumn("score", 100 - F.coalesce(off, F.lit(0.0)) - F.when(F.col("mean_length") < 1000, 10.0).otherwise(0.0))
    grade = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 80, "good").when(F.col("score") >= 70, "fair").otherwise("poor")
    return out.withColumn("grade", grade)


def top(polarity: DataFrame, k: int, highest: bool = True) -> DataFrame:
    order = F.desc("mean_score") if highest else F.asc("mean_score")
    return polarity.orderBy(order, "ngram").limit(k)


def first_alphabetically(polarity: DataFrame, stance: str, k: int = 100) -> DataFrame:
    return polarity.filter(F.col("stance") == stance).orderBy("ngram").limit(k).select("ngram")


def discriminative(polarity: DataFrame, keywords: str = X.FINANCE, highest: bool = True, domain: float = 1.5, general: float = 2.5, enough: int | None = 30, by_scores: bool = True) -> DataFrame:
    """The strongest n-grams of the domain, and if there are fewer than enough the strongest of all; with None always both.

    by_scores drops rows of equal statistics even when the n-grams differ; without it rows of equal n-grams.
    """
    sign = 1 if highest else -1
    score = F.col("mean_score") * sign
    own = top(polarity.filter(X.mentions(F.col("ngram"), keywords) & (score > domain)), 100, highest)
    if enough is not None and own.limit(enough).count() >= enough:  # a list of 100 at most
        return own
    both = own.withColumn("_o", F.lit(0)).unionByName(top(polarity.filter(score > general), 50, highest).withColumn("_o", F.lit(1)))
    keys = ["mean_score", "std_score", "num_iterations"] if by_scores else ["ngram"]
    w = Window.partitionBy(*keys).orderBy("_o", "ngram")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_o")


def theme_top(polarity: DataFrame, k: int = 5, pool: int = 100, highest: bool = True, keywords: dict[str, str] | None = None) -> DataFrame:
    """The k strongest n-grams of each theme among the pool; an n-gram can be of several themes."""
    rows = top(polarity, pool, highest).select("ngram", "mean_score", F.explode(X.themes(F.col("ngram"), keywords)).alias("theme"))
    order = F.desc("mean_score") if highest else F.asc("mean_score")
    w = Window.partitionBy("theme").orderBy(order, "ngram")
    ranked = rows.filter(F.col("theme") != X.OTHER).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("ngram", F.substring("ngram", 1, 20))


def success_rate(df: DataFrame, status: str = "status", good: str = "success") -> DataFrame:
    return df.agg(F.count_if(F.col(status) == good).alias("ok"), F.count("*").alias("n")).withColumn("pct", 100.0 * F.col("ok") / F.nullif("n", F.lit(0)))
