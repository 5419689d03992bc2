"""Relational pieces: the training view, rate windows, anti-join inserts, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import signed_points
from .dedup import first_of


def training_view(texts: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Labelled texts with the title and date of the row that they come from, in whichever parent table that is.

    texts: id, source_table, source_id, label and more; parents: id, title, date.
    """
    out = texts.filter("label is not null")
    title = date = None
    for name, parent in parents.items():
        own = parent.select(F.col("id").alias(f"_{name}"), F.col("title").alias(f"_{name}_title"), F.col("date").alias(f"_{name}_date"))
        out = out.join(own, (F.col("source_table") == name) & (F.col("source_id") == F.col(f"_{name}")), "left")
        is_own = F.col("source_table") == name
        title = F.when(is_own, F.col(f"_{name}_title")) if title is None else title.when(is_own, F.col(f"_{name}_title"))
        date = F.when(is_own, F.col(f"_{name}_date")) if date is None else date.when(is_own, F.col(f"_{name}_date"))
    return out.select(*texts.columns, title.alias("title"), date.alias("source_date"))


def latest_rates(rates: DataFrame) -> DataFrame:
    """Each rate with the one before it. One row for each day: the window over one partition is bounded by the calendar."""
    return rates.withColumn("previous_rate", F.lag("rate").over(Window.orderBy("date")))


def rate_changes(rates: DataFrame) -> DataFrame:
    """First differences, their direction, and the change as text."""
    change = F.col("rate") - F.lag("rate").over(Window.orderBy("date"))
    out = rates.withColumn("change", change)
    sign = F.when(F.col("change") > 0, "↑").when(F.col("change") < 0, "↓").otherwise("-")
    return out.withColumns({"direction": sign, "change_text": signed_points(F.col("change"))})


def date_gaps(rates: DataFrame, days: int = 7, first: int | None = 5) -> DataFrame:
    """Gaps of more than so many days between consecutive dates."""
    w = Window.orderBy("date")
    out = rates.select("date").distinct().withColumn("previous", F.lag("date").over(w))
    out = out.withColumn("gap", F.date_diff("date", "previous")).filter(F.col("gap") > days).orderBy("date")
    return out.limit(first) if first else out


def new_rows(source: DataFrame, target: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The source's rows whose key the target lacks, one for each key."""
    return first_of(source, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The target with the source's rows in place of those of equal keys, and new keys added; the last row of a key wins."""
    columns = target.columns
    own = first_of(source, keys, order).select(*columns)
    return target.join(own.select(*keys), keys, "left_anti").select(*columns).unionByName(own)


def register_sql_functions(spark: SparkSession, predictions: str = "predictions") -> None:
    """prediction_accuracy(start, end), a table function, over a view of predictions."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION prediction_accuracy(start_date DATE, end_date DATE)
        RETURNS TABLE (total_predictions BIGINT, correct_predictions BIGINT, accuracy DECIMAL(10, 2))
        RETURN SELECT count(*), count_if(predicted_direction = actual_direction),
                      round(CAST(count_if(predicted_direction = actual_direction) AS DECIMAL(20, 0)) / nullif(count(*), 0) * 100, 2)
               FROM {predictions}
               WHERE prediction_date BETWEEN start_date AND end_date AND actual_direction IS NOT NULL""")


def register_sql_functions_of_text(spark: SparkSession) -> None:
    """text_trigrams(t) and trigram_similarity(a, b)."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION text_trigrams(t STRING) RETURNS ARRAY<STRING>
        RETURN array_distinct(flatten(transform(filter(split(lower(t), '(?U)[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''),
                                                w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION trigram_similarity(a STRING, b STRING) RETURNS DOUBLE
        RETURN coalesce(size(array_intersect(text_trigrams(a), text_trigrams(b))) / nullif(size(array_union(text_trigrams(a), text_trigrams(b))), 0), 0D)""")


def row_counts(spark: SparkSession, tables: list[str]) -> dict[str, int]:
    """Rows of each table; 0 for one that doesn't exist."""
    return {t: spark.table(t).count() if spark.catalog.tableExists(t) else 0 for t in tables}


def differs(column: Column, value) -> Column:
    """Inequality that keeps nulls."""
    return ~column.eqNullSafe(F.lit(value))


def fill_at(df: DataFrame, row_id: str, rows: list, columns: list[str], value: str = "fillnull") -> DataFrame:
    """Nulls of some rows, named by their ids, get a value."""
    here = F.col(row_id).isin(*rows)
    return df.withColumns({c: F.when(here, F.coalesce(c, F.lit(value))).otherwise(F.col(c)) for c in columns})


def months_of_both(labels: DataFrame, documents: DataFrame, month: str = "month") -> DataFrame:
    """Monthly counts of labels with those of documents, for months that have both."""
    return labels.join(documents, month)
