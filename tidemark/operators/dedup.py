"""Deduplication with an explicit order, so that results don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(keys: list) -> Column:
    """A 256-bit digest of values; lengths and a mark for null keep different lists apart."""
    parts = []
    for k in keys:
        text = (F.col(k) if isinstance(k, str) else k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order.

    Keys travel and are compared as a 256-bit digest, so texts are neither moved nor sorted as keys.
    """
    w = Window.partitionBy(digest(keys)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def within_file(df: DataFrame, file: str, source: str, title: str, content: str, position: str) -> DataFrame:
    """Equal title and content, joined by `_`, within one file and source; copies in other files stay."""
    return first_of(df, [file, source, F.concat(title, F.lit("_"), content)], [position])


def by_url(df: DataFrame, order: list, source: str = "source", url: str = "url") -> DataFrame:
    """One row for each address of a source; rows without an address go."""
    return first_of(df.filter(F.coalesce(url, F.lit("")) != ""), [source, url], order)


def flag_duplicates(df: DataFrame, keys: list, name: str = "duplicated") -> DataFrame:
    """Every row of a key that occurs more than once is flagged."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(counts, on).select(*df.columns, (F.col("_n") > 1).alias(name))


def duplicate_ids(df: DataFrame, key: Column | str, row_id: str) -> DataFrame:
    """key, id, n of every row whose key occurs more than once: long form, since a key may have any number of rows."""
    key = F.col(key) if isinstance(key, str) else key
    rows = df.select(key.alias("key"), F.col(row_id).alias("id"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, "key").select("key", "id", "n")


def hashed(df: DataFrame, column: str, order: list) -> DataFrame:
    """The first row of each md5 of a column; nulls stay."""
    keyed = df.withColumn("_md5", F.md5(column))
    return first_of(keyed.filter(F.col(column).isNotNull()), ["_md5"], order).unionByName(keyed.filter(F.col(column).isNull())).drop("_md5")
