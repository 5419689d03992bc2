"""Sinks: JSON, CSV, anti-join inserts, upserts, lexicons, one-row statistics, checkpoints of processed ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.dedup import first_of
from ..operators.keys import even_parts
from ..operators.reports import first_alphabetically


def json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _existing(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def insert_new(df: DataFrame, path: str, keys: list[str], order: list) -> None:
    """Append the rows whose key the table lacks; running it twice adds nothing."""
    have = _existing(df, path)
    rows = first_of(df, keys, order) if have is None else relational.new_rows(df, have, keys, order)
    rows.write.mode("append").parquet(path)


def upsert_into(df: DataFrame, path: str, new_path: str, keys: list[str], order: list) -> DataFrame:
    """The merged table, written to a new folder (a table can't be overwritten while it is read)."""
    have = _existing(df, path)
    out = first_of(df, keys, order) if have is None else relational.upsert(have, df, keys, order)
    out.write.mode("errorifexists").parquet(new_path)
    return df.sparkSession.read.schema(df.schema).parquet(new_path)


def jdbc(df: DataFrame, url: str, table: str, page: int = 1000, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=page, **options).mode("append").save()


def lexicon(polarity: DataFrame, stance: str, path: str, k: int = 100) -> None:
    """The first k n-grams of a stance in alphabetical order, one a line."""
    first_alphabetically(polarity, stance, k).coalesce(1).write.mode("errorifexists").text(path)


def statistics(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    df.limit(1).coalesce(1).write.mode("errorifexists").json(path)


def pending(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key isn't among the processed ones."""
    done = _existing(df.select(key), path)
    return df if done is None else df.join(done, key, "left_anti")


def mark_done(df: DataFrame, path: str, key: str) -> None:
    df.select(key).distinct().filter(F.col(key).isNotNull()).write.mode("append").parquet(path)


def append_one(spark: SparkSession, path: str, schema: str, **values) -> None:
    """One row, committed on its own."""
    spark.createDataFrame([values], schema).write.mode("append").parquet(path)


def predictions(scored: DataFrame, path: str, label: str = "label", proba: str = "proba") -> None:
    """Labels and probabilities, from which curves are drawn."""
    scored.select(label, proba).write.mode("errorifexists").parquet(path)


def shards(df: DataFrame, path: str, parts: int = 10, order: list | None = None) -> None:
    """A fixed number of shards, as folders part=1 and so on, of sizes that differ by one row at most."""
    even_parts(df, order or df.columns, parts).write.mode("errorifexists").partitionBy("part").parquet(path)
