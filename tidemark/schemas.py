"""Schemas of the engine's tables, and the constraints that a store would enforce, as checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLE = "title string, content string, date string, url string, source string, keyword string, content_length long"
NEWS_MONTH = f"map<string, array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in ARTICLE.split(','))}>>>"
NEWS_SAMPLE = "date string, title string, content string, link string, author string, keyword string, source string, source_section string, content_length double, relevance_score double"
MINUTES = "title string, date string, year string, content string, discussion string, decision string, pdf_url string, pdf_pages int, status string, error string"
BOND = "date string, title string, content string, link string"
CALL_RATE = "date date, call_rate double, cd_91d double, ktb_3y double, ktb_5y double, corp_3y_aa double"
BASE_RATE = "year string, date string, rate string, change string, origin string"
CORPUS = "pk string, date date, title string, content string, label int"
SENTENCES = "pk string, date date, label int, sentence string"
SENTENCE_NGRAMS = "sentence_id long, pk string, date date, label int, ngrams array<string>, sentence string"
POLARITY = "ngram string, mean_score double, std_score double, num_iterations int"

# The source digits of surrogate keys, and the columns of the daily series as published.
SOURCE_CODES = {"yonhap": "1", "edaily": "2", "infomax": "3", "bond": "4", "mpb": "5"}
RATE_COLUMNS = {"날짜": "date", "콜금리": "call_rate", "CD(91일)": "cd_91d", "국고채(3년)": "ktb_3y", "국고채(5년)": "ktb_5y", "회사채(3년,AA-)": "corp_3y_aa"}


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_parents(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent row."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def required(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which all of the columns, which must exist, have a value."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    out = df
    for c in columns:
        out = out.filter(F.col(c).isNotNull())
    return out
