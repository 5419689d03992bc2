"""Readers of the raw files. Schemas are always given: an always-empty source would be inferred as an array of strings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates as D
from ..functions.cleansing import clean
from ..operators.dedup import first_of, within_file
from ..operators.keys import source_of_link

# The contents that the cleansers keep are longer than this.
MIN_NEWS, MIN_MINUTES, MIN_BOND = 10, 50, 20


NEWS_SOURCES = ("yonhap", "edaily", "infomax")
#: Columns that a report's CSV file may have; a file with more is named among the broken ones.
WIDTH = 32


def file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0)


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def news_months(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Month files, each an object of article lists by source; names with `summary` are left out.

    file, source, position, and the article's fields.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", names).option("recursiveFileLookup", True).text(path)
    raw = raw.withColumn("file", file_name()).filter(~F.col("file").contains("summary"))
    rows = raw.select("file", F.explode(F.from_json("value", S.NEWS_MONTH)).alias("key", "articles")).select("file", "key", F.posexplode("articles").alias("position", "a"))
    # the key names the source; an unknown key leaves it to the address
    source = F.coalesce(F.when(F.col("key").isin(*NEWS_SOURCES), F.col("key")), source_of_link(F.col("a.url")))
    return rows.select("file", source.alias("source"), "position", "a.title", "a.content", "a.date", "a.url", "a.keyword", "a.content_length")


def cleaned_news(raw: DataFrame) -> DataFrame:
    """Cleansed titles and contents; equal ones of a file and source once; contents of more than MIN_NEWS characters."""
    own = raw.withColumns({"title": clean(F.col("title"), "news"), "content": clean(F.col("content"), "news")})
    own = within_file(own, "file", "source", "title", "content", "position")
    return own.filter(F.length("content") > MIN_NEWS)


def news_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flat lists, whose address field is `link`; with lines an object a line instead of a list a file."""
    return spark.read.schema(S.NEWS_SAMPLE).option("multiLine", not lines).json(path)


def news_year(spark: SparkSession, folder: str, year: int, month: int | None = None, suffix: str = ".json", names: str = "*.json") -> DataFrame:
    """The files, or folders of files, whose name has the year, and after it the month if one is given."""
    found = f"*{year}*{month:02d}*{suffix}" if month else f"*{year}*{suffix}"
    return news_months(spark, f"{folder.rstrip('/')}/{found}", names)


def minutes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Content falls back to discussion and decision."""
    raw = _or_empty(lambda: spark.read.schema(S.MINUTES).option("multiLine", not lines).json(path), spark, S.MINUTES)
    parts = F.concat_ws("\n", F.coalesce("discussion", F.lit("")), F.coalesce("decision", F.lit("")))
    parts = F.when((F.coalesce("discussion", F.lit("")) == "") & (F.coalesce("decision", F.lit("")) == ""), "").otherwise(parts)
    return raw.withColumn("content", F.coalesce(F.nullif("content", F.lit("")), parts))


def cleaned(df: DataFrame, chain: str, minimum: int) -> DataFrame:
    own = df.withColumns({"title": clean(F.col("title"), chain), "content": clean(F.col("content"), chain)})
    return own.filter(F.length("content") > minimum)


def bonds(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _or_empty(lambda: spark.read.schema(S.BOND).option("multiLine", not lines).json(path), spark, S.BOND)


def bond_files(spark: SparkSession, folder: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Reports of small CSV files, sorted by date, and the files or rows that couldn't be used with the reason.

    Each file is read by its own header, so files of several layouts may lie in one folder. The header of a file may have
    `width` columns; one column more is read to tell.
    """
    cells = [f"c{k}" for k in range(width + 1)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("multiLine", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", "*.csv")
    raw = reader.option("recursiveFileLookup", True).csv(folder).select(F.col("_metadata.file_path").alias("path"), file_name().alias("file"), F.monotonically_increasing_id().alias("place"), F.array(*cells).alias("cells"))
    first = F.min(F.struct("place", "cells"))
    heads = raw.groupBy("path", "file").agg(first["place"].alias("head"), F.transform(first["cells"], lambda c: F.lower(F.trim(c))).alias("names"))
    required = F.array(*[F.lit(c) for c in ("date", "title", "content")])
    missing = F.array_except(required, F.array_compact("names"))
    problem = F.when(F.get("names", F.lit(width)).isNotNull(), F.lit(f"more than {width} columns"))
    problem = problem.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
    heads = heads.withColumn("error", problem)
    broken = heads.filter("error is not null").select("file", "error")
    rows = raw.join(heads.filter("error is null").select("path", "head", "names"), "path").filter("place <> head")
    value = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int"))
    link = F.coalesce(*[F.when(F.array_contains("names", n), value(n)) for n in ("link", "pdf_url")])
    own = rows.select(F.regexp_replace(value("date"), r"\.", "-").alias("date"), value("title").alias("title"), value("content").alias("content"), link.alias("link"), "file")
    empty = F.coalesce(F.trim("content"), F.lit("")).isin("", "nan")
    return own.filter(~empty).orderBy("date", "file"), broken.union(own.filter(empty).select("file", F.lit("no content").alias("error")))


def call_rates(spark: SparkSession, path: str) -> DataFrame:
    """The daily series with its published column names; one row for each date."""
    raw = spark.read.option("header", True).csv(path).withColumnsRenamed(S.RATE_COLUMNS)
    own = [F.col(c).try_cast("double").alias(c) if c != "date" else D.lenient(F.col("date")).alias("date") for c in S.RATE_COLUMNS.values() if c in raw.columns]
    rows = raw.select(*own).filter("date is not null")
    return first_of(rows, ["date"], [F.col(c).asc_nulls_last() for c in rows.columns if c != "date"] or ["date"])


def base_rates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """date and rate of `연도`, `날짜` and `기준금리` columns; dates are `N월 N일` or written in full, rates may have a `%`."""
    raw = spark.read.schema("`연도` string, `날짜` string, `기준금리` string").option("multiLine", not lines).json(path)
    day = F.coalesce(D.dashed(F.col("날짜")), D.month_day(F.col("연도"), F.col("날짜")))
    return raw.select(day.alias("date"), F.regexp_replace("기준금리", "%", "").try_cast("double").alias("rate"))


def dated_ngrams(spark: SparkSession, ngrams_path: str, labels_path: str) -> DataFrame:
    """Two objects keyed by date, joined: date, ngrams, label. A date without a label goes."""
    read = lambda p, kind: spark.read.option("wholetext", True).text(p).select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("date", "v"))
    return read(ngrams_path, "array<string>").withColumnRenamed("v", "ngrams").join(read(labels_path, "int").withColumnRenamed("v", "label"), "date")


def legacy_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One or many CSV files with a header; order is not implied by their names."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def query_rows(spark: SparkSession, query: str, **parameters) -> DataFrame:
    return spark.sql(query, args=parameters)


def jdbc_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def file_counts(spark: SparkSession, folders: dict[str, tuple[str, str]]) -> dict[str, int]:
    """Items of each source: ("list", path) counts the elements of JSON lists, ("lines", path) lines, ("files", glob) files; 0 for a missing one."""
    out = {}
    for name, (kind, path) in folders.items():
        try:
            # a schema of one absent field: items are counted, and no schema is inferred from the whole data before
            out[name] = spark.read.schema("`-` string").option("multiLine", kind == "list").json(path).count() if kind in ("list", "lines") else spark.read.format("binaryFile").load(path).select("path").count()
        except AnalysisException:
            out[name] = 0
    return out


def parsed_tokens(column: Column) -> Column:
    """Legacy `[('word', 'POS'), ...]` strings as an array of structs."""
    pairs = F.regexp_extract_all(column, F.lit(r"\('([^']*)',\s*'[^']*'\)"), F.lit(1))
    tags = F.regexp_extract_all(column, F.lit(r"\('[^']*',\s*'([^']*)'\)"), F.lit(1))
    return F.arrays_zip(pairs.alias("token"), tags.alias("pos"))
