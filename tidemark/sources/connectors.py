"""Saved replies of the collectors as tables.

Fetching is left to an outer process, which saves each reply; these readers hold what the collectors do with a reply:
unwrapping, date and keyword filters, duplicate addresses and titles, caps. A custom fetcher can be plugged in as a
Python data source (register_pages).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import cleansing, dates, numeric, text
from ..operators.dedup import first_of

#: The cut of contents in safe mode, of previews, and the shortest reply that counts.
SAFE_CUT, PREVIEW, SHORTEST_REPLY = 3000, 200, 200


def search_replies(replies: DataFrame, schema: str, items: str, day: str | None = None, date: str = "date") -> DataFrame:
    """JSONP replies (column body): the elements of a list inside, of one day if asked for."""
    body = F.coalesce(text.jsonp(F.col("body")), F.when(F.col("body").startswith("{"), F.col("body")))
    parsed = replies.filter(F.length("body") >= SHORTEST_REPLY).select(F.from_json(body, schema).alias("r"))
    rows = parsed.select(F.explode(f"r.{items}").alias("a")).select("a.*")
    return rows.filter(F.col(date).startswith(day)) if day else rows


def listing(rows: DataFrame, first: str, last: str, order: list, url: str = "url", title: str = "title", date: str = "date") -> DataFrame:
    """Rows of list pages: within the range of days, each address (https) and each title once; undated rows go."""
    own = rows.filter(F.col(date).isNotNull()).withColumn(url, cleansing.https(F.col(url)))
    day = dates.any_form(F.col(date))
    own = own.filter(day.isNull() | day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return first_of(first_of(own, [F.md5(url)], order), [F.md5(title)], order)


def keyword_filter(rows: DataFrame, keywords: list[str]) -> DataFrame:
    """In the title or in the content."""
    hit: Column = F.lit(False)
    for k in keywords:
        hit = hit | F.coalesce(F.col("title").contains(k), F.lit(False)) | F.coalesce(F.col("content").contains(k), F.lit(False))
    return rows.filter(hit)


def safe_cut(rows: DataFrame) -> DataFrame:
    """content_length is that before the cut."""
    return rows.withColumns({"content_length": F.length("content"), "content": F.substring("content", 1, SAFE_CUT)})


def article_body(rows: DataFrame, html: str = "html") -> DataFrame:
    return rows.withColumn("content", text.paragraphs(F.col(html)))


def minutes_sections(rows: DataFrame, generation: str = "current") -> DataFrame:
    """Title date, content, discussion and decision of minutes' text."""
    content, discussion, decision = text.sections(F.col("text"), generation)
    return rows.withColumns({"date": dates.from_title(F.col("title")), "content": content, "discussion": discussion, "decision": decision})


def base_rate_script(rows: DataFrame) -> DataFrame:
    """year, rate and change of the array that a page's script holds (column body)."""
    array = F.regexp_extract("body", r"(?s)=\s*(\[.*?\])\s*;", 1)
    parsed = F.from_json(text.js_object(array), "array<struct<date: string, rate: double>>")
    return rows.select(F.explode(parsed).alias("r")).select("r.*")


def capped(rows: DataFrame, limit: int, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


# Page size and limit of a search, the run of empty list pages that ends a listing, the body elements of
# an article in order of preference, the half years of the legacy collector, and the providers of the search service.
PAGE, MAX_RESULTS, EMPTY_PAGES = 50, 1000, 3
BODIES = (("article", "dic_area"), ("div", "articleBodyContents"))
HALF_YEARS = [(20140811, 20150131)] + [(y * 10000 + m, (y + (m > 700)) * 10000 + e) for y in range(2015, 2024) for m, e in ((201, 731), (801, 131))] + [(20240201, 20240831)]
SEARCH_KEYWORD = "금리"


def page_numbers(totals: DataFrame, total: str = "total", size: int = PAGE, limit: int = MAX_RESULTS) -> DataFrame:
    """A row for each page of a search's results, up to the limit."""
    pages = F.ceil(F.least(F.col(total), F.lit(limit)) / size).cast("int")
    return totals.withColumn("page", F.explode(F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))))


def to_refetch(replies: DataFrame, body: str = "body") -> DataFrame:
    """Replies that are missing or too short to be one: the fetcher asks for these again."""
    return replies.filter(F.coalesce(F.length(body), F.lit(0)) < SHORTEST_REPLY)


def until_empty(pages: DataFrame, listing_id: str, page: str, items: str, run: int = EMPTY_PAGES) -> DataFrame:
    """The pages of each listing before the first run of pages without items ends it."""
    w = Window.partitionBy(listing_id).orderBy(page)
    some = F.max((F.col(items) > 0).cast("int")).over(w.rowsBetween(1 - run, 0))
    marked = pages.withColumn("_ends", ((F.row_number().over(w) >= run) & (some == 0)).cast("int"))
    ended = F.max("_ends").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_ends", ended).filter("_ends = 0").drop("_ends")


def article_text(html: Column) -> Column:
    """The text of the first body element that has any; null without one."""
    out = []
    for tag, name in BODIES:
        body = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\bid=[\"']?{name}\b[^>]*>(.*?)</{tag}>", 1)
        body = F.regexp_replace(body, r"(?is)<(span)[^>]*end_photo_org[^>]*>.*?</\1>|<(div)[^>]*vod_player_wrap[^>]*>.*?</\2>", "")
        out.append(F.nullif(F.trim(F.regexp_replace(body, r"(?s)<[^>]*>", "")), F.lit("")))
    return F.coalesce(*out)


def search_documents(rows: DataFrame, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Documents of a search service under the names of the article table."""
    day = F.when(F.length("date") >= 8, F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2)))
    own = rows.select(
        F.trim("title").alias("title"), F.trim("content").alias("content"), day.alias("date"), "url", F.col("provider").alias("source"),
        F.col("byline").alias("author"), "category", F.lit(SEARCH_KEYWORD).alias("keyword"), F.length(F.coalesce("content", F.lit(""))).alias("content_length"),
    )
    return capped(own, limit, order or ["date", "url"]) if limit else own


def external(call: Callable[[str], str | None], failures: Accumulator) -> Callable[[Column], Column]:
    """A text service as a function of a column, a batch of texts at a time; a text on which it fails has null and is counted."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else call(text)
            except Exception:
                failures.add(1)
                return None

        return texts.map(one)

    return run


def script_items(rows: DataFrame, schema: str, name: str, body: str = "body") -> DataFrame:
    """The elements of an array that a page's script assigns to a name, in JSON or as an object literal."""
    array = F.regexp_extract(body, rf"(?s){name}\s*[=:]\s*(\[.*?\])\s*[;,}}]", 1)
    return rows.select(F.explode(F.from_json(text.js_object(array), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def half_years(first: str, last: str) -> list[tuple[int, int]]:
    """The legacy windows that lie within two dates."""
    low, high = int(first.replace("-", "")), int(last.replace("-", ""))
    return [(a, b) for a, b in HALF_YEARS if a >= low and b <= high]


def in_windows(rows: DataFrame, windows: list[tuple[int, int]], day: str = "day") -> DataFrame:
    """Rows whose day (yyyyMMdd as a number) is in one of the windows, with that window's first day."""
    first = F.lit(None).cast("int")
    for a, b in windows:
        first = F.when(F.col(day).between(a, b), F.lit(a)).otherwise(first)
    return rows.withColumn("window", first).filter("window is not null")


def pages_of_year(items: DataFrame, year: int, page: str = "page", body: str = "body") -> DataFrame:
    """The list pages that have items of a year, with their number."""
    found = dates.any_form(F.col(body))
    return items.filter(F.year(found) == year).groupBy(page).agg(F.count("*").alias("n"))


def rate_table(rows: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Rows of a rate page's table (cells array<string>: year, day, rate): the fallback where its script has no array."""
    year = F.get("cells", 0).try_cast("int")
    rate = F.regexp_replace(F.get("cells", 2), "%", "").try_cast("double")
    return rows.select(year.cast("string").alias("year"), F.get("cells", 1).alias("date"), rate.alias("rate")).filter(year.between(first_year, last_year) & rate.isNotNull())


def daily_rows(rows: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    """Rows of a paged series whose date is written in full and within the range, the first of each day."""
    gate = F.regexp_like(F.trim(date), F.lit(r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}$"))
    own = rows.filter(gate).withColumn(date, dates.lenient(F.col(date)))
    own = own.filter(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return first_of(own, [date], [F.col(c).asc_nulls_last() for c in own.columns if c != date] or [date])


def unseen_reports(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Reports whose md5 of title, company and date isn't among the processed ones, each once."""
    keyed = rows.withColumn("report_id", numeric.md5_key(F.col("title"), F.col("company"), F.col("date")))
    return first_of(keyed, ["report_id"], ["title", "company", "date"]).join(done.select("report_id").distinct(), "report_id", "left_anti")


def crawl_all(spark: SparkSession, name: str, first: str, last: str, sources: dict[str, Callable[[str], Iterator[tuple]]], schema: str) -> DataFrame:
    """Every source for every day of a range: a partition each, so days are fetched side by side. Adds source and day."""
    days = [str(r[0]) for r in spark.sql("SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE)))", args={"a": first, "b": last}).collect()]

    def fetch(key: str) -> Iterator[tuple]:
        source, day = key.split("|")
        for row in sources[source](day):
            yield (source, day, *row)

    register_pages(spark, name, [f"{s}|{d}" for s in sources for d in days], fetch, f"source string, day string, {schema}")
    return spark.read.format(name).load()


class _Page(InputPartition):
    def __init__(self, key: str):
        super().__init__(key)
        self.key = key


def register_pages(spark: SparkSession, name: str, keys: list[str], fetch: Callable[[str], Iterator[tuple]], schema: str) -> None:
    """A data source of that name: one partition for each key, whose rows fetch(key) gives."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Page(k) for k in keys]

        def read(self, partition):
            yield from fetch(partition.key)

    def label(cls):
        return name

    source = type("Pages", (DataSource,), {"name": classmethod(label), "schema": lambda self: schema, "reader": lambda self, schema: Reader()})
    spark.dataSource.register(source)
