"""More registered queries: readers and sinks as round trips through the shared folder, streams, and small operators.

Each writes a whole table in the form that a reader expects, or through a sink, and reads it back; the SQL states what
must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleansing, dates, numeric
from ..functions import text as X
from ..operators import dedup, evaluate, keys, relational, reports
from ..session import shared_folder
from ..sources import connectors, readers, writers
from ..sources.buckets import Buckets
from ..streaming import crawl, ingest, stateful
from .catalogue import _BAGS, _RATES, _SCORED, _SPLITS, _TOKENS, _WHITE, QUERIES, SQL, _trigrams, query, rates, rounded, scored, table

__all__ = ["QUERIES", "SQL"]
_CELLS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn"

# --- readers --------------------------------------------------------------------------------------------------------


def written_months(spark, sf_dir) -> str:
    """Documents as month files: an object of lists by source each, a thousand documents a file."""
    path = shared_folder(spark, "months")
    article = F.struct(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), F.lit("2024-01-05").alias("date"), F.concat(F.lit("http://www.edaily.co.kr/"), "doc_id").alias("url"))
    key = F.when(F.col("doc_id") % 3 == 0, "yonhap").when(F.col("doc_id") % 3 == 1, "infomax").otherwise("unknown")
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") / 1000).cast("long").alias("month"), key.alias("key"), article.alias("a"))
    lists = own.groupBy("month", "key").agg(F.collect_list("a").alias("articles"))
    files = lists.groupBy("month").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "articles")))).alias("value"))
    files.repartition("month").write.partitionBy("month").option("lineSep", "\n").text(f"{path}/txt")
    # the names of month files end in .json
    return f"{path}/txt"


_KEYED = "CASE doc_id % 3 WHEN 0 THEN 'yonhap' WHEN 1 THEN 'infomax' ELSE 'edaily' END"


@query(f"SELECT doc_id, {_KEYED} AS source, md5(text) AS digest FROM documents")
def read_news_months(spark, sf_dir):
    """A source key that isn't known leaves the source to the address."""
    raw = readers.news_months(spark, written_months(spark, sf_dir), "*.txt")
    return raw.select(F.col("title").cast("long").alias("doc_id"), "source", F.md5("content").alias("digest"))


@query(f"SELECT scan, doc_id, {_KEYED} AS source FROM documents, (SELECT unnest(['year', 'month']) AS scan) WHERE doc_id % 4 < 2 AND (scan = 'year' OR doc_id % 4 = 1 AND doc_id // 4 % 12 = 2)")
def read_news_year(spark, sf_dir):
    """Month files of two years, a thousand documents a file: those of one year, and those of one of its months."""
    path = shared_folder(spark, "years")
    article = F.struct(F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("content"), F.lit("2024-01-05").alias("date"), F.concat(F.lit("http://www.edaily.co.kr/"), "doc_id").alias("url"))
    key = F.when(F.col("doc_id") % 3 == 0, "yonhap").when(F.col("doc_id") % 3 == 1, "infomax").otherwise("unknown")
    month = F.when(F.col("doc_id") % 4 == 1, (F.floor(F.col("doc_id") / 4) % 12) + 1).otherwise(1).cast("int")
    year = F.when(F.col("doc_id") % 4 < 2, "2023").otherwise("2024")
    own = table(spark, sf_dir, "documents").select(F.concat(year, F.lit("_"), F.format_string("%02d", month)).alias("file"), F.floor(F.col("doc_id") / 4000).alias("part"), key.alias("key"), article.alias("a"))
    lists = own.groupBy("file", "part", "key").agg(F.collect_list("a").alias("articles"))
    files = lists.groupBy("file", "part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "articles")))).alias("value"))
    files.repartition("file", "part").write.partitionBy("file", "part").text(path)
    year_rows, month_rows = (readers.news_year(spark, path, 2023, m, "", "*.txt") for m in (None, 3))
    one = lambda df, scan: df.select(F.lit(scan).alias("scan"), F.col("title").cast("long").alias("doc_id"), "source")
    return one(year_rows, "year").union(one(month_rows, "month"))


@query("""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || lang ELSE '' END) AS digest FROM documents""")
def read_minutes(spark, sf_dir):
    """Contents, or discussions and decisions in their place, or neither."""
    path, kind = shared_folder(spark, "minutes"), F.col("doc_id") % 3
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.when(kind == 0, F.col("text")).when(kind == 1, "").alias("content"), F.when(kind == 1, F.col("text")).alias("discussion"), F.when(kind == 1, F.col("lang")).alias("decision"))
    writers.json(own, path)
    return readers.minutes(spark, path, lines=True).select(F.col("title").cast("long").alias("doc_id"), F.md5("content").alias("digest"))


@query("SELECT 0 AS layout, CAST(n_nationkey AS BIGINT) AS id, '2024-01-02' AS date, n_name AS content, 'l' || n_nationkey AS link FROM nation UNION ALL SELECT 1, r_regionkey, '2024-01-01', r_name, 'p' || r_regionkey FROM region")
def read_bond_files(spark, sf_dir):
    """One CSV file for each row, in two layouts, in one folder."""
    path = shared_folder(spark, "bonds")
    file = lambda df, i: df.withColumn("file", F.col(i)).repartition("file").write.mode("append").partitionBy("layout", "file").option("header", True).option("escape", '"').csv(path)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    file(nation.select(F.lit("0").alias("layout"), F.lit("2024.01.02").alias("Date"), F.col("n_nationkey").alias("Title"), F.col("n_name").alias("Content"), F.concat(F.lit("l"), "n_nationkey").alias("Link")), "Title")
    file(region.select(F.lit("1").alias("layout"), F.lit("2024.01.01").alias("Date"), F.col("r_regionkey").alias("Title"), F.lit("ACME").alias("Company"), F.col("r_name").alias("Content"), F.concat(F.lit("p"), "r_regionkey").alias("PDF_URL")), "Title")
    good, _ = readers.bond_files(spark, path)
    return good.select(F.when(F.col("link").startswith("p"), 1).otherwise(0).alias("layout"), F.col("title").cast("long").alias("id"), "date", "content", "link")


@query("SELECT p_partkey AS id, p_name AS content FROM part")
def read_bonds(spark, sf_dir):
    path = shared_folder(spark, "bonds")
    writers.json(table(spark, sf_dir, "part").select(F.lit("2024-01-02").alias("date"), F.col("p_partkey").cast("string").alias("title"), F.col("p_name").alias("content")), path)
    both = readers.bonds(spark, path, lines=True).unionByName(readers.bonds(spark, f"{path}-missing"))
    return both.select(F.col("title").cast("long").alias("id"), "content")


@query(f"WITH {_RATES} SELECT date, round(rate, 6) AS call_rate, round(rate * 2, 6) AS cd_91d FROM rates")
def read_call_rates(spark, sf_dir):
    """The published column names, every third day twice."""
    path = shared_folder(spark, "rates")
    own = rates(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("날짜"), F.col("rate").alias("콜금리"), (F.col("rate") * 2).alias("CD(91일)"))
    writers.csv(own.union(own.filter(F.day("날짜") % 3 == 0)), path)
    return rounded(readers.call_rates(spark, path), "call_rate", "cd_91d")


@query(f"WITH {_RATES} SELECT date, round(rate * 100, 2) AS rate FROM rates")
def read_base_rates(spark, sf_dir):
    """Dates as `N월 N일` of a year, and written in full; rates with a percent sign."""
    path = shared_folder(spark, "base")
    day = F.when(F.day("date") % 2 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.concat(F.month("date"), F.lit("월 "), F.day("date"), F.lit("일")))
    own = rates(spark, sf_dir).select(F.year("date").cast("string").alias("연도"), day.alias("날짜"), F.format_string("%.2f%%", F.col("rate") * 100).alias("기준금리"))
    writers.json(own, path)
    return rounded(readers.base_rates(spark, path, lines=True), "rate")


@query("SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, count(*) AS n, count(*) % 2 AS label FROM orders GROUP BY 1 HAVING day(any_value(o_orderdate)) > 2")
def read_dated_ngrams(spark, sf_dir):
    """Objects keyed by date, a file for each month; dates without a label go."""
    path = shared_folder(spark, "dated")
    own = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("v"))
    month = F.substring("date", 1, 7).alias("month")  # 31 dates at most
    one = lambda df, name: df.groupBy(month).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("date", "v")))).alias("value")).repartition("month").write.partitionBy("month").text(f"{path}/{name}")
    one(own, "ngrams")
    one(own.filter(F.day("date") > 2).withColumn("v", F.size("v") % 2), "labels")
    return readers.dated_ngrams(spark, f"{path}/ngrams", f"{path}/labels").select("date", F.size("ngrams").cast("long").alias("n"), F.col("label").cast("long").alias("label"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def read_legacy_csv(spark, sf_dir):
    path = shared_folder(spark, "legacy")
    writers.csv(table(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("text")), path)
    return readers.legacy_csv(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.unbase64("text")).alias("digest"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, md5(text) AS digest FROM conversations")
def read_news_list(spark, sf_dir):
    """Flat lists, whose address field is `link`."""
    path = shared_folder(spark, "list")
    own = table(spark, sf_dir, "conversations").select(F.col("role").alias("title"), F.col("text").alias("content"), F.concat_ws("/", "conv_id", "turn").alias("link"))
    writers.json(own, path)
    parts = F.split("link", "/")
    return readers.news_list(spark, path, lines=True).select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), F.md5("content").alias("digest"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 100 AND 1000")
def read_query_rows(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("tidemark_documents")
    return readers.query_rows(spark, "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM tidemark_documents WHERE length(text) BETWEEN :low AND :high", low=100, high=1000)


@query("SELECT 'list' AS name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'missing', 0")
def read_file_counts(spark, sf_dir):
    path = shared_folder(spark, "counted")
    writers.json(table(spark, sf_dir, "orders").select("o_orderkey"), path)
    counts = readers.file_counts(spark, {"list": ("lines", path), "missing": ("list", f"{path}-missing")})
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@query(f"WITH tok AS (SELECT doc_id, {_TOKENS} AS toks FROM documents) SELECT doc_id, len(toks) AS n FROM tok")
def read_parsed_tokens(spark, sf_dir):
    """Tokens written as lists of pairs."""
    marks = F.transform(X.content_words(F.translate("text", "'", "’")), lambda t: F.concat(F.lit("('"), t, F.lit("', 'NNG')")))
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(marks, ", "), F.lit("]")).alias("v"))
    return own.select("doc_id", F.size(readers.parsed_tokens(F.col("v"))).cast("long").alias("n"))


# --- sinks and streams ----------------------------------------------------------------------------------------------


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def sink_insert_new(spark, sf_dir):
    """The table, and the table again: what is there already isn't added."""
    path = shared_folder(spark, "inserted")
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    for _ in range(2):
        writers.insert_new(own, path, ["o_custkey"], ["o_orderkey"])
    return spark.read.parquet(path)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'F'")
def sink_upsert(spark, sf_dir):
    path = shared_folder(spark, "merged")
    orders = table(spark, sf_dir, "orders")
    writers.insert_new(orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("version")), f"{path}/a", ["o_orderkey"], ["version"])
    return writers.upsert_into(orders.filter("o_totalprice > 150000").select("o_orderkey", F.lit("new").alias("version")), f"{path}/a", f"{path}/b", ["o_orderkey"], ["version"])


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def sink_json(spark, sf_dir):
    path = shared_folder(spark, "json")
    writers.json(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return rounded(spark.read.schema("event_id long, event_type string, value double").json(path), "value")


@query("SELECT p_partkey, p_name FROM part")
def sink_csv(spark, sf_dir):
    path = shared_folder(spark, "csv")
    writers.csv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path)
    return readers.legacy_csv(spark, path, "p_partkey long, p_name string")


@query("SELECT count(*) AS n, max(o_orderkey) AS last FROM orders")
def sink_statistics(spark, sf_dir):
    path = shared_folder(spark, "statistics")
    writers.statistics(table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")), path)
    return spark.read.schema("n long, last long").json(path)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sink_pending(spark, sf_dir):
    path = shared_folder(spark, "done")
    writers.mark_done(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), path, "c_custkey")
    return writers.pending(table(spark, sf_dir, "customer"), path, "c_custkey").select("c_custkey")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 99, 'one'")
def sink_append_one(spark, sf_dir):
    path = shared_folder(spark, "appended")
    own = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    own.write.parquet(path)
    writers.append_one(spark, path, "r_regionkey long, r_name string", r_regionkey=99, r_name="one")
    return spark.read.parquet(path)


@query("SELECT label, round(proba, 6) AS proba, count(*) AS n FROM (SELECT CAST(l_linenumber % 2 AS BIGINT) AS label, l_discount AS proba FROM lineitem) GROUP BY 1, 2")
def sink_predictions(spark, sf_dir):
    path = shared_folder(spark, "predictions")
    writers.predictions(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).cast("long").alias("label"), F.col("l_discount").alias("proba")), path)
    return spark.read.parquet(path).groupBy("label", F.round("proba", 6).alias("proba")).agg(F.count("*").alias("n"))


@query("SELECT part, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, ntile(10) OVER (ORDER BY doc_id) AS part FROM documents) GROUP BY 1")
def sink_shards(spark, sf_dir):
    """Ten shards of equal size."""
    path = shared_folder(spark, "shards")
    writers.shards(table(spark, sf_dir, "documents").select("doc_id"), path, 10, ["doc_id"])
    return spark.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def streamed_orders(spark, sf_dir) -> DataFrame:
    path = shared_folder(spark, "stream")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("o_orderstatus").alias("source"), F.col("o_custkey").cast("string").alias("url"))
    own.repartition(4).write.json(path)
    return ingest.articles(spark, path, files_per_trigger=2)


@query("SELECT o_custkey AS url, min(o_orderkey) AS n FROM (SELECT CAST(o_custkey AS BIGINT) AS o_custkey, 1 AS o_orderkey FROM orders) GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Micro-batches into a table without duplicates; a second run over the same files adds nothing."""
    path = shared_folder(spark, "ingested")
    stream = streamed_orders(spark, sf_dir)
    for run in ("a", "b"):
        ingest.ingest(stream, f"{path}/t", f"{path}/checkpoint-{run}", ["url"], ["title"]).awaitTermination()
    return spark.read.parquet(f"{path}/t").groupBy(F.col("url").cast("long").alias("url")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY ALL")
def stream_month_counts(spark, sf_dir):
    path = shared_folder(spark, "counts")
    stream = streamed_orders(spark, sf_dir).select(F.col("date").cast("timestamp").alias("ts"), "source")
    writer = ingest.monthly_counts(stream, "ts").writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint")
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/t")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/t")


# --- small operators ------------------------------------------------------------------------------------------------


@query(f"WITH {_BAGS}, {_SPLITS}, {_SCORED}, c AS (SELECT iter, {_CELLS} FROM preds GROUP BY 1), f AS (SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, count(*) AS n FROM f")
def split_f1_summary(spark, sf_dir):
    """The mean F1 of the repeated splits and its population deviation."""
    return rounded(evaluate.f1_summary(evaluate.metrics(scored(spark, sf_dir), ["iter"])), "mean_f1", "std_f1")


@query("""WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS labels FROM orders GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS documents FROM lineitem GROUP BY 1)
 SELECT month, labels, documents FROM a JOIN b USING (month)""")
def months_of_labels_and_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("labels"))
    documents = reports.monthly(table(spark, sf_dir, "lineitem"), "l_shipdate").withColumnRenamed("n", "documents")
    return relational.months_of_both(labels, documents)


@query("SELECT o_orderpriority, count(*) AS n, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INT) AS place FROM orders GROUP BY 1")
def counts_by_index(spark, sf_dir):
    return reports.counts_by_index(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def drop_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").na.drop(subset=["quality"]).select("doc_id", "quality")


@query("SELECT d.doc_id, CASE WHEN d.doc_id IN (3, 50, 100) THEN coalesce(CAST(l.quality AS VARCHAR), 'fillnull') ELSE CAST(l.quality AS VARCHAR) END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_at_rows(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return relational.fill_at(own, "doc_id", [3, 50, 100], ["quality"])


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def differs_or_null(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.filter(relational.differs(F.col("quality"), 1)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '5')")
def key_prefix(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey").cast("string").startswith("5")).select("o_orderkey")


@query("SELECT doc_id, ntile(10) OVER (ORDER BY source, doc_id) AS part FROM documents")
def even_parts(spark, sf_dir):
    return keys.even_parts(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "part")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def json_containment(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(X.contains_json(F.col("props"), "$.k", 7)).select("event_id")


@query(f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS toks FROM documents)
SELECT doc_id, len(toks) AS morphs, len(list_filter(toks, lambda t: NOT regexp_matches(t, '^[0-9]+$'))) AS content, len(list_filter(toks, lambda t: regexp_matches(t, 'ing$') AND NOT regexp_matches(t, '^[0-9]+$'))) AS verbs FROM tok""")
def pos_filter(spark, sf_dir):
    """Parts of speech by rules: numbers are dropped, words in -ing are verbs."""
    tag = X.rule_tokens([("^[0-9]+$", "SN"), ("ing$", "VV")])
    n = lambda c: F.size(c).cast("long")
    verbs = X.content_words(F.col("text"), X.rule_tokens([("^[0-9]+$", "SN"), ("ing$", "VV")]), pos=("VV",))
    return table(spark, sf_dir, "documents").select("doc_id", n(X.morphs(F.col("text"))).alias("morphs"), n(X.content_words(X.morphs_joined(F.col("text")), tag)).alias("content"), n(verbs).alias("verbs"))


@query("""SELECT doc_id, md5(substr(text, 1, 200)) AS preview, md5(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END) AS short, coalesce(regexp_matches(text, 'th|qu'), false) AS mentioned,
 md5(substr(text, 1, 3000)) AS cut, length(text) AS content_length, regexp_replace(source || '/' || lang || '?', '[\\/*?:"<>|]', '', 'g') AS file_name, lang || '://x/' || doc_id AS absolute FROM documents""")
def text_functions(spark, sf_dir):
    own = table(spark, sf_dir, "documents").withColumn("content", F.col("text"))
    own = connectors.safe_cut(own)
    link = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("://x/"), "doc_id")).otherwise(F.concat(F.lit("/"), "doc_id"))
    full = F.when(F.col("doc_id") % 2 == 0, cleansing.absolute(link, "y://z")).otherwise(F.concat("lang", F.substring(cleansing.absolute(link, "y://x"), 2, 1000)))
    return own.select(
        "doc_id", F.md5(X.preview(F.col("text"))).alias("preview"), F.md5(X.shorten(F.col("text"), 50)).alias("short"), X.mentions(F.col("text"), "th|qu").alias("mentioned"),
        F.md5("content").alias("cut"), F.col("content_length").cast("long").alias("content_length"), cleansing.safe_file_name(F.concat("source", F.lit("/"), "lang", F.lit("?"))).alias("file_name"), full.alias("absolute"),
    )


_STRIPPED = f"regexp_replace(coalesce(text, ''), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def minutes_of(spark, sf_dir) -> DataFrame:
    """Every document's text as the discussion of minutes."""
    text = F.concat(F.lit("위원 토의내용 "), F.coalesce("text", F.lit("")), F.lit(" 심의결과 "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.lit("회의 2024.08.29").alias("title"))


def digests(own: DataFrame) -> DataFrame:
    return own.select("doc_id", *[F.md5(c).alias(c) for c in ("content", "discussion", "decision")])


@query(f"""WITH m AS (SELECT doc_id, '위원 토의내용 ' || coalesce(text, '') || ' 심의결과 ' || source AS whole, substr({_STRIPPED}, 1, 5000) AS talk, source FROM documents)
 SELECT doc_id, md5(content) AS content, md5(discussion) AS discussion, md5(decision) AS decision FROM (SELECT doc_id, substr(whole, 1, 10000) AS content, nullif(talk, '') AS discussion, source AS decision FROM m)""")
def minutes_sections(spark, sf_dir):
    return digests(connectors.minutes_sections(minutes_of(spark, sf_dir)))


@query(f"""WITH m AS (SELECT doc_id, '위원 토의내용 ' || coalesce(text, '') || ' 심의결과 ' || source AS whole, {_STRIPPED} AS talk, source FROM documents)
 SELECT 'paired' AS generation, doc_id, md5(whole) AS content, md5(nullif(substr(regexp_replace(talk, '[{_WHITE}]+', ' ', 'g'), 1, 5000), '')) AS discussion, md5(source) AS decision FROM m
 UNION ALL SELECT 'old', doc_id, md5(whole), md5(nullif(replace(talk, chr(10), ''), '')), md5(source) FROM m""")
def minutes_sections_old(spark, sf_dir):
    """The two older generations: white space collapsed, or line ends deleted and nothing cut."""
    own = minutes_of(spark, sf_dir)
    one = lambda g: digests(connectors.minutes_sections(own, g)).select(F.lit(g).alias("generation"), "*")
    return one("paired").union(one("old"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url, CAST(page_id % 50 AS VARCHAR) AS title, DATE '2024-01-01' + CAST(page_id % 60 AS INT) AS day FROM pages WHERE page_id % 11 <> 0),
 a AS (SELECT * FROM p WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-02-10'), b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id) AS m FROM b WHERE n = 1)
 SELECT page_id, url FROM c WHERE m = 1""")
def listing(spark, sf_dir):
    """Undated rows and days out of range go; each address and title once."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy.MM.dd")
    own = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 50).cast("string").alias("title"), F.when(F.col("page_id") % 11 != 0, day).alias("date"))
    return connectors.listing(own, "2024-01-05", "2024-02-10", ["page_id"]).select("page_id", "url")


@query("SELECT page_id, md5(url) AS title FROM pages WHERE length(html) >= 0 AND page_id % 4 <> 0")
def search_replies(spark, sf_dir):
    """Replies in a callback; those that are too short don't count."""
    item = F.to_json(F.struct(F.array(F.struct(F.col("page_id").cast("string").alias("date"), F.md5("url").alias("title"), F.repeat(F.lit("x"), 200).alias("filler"))).alias("r")))
    own = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 4 == 0, "cb()").otherwise(F.concat(F.lit("cb("), item, F.lit(");"))).alias("body"))
    return connectors.search_replies(own, "r array<struct<date: string, title: string>>", "r").select(F.col("date").cast("long").alias("page_id"), "title")


@query("""WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) % 3 AS items FROM conversations), m AS (SELECT *, row_number() OVER w AS n, max((items > 0)::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 e AS (SELECT *, max((n >= 3 AND filled = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ended FROM m) SELECT conv_id, turn, items FROM e WHERE ended = 0""")
def listing_until_empty(spark, sf_dir):
    """Conversations as listings, turns as their pages: a page has as many items as its length leaves, modulo 3."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 3).cast("long").alias("items"))
    return connectors.until_empty(own, "conv_id", "turn", "items").select("conv_id", "turn", "items")


@query("SELECT c_custkey, CAST(unnest(range(1, CAST(ceil(least(n, 1000) / 50.0) AS BIGINT) + 1)) AS INT) AS page FROM (SELECT c_custkey, c_custkey % 1200 AS n FROM customer)")
def search_pages(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1200).alias("total"))
    return connectors.page_numbers(own).select("c_custkey", "page")


@query("SELECT page_id, md5(url) AS body FROM pages")
def article_bodies(spark, sf_dir):
    """The preferred body element, and the older one where there is none."""
    new = F.concat(F.lit('<article class=x id="dic_area"><b>'), F.md5("url"), F.lit('</b><span class="end_photo_org">photo</span></article>'))
    old = F.concat(F.lit("<div id=articleBodyContents> "), F.md5("url"), F.lit("</div>"))
    own = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, new).otherwise(old).alias("html"))
    return own.select("page_id", connectors.article_text(F.col("html")).alias("body"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 20 YEAR AS x FROM orders)
 SELECT o_orderkey, CAST(CASE WHEN month(x) > 7 THEN year(x) * 10000 + 801 WHEN month(x) > 1 THEN year(x) * 10000 + 201 WHEN year(x) = 2015 THEN 20140811 ELSE year(x) * 10000 - 9199 END AS INT) AS window FROM d""")
def legacy_windows(spark, sf_dir):
    """The half years of the legacy collector; dates are moved into its range."""
    day = F.date_format(F.add_months("o_orderdate", 240), "yyyyMMdd").cast("int")
    own = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    return connectors.in_windows(own, connectors.half_years("2014-01-01", "2024-12-31")).select("o_orderkey", "window")


@query("SELECT o_custkey % 100 AS page, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1")
def pages_of_year(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("page"), F.concat(F.lit("minutes of "), F.date_format("o_orderdate", "yyyy.MM.dd")).alias("body"))
    return connectors.pages_of_year(own, 1997)


@query("SELECT CAST(l_shipdate AS DATE) AS date, min(l_discount) AS rate FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' GROUP BY 1")
def daily_series(spark, sf_dir):
    """Rows of a paged series: dates that aren't written in full go, each day once."""
    own = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy.MM.dd").alias("date"), F.col("l_discount").alias("rate"))
    own = own.union(own.withColumn("date", F.concat(F.lit("total "), "date")))
    return connectors.daily_rows(own, "1995-01-01", "1999-12-31")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def unseen_reports(spark, sf_dir):
    """Reports by md5 of title, company and date, without those that have been processed."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("title"), F.col("o_orderstatus").alias("company"), F.lit("d").alias("date"))
    done = own.filter("company = 'P'").select(numeric.md5_key(F.col("title"), F.col("company"), F.col("date")).alias("report_id"))
    return connectors.unseen_reports(own, done).groupBy(F.col("title").cast("long").alias("o_custkey")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%Y-%m-%d') AS date, md5(text) AS content, lang AS source, length(text) AS content_length FROM documents")
def search_documents(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyyMMdd")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), day.alias("date"), F.lit("u").alias("url"), F.col("lang").alias("provider"), F.lit("b").alias("byline"), F.lit("c").alias("category"))
    out = connectors.search_documents(own.withColumn("content", F.concat(F.lit(""), "content")))
    joined = out.select(F.col("title").cast("long").alias("doc_id"), "date", "source").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "date", F.md5("text").alias("content"), "source", F.length("text").cast("long").alias("content_length"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS year, CAST(n_nationkey / 4.0 AS DOUBLE) AS rate FROM nation WHERE n_nationkey BETWEEN 5 AND 20")
def rate_table(spark, sf_dir):
    cells = F.array(F.col("n_nationkey").cast("string"), F.lit("1월 2일"), F.format_string("%.2f%%", F.col("n_nationkey") / 4.0))
    own = table(spark, sf_dir, "nation").select(cells.alias("cells"))
    return connectors.rate_table(own, 5, 20).select(F.col("year").cast("long").alias("year"), "rate")


_TONGUE = "regexp_extract(coalesce(url, ''), '^https?://[^/]*/([a-z][a-z])/', 1)"


@query(f"""WITH p AS (SELECT {_TONGUE} AS source, strftime(DATE '2024-01-01' + CAST(page_id % 45 AS INT), '%Y-%m-%d') AS day, length(html) AS n FROM pages),
 s AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS source), d AS (SELECT strftime(unnest(range(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)), '%Y-%m-%d') AS day)
 SELECT source, day, count(n) AS replies, count(*) FILTER (n < 200) AS short FROM s CROSS JOIN d LEFT JOIN p USING (source, day) GROUP BY 1, 2""")
def crawl_all(spark, sf_dir):
    """Sources by language and day, asked for in two runs of which the second goes on where the first ended, and the pages that have been saved for each request."""
    path, name = shared_folder(spark, "crawl"), "tidemark_crawl"
    crawl.register(spark, name, lambda source, day: None, attempts=1)
    for last in ("2024-01-20", "2024-02-14"):
        crawl.collect(crawl.replies(spark, name, ["de", "en", "es", "fr"], "2024-01-01", last), f"{path}/t", f"{path}/checkpoint").awaitTermination()
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 45).cast("int")), "yyyy-MM-dd")
    saved = table(spark, sf_dir, "pages").select(F.regexp_extract(F.coalesce("url", F.lit("")), "^https?://[^/]*/([a-z][a-z])/", 1).alias("source"), day.alias("day"), F.col("html").alias("body"))
    counts = saved.groupBy("source", "day").agg(F.count("body").alias("replies"), F.count_if(F.length("body") < connectors.SHORTEST_REPLY).alias("short"))
    requests = spark.read.parquet(f"{path}/t").select("source", "day")
    return requests.join(counts, ["source", "day"], "left").select("source", "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("replies", "short")])


@query("SELECT o_custkey AS url, 1 AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY 1")
def stream_ingest_stateful(spark, sf_dir):
    """Keys in a state store: those that the table had before and those that have come are added once, over two runs."""
    path, stream = shared_folder(spark, "stateful"), streamed_orders(spark, sf_dir)
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("url"))
    for _ in range(2):
        stateful.ingest(stream, f"{path}/t", f"{path}/checkpoint", ["url"], ["title"], known=known).awaitTermination()
    return stateful.count_keys(stateful.read(spark, f"{path}/t"), ["url"]).select(F.col("url").cast("long").alias("url"), F.col("n").cast("int").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_totalprice > 450000 OR o_orderstatus = 'F'")
def sink_upsert_buckets(spark, sf_dir):
    """Two merges into a table in buckets."""
    store = Buckets(spark, shared_folder(spark, "buckets"), ("o_orderkey",), "o_orderkey long, version string")
    orders = table(spark, sf_dir, "orders")
    store.merge(orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("version")), ["version"])
    store.merge(orders.filter("o_totalprice > 450000").select("o_orderkey", F.lit("new").alias("version")), ["version"])
    return store.read()


@query("SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS n FROM orders GROUP BY 1")
def yearly_counts(spark, sf_dir):
    return reports.yearly(table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd")), "date")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_hashed(spark, sf_dir):
    return dedup.hashed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, min(l_discount) AS rate FROM lineitem GROUP BY 1), c AS (SELECT date, rate, round(rate - lag(rate) OVER (ORDER BY date), 2) AS change FROM d)
 SELECT date, CASE WHEN coalesce(change, 0) = 0 THEN '-' ELSE printf('%+.2f%%p', change) END AS change_text FROM c""")
def rate_change_text(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.min("l_discount").alias("rate"))
    own = relational.rate_changes(days)
    return own.select("date", numeric.signed_points(F.round("change", 2)).alias("change_text"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS titled, CAST(o_orderdate AS DATE) AS month_day, CAST(o_orderdate AS DATE) - 3 AS days_ago, CAST(o_orderdate AS DATE) AS hours_ago, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders""")
def more_date_forms(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    own = table(spark, sf_dir, "orders").withColumn("x", day)
    return own.select(
        "o_orderkey",
        dates.from_title(F.concat(F.lit("minutes "), F.date_format("x", "yyyy.M.d"))).alias("titled"),
        dates.month_day(F.year("x"), F.concat(F.month("x"), F.lit("월 "), F.day("x"), F.lit("일"))).alias("month_day"),
        dates.relative(F.lit("3일 전"), F.col("x")).alias("days_ago"),
        dates.relative(F.lit("5시간 전"), F.col("x")).alias("hours_ago"),
        dates.compact(F.col("x")).alias("compact"),
    )


@query(f"""WITH t AS (SELECT doc_id, {_trigrams("lang || ' ' || source")} AS a, {_trigrams("text")} AS b FROM documents), s AS (SELECT doc_id, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n FROM t)
 SELECT doc_id, round(CASE WHEN n - i > 0 THEN i / (n - i) ELSE 0 END, 6) AS similarity FROM s""")
def trigram_sql_function(spark, sf_dir):
    """trigram_similarity() as a function of SQL, on whole texts."""
    relational.register_sql_functions_of_text(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tidemark_documents")
    return rounded(spark.sql("SELECT doc_id, trigram_similarity(concat(lang, ' ', source), text) AS similarity FROM tidemark_documents"), "similarity")
