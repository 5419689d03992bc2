import json
import time

from pyspark.sql import functions as F

from tidemark.plans import cli
from tidemark.sources import connectors, readers, writers
from tidemark.streaming import ingest

LONG = "금리를 인상하기로 결정했다 물가가 오르고 있기 때문이다"


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def news(folder):
    article = lambda n, content, url="http://yna/1": {"title": f"t{n}", "content": content, "date": "2024-01-05", "url": url}
    write(folder / "news/news_2024_01.json", {"yonhap": [article(1, LONG), article(1, LONG), article(2, "짧다"), article(3, "")], "edaily": []})
    write(folder / "news/news_2024_02.json", {"infomax": [article(1, LONG)]})
    write(folder / "news/news_summary.json", {"yonhap": [article(9, LONG)]})


def test_news(spark, tmp_path):
    news(tmp_path)
    raw = readers.news_months(spark, f"{tmp_path}/news/*.json")
    assert raw.count() == 5 and {r.source for r in raw.select("source").collect()} == {"yonhap", "infomax"}
    assert {(r.file[5:12], r.source) for r in readers.cleaned_news(raw).collect()} == {("2024_01", "yonhap"), ("2024_02", "infomax")}
    assert readers.news_year(spark, f"{tmp_path}/news", 2024, 1).count() == 4


def test_minutes_bonds_rates(spark, tmp_path):
    write(tmp_path / "m.json", [{"title": "a", "content": "", "discussion": "x", "decision": None}, {"title": "b", "content": None}, {"title": "c", "content": "body"}])
    assert {r.title: r.content for r in readers.minutes(spark, f"{tmp_path}/m.json").collect()} == {"a": "x\n", "b": "", "c": "body"}
    assert readers.minutes(spark, f"{tmp_path}/none.json").count() == 0 and readers.bonds(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.csv").write_text('Date,Title,Content,Link\n2024.01.02,t,"long, text",u\n')
    (tmp_path / "b/2.csv").write_text("Date,Title,Content,Link\n2024.01.01,t,nan,u\n")
    good, bad = readers.bond_files(spark, f"{tmp_path}/b")
    assert [(r.date, r.content) for r in good.collect()] == [("2024-01-02", "long, text")] and [r.file for r in bad.collect()] == ["2.csv"]
    (tmp_path / "r.csv").write_text("날짜,콜금리,CD(91일)\n2024-01-02,3.5,3.6\n2024.01.03,-,3.6\n2024-01-02,3.5,3.6\n")
    assert {(str(r.date), r.call_rate) for r in readers.call_rates(spark, f"{tmp_path}/r.csv").collect()} == {("2024-01-02", 3.5), ("2024-01-03", None)}
    write(tmp_path / "base.json", [{"연도": "2024", "날짜": "1월 11일", "기준금리": "3.50%"}])
    assert [(str(r.date), r.rate) for r in readers.base_rates(spark, f"{tmp_path}/base.json").collect()] == [("2024-01-11", 3.5)]
    write(tmp_path / "g.json", {"2024-01-01": ["a", "b"], "2024-01-02": ["c"]})
    write(tmp_path / "l.json", {"2024-01-01": 1})
    assert [tuple(r) for r in readers.dated_ngrams(spark, f"{tmp_path}/g.json", f"{tmp_path}/l.json").collect()] == [("2024-01-01", ["a", "b"], 1)]
    assert readers.file_counts(spark, {"m": ("list", f"{tmp_path}/m.json"), "b": ("files", f"{tmp_path}/b/*.csv"), "x": ("list", f"{tmp_path}/x")}) == {"m": 3, "b": 2, "x": 0}
    tokens = spark.createDataFrame([("[('a','NNG'), ('b', 'VV')]",)], "v string").select(readers.parsed_tokens(F.col("v"))).first()[0]
    assert [tuple(t) for t in tokens] == [("a", "NNG"), ("b", "VV")]


def test_bond_layouts(spark, tmp_path):
    """Files of two layouts, one with two rows, one without a content column."""
    (tmp_path / "1.csv").write_text("Date,Title,Content,Link\n2024.01.02,t1,c1,l1\n2024.01.04,t4,c4,l4\n")
    (tmp_path / "2.csv").write_text('Date,Title,Company,Content,PDF_URL\n2024.01.01,t2,ACME,"c2, c2",p2\n')
    (tmp_path / "3.csv").write_text("Date,Title\n2024.01.03,t3\n")
    good, bad = readers.bond_files(spark, str(tmp_path))
    assert [(r.date, r.title, r.content, r.link) for r in good.collect()] == [("2024-01-01", "t2", "c2, c2", "p2"), ("2024-01-02", "t1", "c1", "l1"), ("2024-01-04", "t4", "c4", "l4")]
    assert [tuple(r) for r in bad.collect()] == [("3.csv", "missing columns: content")]


def test_news_source_from_address(spark, tmp_path):
    write(tmp_path / "a.json", {"other": [{"title": "t", "content": LONG, "url": "https://www.yna.co.kr/1"}, {"title": "u", "content": LONG, "url": "x"}]})
    assert sorted((r.title, r.source) for r in readers.news_months(spark, f"{tmp_path}/*.json").collect()) == [("t", "yonhap"), ("u", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        writers.insert_new(df, f"{tmp_path}/t", ["k"], ["v"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    out = writers.upsert_into(spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string"), f"{tmp_path}/t", f"{tmp_path}/t2", ["k"], ["v"])
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "z"), (3, "y")}
    assert writers.pending(df, f"{tmp_path}/done", "k").count() == 3
    writers.mark_done(df.limit(1), f"{tmp_path}/done", "k")
    assert writers.pending(df, f"{tmp_path}/done", "k").count() == 2
    writers.json(df, f"{tmp_path}/j")
    writers.csv(df, f"{tmp_path}/c")
    assert readers.legacy_csv(spark, f"{tmp_path}/c", "k int, v string").count() == 3
    pol = spark.createDataFrame([("b", "hawkish"), ("a", "hawkish"), ("c", "dovish")], "ngram string, stance string")
    writers.lexicon(pol, "hawkish", f"{tmp_path}/lex")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lex").collect()] == ["a", "b"]
    writers.statistics(df.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first().n == 3


def test_connectors(spark):
    body = 'cb({"r": [{"date": "20240105 10", "title": "' + "x" * 200 + '"}, {"date": "20240106", "title": "y"}]})'
    rows = connectors.search_replies(spark.createDataFrame([(body,), ("cb()",)], "body string"), "r array<struct<date: string, title: string>>", "r", "20240105")
    assert rows.count() == 1
    listed = spark.createDataFrame([("http://a", "t1", "2024-01-01", 1), ("https://a", "t2", "2024-01-01", 2), ("b", "t1", "2024-01-01", 3), ("c", "t3", "2025-01-01", 4), ("d", "t4", None, 5), ("e", "t5", "odd", 6)], "url string, title string, date string, n int")
    assert {r.n for r in connectors.listing(listed, "2024-01-01", "2024-12-31", ["n"]).collect()} == {1, 6}
    long = spark.createDataFrame([("t", "금리" + "x" * 4000)], "title string, content string")
    assert connectors.safe_cut(connectors.keyword_filter(long, ["금리"])).select(F.length("content"), "content_length").first() == (3000, 4002)
    script = spark.createDataFrame([("var d = [{date: '2024-01-01', rate: 3.5}];",)], "body string")
    assert [tuple(r) for r in connectors.base_rate_script(script).collect()] == [("2024-01-01", 3.5)]
    minutes = spark.createDataFrame([("회의 2024.08.29", "위원 토의 내용 좋다 심의 결과 동결")], "title string, text string")
    assert connectors.minutes_sections(minutes).first().decision == "동결"
    connectors.register_pages(spark, "test_pages", ["a", "b"], lambda k: [(k, 1), (k, 2)], "k string, n int")
    assert spark.read.format("test_pages").load().count() == 4


def test_more_connectors(spark):
    pages = spark.createDataFrame([("a", p, n) for p, n in enumerate([5, 0, 0, 4, 0, 0, 0, 9, 1])] + [("b", 0, 0), ("b", 1, 0)], "l string, p int, n int")
    assert sorted((r.l, r.p) for r in connectors.until_empty(pages, "l", "p", "n").collect()) == [*(("a", k) for k in range(6)), ("b", 0), ("b", 1)]
    assert [r.body for r in connectors.to_refetch(spark.createDataFrame([("x" * 300,), (None,), ("short",)], "body string")).collect()] == [None, "short"]
    scripts = spark.createDataFrame([("<script>var items = [{title: 'a', url: 'u'}, {title: 'b', url: 'v'}];</script>",)], "body string")
    assert [tuple(r) for r in connectors.script_items(scripts, "title: string, url: string", "items").collect()] == [("a", "u"), ("b", "v")]
    failures = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([("good",), (None,), ("bad",)], "t string")
    up = connectors.external(lambda t: t.upper() if t != "bad" else 1 / 0, failures)
    assert [r[0] for r in texts.select(up(F.col("t"))).collect()] == ["GOOD", None, None] and failures.value == 1
    assert connectors.half_years("2015-02-01", "2016-01-31") == [(20150201, 20150731), (20150801, 20160131)]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"title": f"t{i}", "content": "c", "date": "2024-01-01", "url": "u", "source": "yonhap"}) for i in range(3 + k)))
        time.sleep(0.01)
        q = ingest.ingest(ingest.articles(spark, str(folder)), f"{tmp_path}/t", f"{tmp_path}/cp", ["date", "title", "source"], ["url"])
        q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_stream_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"title": "t", "date": f"2024-01-{d:02d} 10:00:00", "source": "yonhap"}) for d in (1, 1, 2, 9)))
    stream = ingest.articles(spark, str(folder)).withColumn("ts", F.col("date").cast("timestamp"))
    for q, name in ((ingest.daily_counts(stream.select("ts", "source"), "ts"), "days"), (ingest.monthly_counts(stream, "ts"), "months")):
        w = q.writeStream.outputMode("complete").format("memory").queryName(name).start()
        w.processAllAvailable()
        w.stop()
    assert {(str(r.day), r.n) for r in spark.sql("select * from days").collect()} == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-09", 1)}
    assert [tuple(r) for r in spark.sql("select * from months").collect()] == [("2024-01", "yonhap", 4)]


def test_cli(spark, tmp_path):
    news(tmp_path)
    write(tmp_path / "minutes.json", [{"title": "m", "date": "2024.01.04", "content": LONG * 4}])
    write(tmp_path / "bonds.json", [{"title": "b", "date": "2024-01-04", "content": LONG}])
    (tmp_path / "call_rates.csv").write_text("날짜,콜금리\n2024-01-01,3.0\n2024-02-01,3.5\n2024-03-10,3.0\n")
    for stage in ("ingest", "corpus", "sentences", "ngrams"):
        cli.main([stage, "--data", str(tmp_path), "--out", f"{tmp_path}/out"])
    corpus = {r.pk for r in spark.read.parquet(f"{tmp_path}/out/corpus").collect()}
    assert corpus == {"120240105001", "320240105001", "420240104001", "520240104001"}
    for stage in ("train", "evaluate", "predict"):
        cli.main([stage, "--data", str(tmp_path), "--out", f"{tmp_path}/out"])
    assert spark.read.json(f"{tmp_path}/out/evaluation").columns[-1:] != [] and spark.read.parquet(f"{tmp_path}/out/predictions").count() == 4
    assert spark.read.parquet(f"{tmp_path}/out/ngrams").filter(F.array_contains("ngrams", "금리를")).count() >= 3
