"""Queries of the mechanisms behind the reference's indexes, analyser and stores, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import schemas
from ..functions import cleansing, morphology, numeric
from ..functions import text as X
from ..operators import bayes, containment, dedup, evaluate, frequent, relational, similar, vocabulary
from ..sources import connectors
from .catalogue import _COUNTS, _SCORED, _SPLITS, _TOKENS, _WHITE, QUERIES, SQL, _bags, _collapse, _grams, _trigrams, counted, joined_words, query, rounded, scored, table, texts

__all__ = ["QUERIES", "SQL"]

# --- morphological analysis -----------------------------------------------------------------------------------------

#: A small dictionary for the tables' invented prose: surface, tag, cost.
DICTIONARY = [
    ("the", "MM", 900), ("of", "JKG", 800), ("and", "MAJ", 900), ("to", "JKB", 850), ("in", "JKB", 950), ("a", "MM", 2500), ("is", "VCN", 900),
    ("th", "NNG", 1600), ("an", "NNG", 1700), ("er", "XSN", 1500), ("ing", "EC", 1300), ("ion", "XSN", 1200), ("tion", "NNG", 1900), ("at", "JKB", 1700),
    ("en", "XSV", 1650), ("on", "MAG", 1650), ("re", "XPN", 1600), ("ent", "VV", 1900), ("es", "EP", 1550), ("s", "EP", 3000), ("le", "NNG", 1500), ("ly", "MAG", 1100),
    ("her", "NP", 1800), ("that", "MM", 1000), ("de", "XPN", 1550), ("ou", "NNG", 1750), ("qu", "XPN", 1400), ("ai", "NNG", 1750), ("é", "VV", 4000), ("ch", "NNG", 1700), ("sch", "VA", 2100),
]
_LONGEST = max(len(s) for s, _, _ in DICTIONARY)
_ENTRIES = "[" + ", ".join(f"{{'s': '{s}', 'l': {len(s)}, 't': '{t}', 'c': {c}}}" for s, t, c in DICTIONARY) + "]"
_STATE = "STRUCT(c BIGINT, n BIGINT, t VARCHAR, s BIGINT, k BIGINT, p STRUCT(w VARCHAR, t VARCHAR, k BIGINT)[])"
_KIND = "CASE WHEN regexp_matches(ch, '^[가-힣]$') THEN 'NNG' WHEN regexp_matches(ch, '^\\p{L}$') THEN 'SL' WHEN regexp_matches(ch, '^[\\p{Nd}\\x{B2}\\x{B3}\\x{B9}]$') THEN 'SN' ELSE 'SY' END"
#: Every word's places in turn, each with the best way there; the last places are kept, as many as the longest surface has characters.
_PATHS = f"""w AS (SELECT doc_id, unnest({{'x': list_filter(regexp_split_to_array(lower(text), '[{_WHITE}]+'), lambda x: x <> '')}}.x) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[{_WHITE}]+'), lambda x: x <> ''), 1) AS position FROM documents),
 pieces AS (SELECT DISTINCT substr(word, CAST(o AS BIGINT), {morphology.LONGEST}) AS word FROM (SELECT word, unnest(range(1, length(word) + 1, {morphology.LONGEST})) AS o FROM w)),
 v AS (SELECT word, 0::BIGINT AS i, [{{'c': 0, 'n': 0, 't': '', 's': -1, 'k': 0, 'p': []}}::{_STATE}] AS b FROM pieces
  UNION ALL SELECT word, i + 1, list_concat(b[greatest(len(b) - {_LONGEST - 2}, 1):], [list_sort(list_concat(
   list_transform(list_filter({_ENTRIES}, lambda e: e.l <= len(b) AND substr(word, i + 2 - e.l, e.l) = e.s), lambda e:
    {{'c': b[len(b) - e.l + 1].c + e.c, 'n': b[len(b) - e.l + 1].n + 1, 't': e.t, 's': i + 1 - e.l, 'k': 0, 'p': list_append(b[len(b) - e.l + 1].p, {{'w': e.s, 't': e.t, 'k': 0}})}}::{_STATE}),
   [{{'c': b[-1].c + {morphology.COST}, 'n': b[-1].n + 1, 't': kind, 's': i, 'k': 1, 'p': CASE WHEN len(b[-1].p) > 0 AND b[-1].p[-1].k = 1 AND b[-1].p[-1].t = kind
     THEN list_append(b[-1].p[:-2], {{'w': b[-1].p[-1].w || ch, 't': kind, 'k': 1}}) ELSE list_append(b[-1].p, {{'w': ch, 't': kind, 'k': 1}}) END}}::{_STATE}]))[1]])
  FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, substr(word, i + 1, 1) AS ch FROM v WHERE i < length(word)))),
 paths AS (SELECT word, b[-1].p AS p FROM v WHERE i = length(word)),
 tokens AS (SELECT doc_id, position, o, p FROM (SELECT doc_id, position, o, substr(w.word, CAST(o AS BIGINT), {morphology.LONGEST}) AS piece FROM w, (SELECT unnest(range(1, (SELECT max(length(word)) FROM w) + 1, {morphology.LONGEST})) AS o) WHERE o <= length(w.word)) JOIN paths ON piece = paths.word)"""


def analyser(spark):
    return morphology.tokenizer(spark.createDataFrame(DICTIONARY, "surface string, tag string, cost int"))


_ORDERED = "flatten(list(p ORDER BY position, o))"


@query(f"""WITH RECURSIVE {_PATHS}, d AS (SELECT doc_id, {_ORDERED} AS p FROM tokens GROUP BY 1)
 SELECT doc_id, coalesce(len(p), 0) AS tokens, coalesce(len(list_filter(p, lambda x: x.t IN ('NNG', 'VA', 'MAG', 'VV', 'VCN'))), 0) AS content, md5(coalesce(array_to_string(list_transform(p, lambda x: x.w || '/' || x.t), ' '), '')) AS digest FROM documents LEFT JOIN d USING (doc_id)""")
def morphemes(spark, sf_dir):
    """Every document analysed with the dictionary: tokens, content words, and a digest of the whole analysis."""
    tokens = analyser(spark)(F.col("text"))
    own = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t"))
    words = F.filter("t", lambda t: t["pos"].isin(*X.POS))
    joined = F.array_join(F.transform("t", lambda t: F.concat(t["token"], F.lit("/"), t["pos"])), " ")
    return own.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(words).cast("long").alias("content"), F.md5(joined).alias("digest"))


@query(f"""WITH RECURSIVE {_PATHS}, m AS (SELECT doc_id, unnest({_ORDERED}) AS x FROM tokens GROUP BY 1) SELECT x.w AS token, x.t AS pos, count(*) AS n, count(DISTINCT doc_id) AS documents FROM m WHERE x.t IN ('NNG', 'VA', 'MAG', 'VV', 'VCN') GROUP BY 1, 2""")
def morpheme_counts(spark, sf_dir):
    """Content morphemes over the corpus: occurrences, and the documents that have them."""
    tokens = analyser(spark)(F.col("text"))
    own = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.inline("t"))
    by_document = own.filter(F.col("pos").isin(*X.POS)).groupBy("token", "pos", "doc_id").agg(F.count("*").alias("n"))
    return by_document.groupBy("token", "pos").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


# --- containment ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_grams(5)}, p AS (SELECT ngram FROM grams GROUP BY 1 HAVING count(*) >= {vocabulary.MIN_FREQUENCY}), n AS (SELECT DISTINCT length(ngram) AS l FROM p),
 s AS (SELECT DISTINCT substr(ngram, i, l) AS part FROM (SELECT ngram, l, unnest(range(1, length(ngram) - l + 2)) AS i FROM p JOIN n ON l < length(ngram)))
 SELECT ngram FROM p WHERE ngram NOT IN (SELECT part FROM s)""")
def vocabulary_maximal(spark, sf_dir):
    """The n-grams of the whole vocabulary that are no part of another one."""
    words = frequent.words_table(texts(spark, sf_dir), joined_words(F.col("text")), [], merge=False)
    counts = frequent.Candidates(words, vocabulary.MIN_FREQUENCY, 5).bags(names=True).groupBy("ngram").agg(F.sum("tf").alias("frequency"))
    # written, since the containment reads it several times
    return containment.drop_contained(frequent.written(counts.filter(F.col("frequency") >= vocabulary.MIN_FREQUENCY).select("ngram"), "vocabulary"))


#: Needles, by name.
NEEDLES = {
    "kind": {"event": {"type": "click"}},
    "value": {"event": {"props": {"k": 7}}},
    "tags": {"tags": ["hot", {"n": 3}]},
    "nested": {"event": {"type": "view", "props": {"k": 9}}, "tags": [{"n": 1}]},
    "lists": {"rows": [[2], [1]]},
    "none": {"gone": None},
    "wrong": {"event": {"props": {"k": "7"}}},
    "empty": {"event": {}, "tags": []},
}


@query("""WITH e AS (SELECT event_id, json_object('event', json_object('type', event_type, 'props', props::JSON), 'tags', json_array(CASE WHEN user_id % 2 = 0 THEN 'hot' ELSE 'cold' END, json_object('n', user_id % 5, 'm', NULL)), 'rows', json_array(json_array(1, user_id % 3), json_array(1)), 'gone', NULL) AS doc FROM events)
 SELECT event_id, """ + ", ".join(f"json_contains(doc, '{json.dumps(n)}') AS {name}" for name, n in NEEDLES.items()) + " FROM e")
def json_nested(spark, sf_dir):
    """Containment of nested needles in a document built around events.props."""
    tag = F.when(F.col("user_id") % 2 == 0, '"hot"').otherwise('"cold"')
    doc = F.format_string(
        '{"event": {"type": "%s", "props": %s}, "tags": [%s, {"n": %s, "m": null}], "rows": [[1, %s], [1]], "gone": null}',
        "event_type", "props", tag, F.col("user_id") % 5, F.col("user_id") % 3,
    )
    own = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return own.select("event_id", *[X.holds_json(F.col("doc"), n).alias(name) for name, n in NEEDLES.items()])


# --- small operators over whole tables ------------------------------------------------------------------------------


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all('금리' || lang || '인상, ' || text || '물가', '[가-힣]+'), ' ')) AS digest FROM documents")
def hangul_runs(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", F.md5(cleansing.keep_hangul(F.concat(F.lit("금리"), "lang", F.lit("인상, "), "text", F.lit("물가")))).alias("digest"))


@query(f"SELECT doc_id, md5(substr({_collapse('text')}, 1, 50000)) AS digest FROM documents")
def pdf_texts(spark, sf_dir):
    """White space collapsed; the cut at 50,000 characters is the published one."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleansing.pdf_text(F.col("text"))).alias("digest"))


@query(f"WITH tok AS (SELECT {_TOKENS} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i:i + 1])) AS w FROM tok) SELECT array_to_string(w, ' ') AS ngram, count(*) AS n FROM g WHERE w[1] <> w[2] GROUP BY 1")
def chart_ngrams(spark, sf_dir):
    """Two-word n-grams that charts may show."""
    own = table(spark, sf_dir, "documents").select(F.explode(X.ngrams(X.content_words(F.col("text")), 2)).alias("ngram"))
    return own.groupBy("ngram").agg(F.count("*").alias("n")).filter(X.presentable_ngram(F.col("ngram")))


@query(f"""SELECT page_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: {_collapse("regexp_replace(p, '<[^>]*>', '', 'g')")}), lambda p: p <> '' AND NOT starts_with(p, '※')), chr(10))) AS digest FROM pages""")
def paragraph_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.paragraphs(F.col("html"))).alias("digest"))


_COUNTED = ("nation", "orders", "documents", "pages", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED) + " UNION ALL SELECT 'absent', 0")
def row_counts(spark, sf_dir):
    """Rows of tables by name, 0 for one that isn't there."""
    for t in _COUNTED:
        table(spark, sf_dir, t).createOrReplaceTempView(f"tidemark_{t}")
    counts = relational.row_counts(spark, [f"tidemark_{t}" for t in (*_COUNTED, "absent")])
    return spark.createDataFrame([(k.removeprefix("tidemark_"), n) for k, n in counts.items()], "name string, n long")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1")
def dedup_title_date(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return dedup.first_of(own, ["o_custkey", "day"], ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def result_cap(spark, sf_dir):
    """The newest results up to the search service's limit."""
    own = connectors.capped(table(spark, sf_dir, "orders"), connectors.MAX_RESULTS, [F.desc("o_orderdate"), "o_orderkey"])
    return own.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query(f"""WITH {_bags(vocabulary.MIN_FREQUENCY)}, {_COUNTS}, p AS (SELECT ngram, count_0 / sum(count_0) OVER () AS p0, count_1 / sum(count_1) OVER () AS p1 FROM counts)
 SELECT ngram, p0 = 0 AS never_0, p1 = 0 AS never_1, round(CASE WHEN p0 > 0 THEN ln(p0) END, 6) AS log_0, round(CASE WHEN p1 > 0 THEN ln(p1) END, 6) AS log_1 FROM p""")
def unsmoothed_logs(spark, sf_dir):
    """The notebook's model without smoothing: what a class never has counts as minus infinity."""
    own = bayes.table_of(counted(spark, sf_dir, vocabulary.MIN_FREQUENCY), epsilon=False)
    logs = {k: numeric.log_or_minus_infinity(F.col(f"prob_{k}")) for k in (0, 1)}
    never = {k: logs[k] == F.lit(float("-inf")) for k in logs}
    return own.select("ngram", *[never[k].alias(f"never_{k}") for k in never], *[F.round(F.when(~never[k], logs[k]), 6).alias(f"log_{k}") for k in logs])


@query(f"""WITH {_bags(vocabulary.MIN_FREQUENCY)}, {_SPLITS}, {_SCORED}, c AS (SELECT label, pred, count(*) AS n FROM preds GROUP BY 1, 2)
 SELECT label, pred, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS pct FROM (SELECT unnest([0, 1]) AS label) CROSS JOIN (SELECT unnest([0, 1]) AS pred) LEFT JOIN c USING (label, pred)""")
def confusion_shares(spark, sf_dir):
    return rounded(evaluate.cell_shares(evaluate.confusion(scored(spark, sf_dir, vocabulary.MIN_FREQUENCY))), "pct")


@query("""WITH a AS (SELECT count(*) AS n, avg((toxic = 0)::INT) AS accuracy FROM labels WHERE quality IS NOT NULL), b AS (SELECT *, round_even(n * 0.5, 0) AS ones FROM a),
 c AS (SELECT n, ones, round_even(ones * accuracy, 0) AS tp, round_even((n - ones) * accuracy, 0) AS tn FROM b) SELECT tp::BIGINT AS tp, (ones - tp)::BIGINT AS fn, tn::BIGINT AS tn, (n - ones - tn)::BIGINT AS fp FROM c""")
def cells_from_accuracy(spark, sf_dir):
    """A symmetric matrix from a total and an accuracy: here of calling every labelled document clean."""
    a = table(spark, sf_dir, "labels").filter("quality is not null").agg(F.count("*").alias("n"), F.avg((F.col("toxic") == 0).cast("int")).alias("accuracy")).first()
    cells = evaluate.cells_from_accuracy(a["n"], a["accuracy"] or 0.0)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} long" for k in cells))


@query("""SELECT 'required' AS problem, count(*) AS n FROM documents WHERE doc_id IS NULL OR text IS NULL OR lang IS NULL
 UNION ALL SELECT 'unique', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'parent', count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def schema_checks(spark, sf_dir):
    """Required fields, unique keys and references; the parents are the English documents, so some are missing."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    whole = schemas.required(documents, "doc_id", "text", "lang").agg(F.count("*").alias("whole"))
    lacking = documents.agg(F.count("*").alias("rows")).join(F.broadcast(whole)).select((F.col("rows") - F.col("whole")).alias("n"))  # one row each
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    repeated = one(schemas.unique_violations(labels, "doc_id"), "unique")
    orphans = one(schemas.missing_parents(labels, "doc_id", documents.filter("lang = 'en'"), "doc_id"), "parent")
    return lacking.select(F.lit("required").alias("problem"), "n").union(repeated).union(orphans)


@query("SELECT page_id, md5(url) AS title, page_id % 7 AS place FROM pages WHERE url IS NOT NULL")
def page_script_items(spark, sf_dir):
    """Items of an object literal in a page's script."""
    script = F.format_string("<script>var items = [{title: '%s', place: %s, page: %s}];</script>", F.md5("url"), F.col("page_id") % 7, F.col("page_id"))
    own = table(spark, sf_dir, "pages").filter("url is not null").select(F.concat(F.coalesce("html", F.lit("")), script).alias("body"))
    return connectors.script_items(own, "title: string, place: bigint, page: bigint", "items").select(F.col("page").alias("page_id"), "title", "place")


@query("SELECT doc_id, CAST(length(text) AS VARCHAR) AS reply FROM documents")
def external_service(spark, sf_dir):
    """A text service in place: its reply is the text's length; what it fails on would be counted."""
    failures = spark.sparkContext.accumulator(0)
    return table(spark, sf_dir, "documents").select("doc_id", connectors.external(lambda t: str(len(t)), failures)(F.col("text")).alias("reply"))


# --- search by similarity -------------------------------------------------------------------------------------------

_TITLES = "t AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages WHERE html IS NOT NULL)"


def titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query(f"""WITH {_TITLES}, c AS (SELECT title, min(page_id) AS id, count(*) AS copies FROM t GROUP BY 1), q AS (SELECT title, min(page_id) AS id FROM t WHERE page_id % 20 = 0 GROUP BY 1),
 a AS (SELECT id, title, {_trigrams("title")} AS g FROM q), b AS (SELECT id, title, copies, {_trigrams("title")} AS g FROM c),
 ag AS (SELECT id, unnest(g) AS x FROM a), bg AS (SELECT id, unnest(g) AS x FROM b), n AS (SELECT ag.id AS query, bg.id AS id, count(*) AS i FROM ag JOIN bg USING (x) GROUP BY 1, 2)
 SELECT query, n.id AS id, round(i / (len(a.g) + len(b.g) - i), 6) AS similarity, copies FROM n JOIN a ON a.id = query JOIN b ON b.id = n.id WHERE a.title <> b.title AND i / (len(a.g) + len(b.g) - i) >= {similar.LEAST} - 1e-12""")
def similar_titles(spark, sf_dir):
    """For the titles of every twentieth page all distinct titles of similarity 0.3 or more."""
    own = titles(spark, sf_dir)
    return rounded(similar.search(own.filter("page_id % 20 = 0"), own, "page_id", "title"), "similarity")
