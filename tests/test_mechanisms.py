"""The analyser, containment, stores and streams against plain implementations."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import morphology
from tidemark.functions import text as X
from tidemark.operators import containment, similar
from tidemark.sources.buckets import Buckets
from tidemark.streaming import crawl, stateful


# --- morphological analysis


def brute_path(word, entries, follows, unknown):
    """All ways through the lattice; the best by cost, tokens, and from the end by tag and begin."""
    cheapest = {}
    for s, t, c in entries:
        cheapest[s, t] = min(c, cheapest.get((s, t), c))

    def ways(at):
        if at == len(word):
            yield []
            return
        own = [(s, t, c, True) for (s, t), c in cheapest.items() if word.startswith(s, at)]
        own.append((word[at], morphology.UNKNOWN[morphology.kind_of(word[at])], unknown, False))
        for s, t, c, known in own:
            for rest in ways(at + len(s)):
                yield [(at, s, t, c, known), *rest]

    def rank(way):
        tags = ["", *(t for _, _, t, _, _ in way), ""]
        cost = sum(c for *_, c, _ in way) + sum(follows.get(p, 0) for p in itertools.pairwise(tags))
        return (cost, len(way), [(t, b, not known) for b, _, t, _, known in reversed(way)])

    out = []
    for _, s, t, _, known in min(ways(0), key=rank):
        if out and not known and not out[-1][2] and out[-1][1] == t:
            out[-1] = (out[-1][0] + s, t, False)
        else:
            out.append((s, t, known))
    return [(s, t) for s, t, _ in out]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_brute(seed):
    """Small alphabets and costs make many ties; unknown characters of all classes."""
    r = random.Random(seed)
    letters = "ab가나1-"
    entries = [("".join(r.choice(letters) for _ in range(r.randrange(1, 4))), r.choice(["NNG", "SL", "VV"]), r.randrange(1, 5)) for _ in range(14)]
    tags = ["", "NNG", "SL", "VV", "SN", "SY"]
    follows = {(r.choice(tags), r.choice(tags)): r.randrange(-2, 4) for _ in range(10)} if seed % 2 else {}
    one = morphology.Analyser(entries, follows, 3)
    for _ in range(150):
        word = "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
        assert one.word(word) == brute_path(word, entries, follows, 3), (word, entries, follows)


def test_analyser_edges(spark):
    table = spark.createDataFrame([("금리", "NNG", 10), ("인상", "NNG", 10), ("을", "JKO", 5), ("인", "VCP", 3), ("상을", "XX", 3), ("", "NNG", 1), (None, "NNG", 1), ("금리", "NNG", 99), ("RATE", "SL", 5)], "surface string, tag string, cost int")
    follows = spark.createDataFrame([("VCP", "XX", 50)], "tag string, next_tag string, cost int")
    rows = spark.createDataFrame([("금리인상을 rate 12%",), (None,), ("",), (" \n ",), ("뷁" * 2500,)], "v string").coalesce(1)
    plain, strict = morphology.tokenizer(table), morphology.tokenizer(table, follows)
    got = [[(t.token, t.pos) for t in r[0]] for r in rows.select(strict(F.col("v"))).collect()]
    assert got[0] == [("금리", "NNG"), ("인상", "NNG"), ("을", "JKO"), ("rate", "SL"), ("12", "SN"), ("%", "SY")]
    assert got[1:4] == [[], [], []] and [len(t) for t, _ in got[4]] == [1000, 1000, 500]
    assert [t.token for t in rows.select(plain(F.col("v"))).first()[0]][:3] == ["금리", "인", "상을"]
    assert rows.select(X.content_words(F.col("v"), strict)).first()[0] == ["금리", "인상"]
    assert rows.select(X.morphs_joined(F.col("v"), strict)).first()[0] == "금리 인상 을 rate 12 %"
    none = morphology.tokenizer(table.limit(0))
    assert [(t.token, t.pos) for t in rows.select(none(F.col("v"))).first()[0]] == [("금리인상을", "NNG"), ("rate", "SL"), ("12", "SN"), ("%", "SY")]


def test_large_dictionary_refused(spark, monkeypatch):
    monkeypatch.setattr(morphology, "LARGEST", 2)
    with pytest.raises(ValueError):
        morphology.tokenizer(spark.createDataFrame([("a", "X", 1), ("b", "X", 1), ("c", "X", 1)], "surface string, tag string, cost int"))


# --- containment


def test_contained_brute(spark):
    r = random.Random(1)
    strings = ["".join(r.choice("ab é") for _ in range(r.randrange(1, 9))) for _ in range(150)] + ["x" * 300, "x" * 299, None, "", "a", "a"]
    rows = spark.createDataFrame([(s, k) for k, s in enumerate(strings)], "ngram string, _bucket int")
    got = sorted((s or "", k) for s, k in containment.drop_contained(rows).collect())
    assert got == sorted((s or "", k) for k, s in enumerate(strings) if not s or not any(o and s in o and s != o for o in strings))
    assert containment.drop_contained(rows.limit(0)).collect() == []


def holds(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and holds(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(holds(x, y, False) for x in a) for y in b)
    same = type(a) is type(b) and a == b or {type(a), type(b)} == {int, float} and a == b
    return same or top and isinstance(a, list) and any(holds(x, b, False) for x in a)


def test_json_brute(spark):
    r = random.Random(2)

    def value(depth):
        k = r.randrange(9 if depth else 6)
        if k < 6:
            return [None, True, r.randrange(3), r.randrange(3) / 2, r.choice(["a", "1", "a.b", "it's"]), False][k]
        return [value(depth - 1) for _ in range(r.randrange(3))] if k == 6 else {r.choice(["a", "b", "a.b", "it's", "$"]): value(depth - 1) for _ in range(r.randrange(3))}

    docs = [value(3) for _ in range(120)]
    needles = [value(2) for _ in range(12)] + [{}, [], {"a": {}}, [[]]]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, None), (901, "{broken"), (902, "")], "id int, v string").coalesce(1)
    for x in needles:
        got = {q.id for q in rows.filter(X.holds_json(F.col("v"), x)).collect()}
        assert got == {k for k, d in enumerate(docs) if holds(d, x)}, x


# --- stores and streams


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("k", "title"), r, strict=True))) for r in rows))


def test_stateful_ingest(spark, tmp_path):
    """First rows of new keys only, also over batches and a restart, and without reading the table."""
    inbox, table = tmp_path / "in", tmp_path / "t"
    known = spark.createDataFrame([("old", "x"), (None, "x")], "k string, title string")
    stream = lambda: spark.readStream.schema("k string, title string").json(str(inbox))

    def run(**more):
        stateful.ingest(stream(), str(table), f"{tmp_path}/cp", ["k"], ["title"], known=known, **more).awaitTermination()
        return sorted((r.k, r.title) for r in stateful.read(spark, str(table)).collect())

    lines(inbox, "a.json", [("a", "2"), ("a", "1"), ("old", "0"), ("b", None), ("b", "z"), (None, "n")])
    assert run() == [("a", "1"), ("b", "z")]
    for file in table.glob("batch=*/*"):  # a batch that read the table would find nothing and add all again
        file.unlink()
    lines(inbox, "b.json", [("a", "0"), ("c", "3"), ("old", "1")])
    assert run() == [("c", "3")]


def test_buckets(spark, tmp_path):
    store = Buckets(spark, f"{tmp_path}/t", ("k",), "k int, v string", 8)
    assert store.read().collect() == [] and store.merge(store.read(), ["v"]) == []
    store.merge(spark.createDataFrame([(i, "old") for i in range(100)], "k int, v string"), ["v"])
    files = lambda: {r[0] for r in store.read().select(F.input_file_name()).distinct().collect()}
    before = files()
    touched = store.merge(spark.createDataFrame([(3, "b"), (3, "a"), (500, "new")], "k int, v string"), ["v"])
    assert len(touched) <= 2 and len(before - files()) <= 2 and len(before & files()) >= 6
    want = {i: "old" for i in range(100)} | {3: "a", 500: "new"}
    assert {r.k: r.v for r in store.read().collect()} == want and store.read().count() == 101
    # a merge that fails before its version is written leaves the table as it was
    store.spark.createDataFrame([(1, "lost", 1)], "k int, v string, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/v=3")
    assert {r.k: r.v for r in store.read().collect()} == want
    store.merge(spark.createDataFrame([(4, None)], "k int, v string"), ["v"])
    assert {r.k: r.v for r in store.read().collect()} == want | {4: None}


def test_crawl_goes_on(spark, tmp_path):
    """A second run asks for the days since the first one only; short replies are asked for again."""
    log = tmp_path / "asked"
    log.mkdir()

    def fetch(source, day, log=str(log)):
        import pathlib
        import uuid

        tried = len(list(pathlib.Path(log).glob(f"{source}|{day}|*")))
        pathlib.Path(log, f"{source}|{day}|{uuid.uuid4().hex}").touch()
        return None if source == "gone" else "short" if source == "slow" and not tried else f"{source} {day} " + "x" * 300

    crawl.register(spark, "tidemark_test_crawl", fetch, attempts=2)

    def run(last):
        crawl.collect(crawl.replies(spark, "tidemark_test_crawl", ["fast", "slow", "gone"], "2024-01-30", last), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
        return sorted((r.source, r.day, r.attempts, r.short) for r in spark.read.parquet(f"{tmp_path}/t").collect())

    want = lambda days: sorted((s, d, n, short) for d in days for s, n, short in (("fast", 1, False), ("slow", 2, False), ("gone", 2, True)))
    first = ["2024-01-30", "2024-01-31", "2024-02-01"]
    assert run(first[-1]) == want(first)
    assert run(first[-1]) == want(first)
    assert run("2024-02-03") == want([*first, "2024-02-02", "2024-02-03"])
    assert len(list(log.glob("fast|*"))) == 5 and len(list(log.glob("slow|*"))) == 10


def test_crawl_replays_a_batch(spark, tmp_path):
    """A batch whose commit is lost is asked for again, and replaces what it wrote."""
    crawl.register(spark, "tidemark_test_replay", lambda source, day: "y" * 300)
    run = lambda: crawl.collect(crawl.replies(spark, "tidemark_test_replay", ["a"], "2024-01-01", "2024-01-04"), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    run()
    for file in (tmp_path / "cp" / "commits").glob("*"):
        file.unlink()
    run()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


# --- similarity


@pytest.mark.parametrize("least", [0.3, 0.5, 0.85, 1.0])
def test_search_brute(spark, least):
    r = random.Random(4)
    words = ["rate", "rates", "hike", "hikes", "금리", "인상", "동결", "a", "Fed", "the", "policy"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(0, 6))) for _ in range(90)] + [None, "", "--", "Rate hike", "rate HIKE!"]
    rows = spark.createDataFrame(list(enumerate(titles)), "k int, t string")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() for i in range(len(w) + 1)}

    first = {}
    for k, t in enumerate(titles):
        if t is not None:
            first.setdefault(t, k)
    asked = {}
    for k, t in enumerate(titles):
        if t is not None and k % 5 == 0:
            asked.setdefault(t, k)
    want = {}
    for q, k in asked.items():
        for t, j in first.items():
            a, b = grams(q), grams(t)
            if q != t and a and b and len(a & b) / len(a | b) >= least:
                want[k, j] = (round(len(a & b) / len(a | b), 9), titles.count(t))
    got = {(x.query, x.id): (round(x.similarity, 9), x.copies) for x in similar.search(rows.filter("k % 5 = 0"), rows, "k", "t", least).collect()}
    assert got == want and (want or least == 1.0)
