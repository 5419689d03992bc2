import datetime as dt
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import bayes, containment, dedup, evaluate, frequent, keys, label, relational, reports, splits, topics, vocabulary
from tidemark.plans import catalogue, pipeline
from tidemark.schemas import missing_parents, required, unique_violations

D = dt.date


def frames(spark, days, rates):
    return spark.createDataFrame([(d,) for d in days], "date date"), spark.createDataFrame(rates, "date date, rate double")


def labels(spark, days, rates, **options):
    docs, series = frames(spark, days, rates)
    return {r.date: r.label for r in label.forward_label(docs, series, **options).collect()}


def test_label_fixtures(spark):
    jan, feb = D(2024, 1, 15), D(2024, 2, 15)
    assert labels(spark, [jan], [(jan, 1.5), (feb, 2.0)]) == {jan: 1}
    assert labels(spark, [jan], [(jan, 3.5), (feb, 3.48)]) == {jan: None}
    assert labels(spark, [jan], [(jan, 1.5), (feb, 1.53)]) == {jan: 1}
    assert labels(spark, [jan], [(jan, 2.5), (feb, 2.53)]) == {jan: None}
    assert labels(spark, [D(2023, 1, 31)], [(D(2023, 1, 1), 1.0), (D(2023, 2, 28), 2.0), (D(2023, 3, 1), 0.1)]) == {D(2023, 1, 31): 1}
    assert labels(spark, [feb], [(jan, 1.0), (D(2024, 3, 1), 2.0)]) == {feb: 1}
    assert labels(spark, [feb], [(jan, 1.0), (D(2024, 3, 1), 2.0)], censor_tail=True) == {feb: None}
    assert labels(spark, [D(2020, 1, 1)], [(jan, 1.0)]) == {D(2020, 1, 1): None}


def test_asof_brute(spark):
    r = random.Random(1)
    base = D(2020, 1, 1)
    rates = sorted({base + dt.timedelta(r.randrange(900)): round(r.random(), 2) for _ in range(60)}.items())
    days = [base + dt.timedelta(r.randrange(-20, 950)) for _ in range(400)] + [None]
    docs, series = frames(spark, days, rates)
    got = label.as_of(docs, series).collect()
    assert len(got) == len(days)
    for row in got:
        want = [v for d, v in rates if row.date and d <= row.date]
        assert row.rate == (want[-1] if want else None)


def test_surrogate_keys(spark):
    rows = [("yonhap", D(2024, 1, 1), i) for i in range(1002)] + [("yh", D(2024, 1, 1), 1), ("bond", None, 2)]
    got = [r.pk for r in keys.surrogate_key(spark.createDataFrame(rows, "source string, day date, o int"), "source", "day", ["o"]).orderBy("o").collect()]
    assert "1202401011000" in got and "120240101001" in got and got.count(None) == 2
    assert len({x for x in got if x}) == 1002


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "v int").repartition(7)
    assert {(r.v, r.row_id) for r in keys.with_row_number(df, ["v"]).collect()} == {(i, i) for i in range(1000)}


def test_row_numbers_beside_wide_columns(spark):
    """Rows' partitions aren't merged, those of the order alone are."""
    own = {"coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1k", "advisoryPartitionSizeInBytes": "20k"}
    for k, v in own.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        wide = F.concat(*[F.sha2((F.col("id") + i * 1000).cast("string"), 512) for i in range(8)])
        df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("v"), wide.alias("wide")).repartition(7)
        got = [(r.v, r.row_id, len(r.wide)) for r in keys.with_row_number(df, ["v"]).collect()]
    finally:
        for k in own:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert sorted(got) == [(i, i, 1024) for i in range(1000)]


def test_dedup(spark):
    rows = [("f1", "a", "t", "c", 2), ("f1", "a", "t", "c", 1), ("f1", "b", "t", "c", 3), ("f2", "a", "t", "c", 4)]
    df = spark.createDataFrame(rows, "file string, source string, title string, content string, position int")
    assert {r.position for r in dedup.within_file(df, "file", "source", "title", "content", "position").collect()} == {1, 3, 4}
    urls = spark.createDataFrame([("a", "u", 1), ("a", "u", 2), ("b", "u", 3), ("a", "", 4), ("a", None, 5)], "source string, url string, n int")
    assert {r.n for r in dedup.by_url(urls, ["n"]).collect()} == {1, 3}
    assert {(r.n, r.duplicated) for r in dedup.flag_duplicates(urls, ["source", "url"]).collect()} == {(1, True), (2, True), (3, False), (4, False), (5, False)}
    assert {r.n for r in dedup.hashed(urls, "url", ["n"]).collect()} == {1, 4, 5}


def test_inserts(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    come = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in relational.new_rows(come, have, ["k"], ["v"]).collect()} == {(3, "y")}
    assert {tuple(r) for r in relational.upsert(have, come, ["k"], [F.desc("v")]).collect()} == {(1, "a"), (2, "x"), (3, "z")}
    assert unique_violations(come, "k").count() == 1 and missing_parents(come, "k", have, "k").count() == 2
    with pytest.raises(ValueError):
        required(have, "absent")


def sample(seed=1, n=300):
    r = random.Random(seed)
    return [(i, r.randrange(2), [f"g{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randrange(0, 12))]) for i in range(n)]


def long(spark, rows):
    df = spark.createDataFrame(rows, "id long, label int, ngrams array<string>")
    return df, vocabulary.bag(df, "id", carry=["label"])


def brute_model(rows):
    counts = [Counter(), Counter()]
    for _, y, g in rows:
        counts[y].update(g)
    words = set(counts[0]) | set(counts[1])
    log = {w: tuple(math.log((c[w] + 1) / (sum(c.values()) + len(words))) for c in counts) for w in words}
    prior = [sum(y == k for _, y, _ in rows) / len(rows) for k in (0, 1)]
    return log, prior


def test_naive_bayes_brute(spark):
    rows = sample()
    df, bags = long(spark, rows)
    model, prior = bayes.theta(bayes.class_counts(bags)), bayes.priors(df)
    log, p = brute_model(rows)
    for r in model.collect():
        assert (r.log_theta_0, r.log_theta_1) == pytest.approx(log[r.ngram])
    theta = model.agg(F.sum(F.exp("log_theta_0")), F.sum(F.exp("log_theta_1"))).first()
    assert tuple(theta) == pytest.approx((1, 1))
    for r in bayes.predict(df, bags, model, prior, "id").collect():
        s = [math.log(p[k]) + sum(log[g][k] for g in r.ngrams) for k in (0, 1)]
        assert (r.l0, r.l1) == pytest.approx(s) and r.pred == int(s[1] > s[0] + 1e-12) or abs(s[0] - s[1]) < 1e-9
        assert r.proba == pytest.approx(1 / (1 + math.exp(s[0] - s[1])))


def test_prior_and_ties(spark):
    df, bags = long(spark, [(1, 0, ["a"]), (2, 1, ["a"]), (3, 1, ["a"]), (4, 1, ["a"])])
    assert tuple(bayes.priors(df).first()) == (0.25, 0.75)
    tie, tied = long(spark, [(1, 0, ["a"]), (2, 1, ["a"])])
    assert {r.pred for r in bayes.predict(tie, tied, bayes.theta(bayes.class_counts(tied)), bayes.priors(tie), "id").collect()} == {0}
    votes = spark.createDataFrame([(1, 1, 0, 0.1), (1, 1, 1, 0.9)], "id long, label int, pred int, proba double")
    assert bayes.vote(votes, "id").first().pred == 1


def marked(spark, rows, n):
    df, bags = long(spark, rows)
    return tuple(x.withColumn("tested", splits.by_modulus(F.col("id"), n)) for x in (df.select("id", "label"), bags))


def test_split_models_brute(spark):
    """Counts by subtraction equal a fit on the training rows, iteration by iteration, and so do the scores of its test rows."""
    rows = [r for r in sample(2) if r[2]]
    ids, bags = marked(spark, rows, 4)
    models, prior = splits.models(splits.counts(bags, iterations=4), 4), splits.priors(ids, iterations=4)
    got = {r.ngram: r for r in models.collect()}
    p = prior.first()
    scored = {(r.id, r.iter): r for r in splits.predict(ids, bags, models, prior, "id", iterations=4).collect()}
    tests = 0
    for it in range(4):
        log, own = brute_model([r for r in rows if r[0] % 10 != it % 10])
        assert {w for w, r in got.items() if r.theta_0[it] is not None} == set(log)
        assert all((got[w].theta_0[it], got[w].theta_1[it]) == pytest.approx(log[w]) for w in log)
        assert (p.prior_0[it], p.prior_1[it]) == pytest.approx(tuple(own))
        for i, y, grams in rows:
            if i % 10 == it % 10:
                s = [math.log(own[k]) + sum(log[g][k] for g in grams if g in log) for k in (0, 1)]
                assert (scored[i, it].l0, scored[i, it].l1) == pytest.approx(s) and scored[i, it].label == y
                tests += 1
    assert tests == len(scored) > 0
    scores = {r.ngram: r for r in splits.polarity(models, 4).collect()}
    for w, r in got.items():
        each = [b - a for a, b in zip(r.theta_0, r.theta_1, strict=True) if a is not None]
        mean = sum(each) / len(each)
        assert (scores[w].mean_score, scores[w].num_iterations) == (pytest.approx(mean), len(each))
        assert scores[w].std_score == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)), abs=1e-9)


def test_splits_by_modulus_differ(spark):
    """All 30 splits are different tenths, and each round of ten tests every row once."""
    rows = spark.range(200).select("id", splits.by_modulus(F.col("id")).alias("tested")).collect()
    parts = {i: {r.id for r in rows if r.tested >> i & 1} for i in range(bayes.ITERATIONS)}
    assert bayes.ITERATIONS == len({frozenset(x) for x in parts.values()})
    assert all(len(x) == 20 for x in parts.values())
    assert all(set().union(*(parts[10 * k + i] for i in range(10))) == set(range(200)) for k in range(3))


def test_splits_by_digest(spark):
    """Each iteration tests about its share, independently of the others; the mask is what MD5 says."""
    rows = spark.range(4000).select("id", splits.by_digest(F.col("id")).alias("tested")).collect()
    for i in range(bayes.ITERATIONS):
        assert 330 < sum(r.tested >> i & 1 for r in rows) < 470
        assert sum(r.tested >> i & 1 and r.tested >> (i + 1) % 30 & 1 for r in rows) < 80
    digest = lambda i, k: hashlib.md5(f"33:{i // 8}:{k}".encode()).hexdigest()[i % 8 * 4 :][:4]
    assert all(r.tested == sum(1 << i for i in range(30) if int(digest(i, r.id), 16) < 6554) for r in rows[:200])
    assert {r[0] for r in spark.range(5).select(splits.by_digest(F.col("id"), 3, 1.0)).collect()} == {7}
    with pytest.raises(ValueError):
        splits.by_digest(F.col("id"), 63)


def test_splits_plan(spark, tmp_path):
    """Nothing is exchanged by iteration, and no n-gram is repeated for each: two exchanges by n-gram at most."""
    _, bags = marked(spark, sample(2), 30)
    bags.write.parquet(f"{tmp_path}/bags")
    plan = splits.polarity(splits.models(splits.counts(spark.read.parquet(f"{tmp_path}/bags"))))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("hashpartitioning") == plan.count("hashpartitioning(ngram") <= 2


def test_polarity_flips(spark):
    rows = [r for r in sample(3) if r[2]]
    scores = []
    for flip in (0, 1):
        _, bags = long(spark, [(i, y ^ flip, g) for i, y, g in rows])
        bags = bags.withColumn("tested", splits.by_digest(F.col("id"), 5))
        scores.append({r.ngram: r.mean_score for r in splits.polarity(splits.models(splits.counts(bags, iterations=5), 5), 5).collect()})
    assert scores[0].keys() == scores[1].keys() and all(scores[0][k] == pytest.approx(-scores[1][k], abs=1e-9) for k in scores[0])


def test_stratified_split(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "id long, label int")
    a = bayes.stratified_test(rows.repartition(3), "label", "id").collect()
    b = bayes.stratified_test(rows.repartition(11), "label", "id").collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    assert Counter((r.label, r.in_test) for r in a) == {(0, True): 150, (0, False): 1350, (1, True): 50, (1, False): 450}


def test_date_model(spark):
    df, bags = long(spark, [(1, 0, ["a"] * 6), (2, 1, ["b"] * 10), (3, 1, ["c"])])
    table = bayes.probability_table(bags)
    assert {(r.ngram, r.prob_0, r.prob_1) for r in table.collect()} == {("a", 1.0, 1e-100), ("b", 1e-100, 1.0)}
    assert tuple(bayes.mass_priors(table).first()) == (6 / 16, 10 / 16)
    assert {(r.id, r.pred) for r in bayes.predict_by_table(df, bags, table, bayes.mass_priors(table), "id").collect()} == {(1, 0), (2, 1), (3, 1)}
    raw = bayes.probability_table(bags, epsilon=False)
    assert {r.l1 for r in bayes.predict_by_table(df, bags, raw, bayes.mass_priors(raw), "id").collect() if r.id == 1} == {float("-inf")}


def test_evaluate(spark):
    r = random.Random(5)
    rows = [(i, int(p > r.random()), round(p, 1)) for i in range(200) for p in [r.random()]]
    df = spark.createDataFrame(rows, "id long, label int, proba double").withColumn("pred", (F.col("proba") >= 0.5).cast("int"))
    m = evaluate.metrics(df).first()
    tp = sum(y == 1 and p >= 0.5 for _, y, p in rows)
    assert m.tp == tp and m.tp + m.fp + m.fn + m.tn == 200 and m.f1 == pytest.approx(2 * m.precision * m.recall / (m.precision + m.recall))
    curve = {x.threshold: (x.precision, x.recall) for x in evaluate.pr_curve(df).collect()}
    for t in {p for _, _, p in rows}:
        called = [y for _, y, p in rows if p >= t]
        assert curve[t] == pytest.approx((sum(called) / len(called), sum(called) / sum(y for _, y, _ in rows)))
    assert 0 < evaluate.pr_auc(evaluate.pr_curve(df)).first().auc <= 1
    assert evaluate.metrics(df.limit(0)).first().f1 == 0
    assert evaluate.cells_from_accuracy(100, 0.8) == {"tp": 40, "fn": 10, "tn": 40, "fp": 10}
    assert sum(x.pct for x in evaluate.cell_shares(evaluate.confusion(df)).collect()) == pytest.approx(100)


def test_reports(spark):
    p = spark.createDataFrame([("금리 인상", 3.0, 0.1, 30), ("금리", 2.0, 0.1, 30), ("x", 2.7, 0.2, 30), ("y", 2.7, 0.2, 30), ("물가", -3.0, 0.1, 30)], "ngram string, mean_score double, std_score double, num_iterations int")
    assert [r.ngram for r in reports.top(p, 2).collect()] == ["금리 인상", "x"]
    assert {r.ngram for r in containment.drop_contained(p).collect()} == {"금리 인상", "x", "y", "물가"}
    assert {r.ngram for r in reports.discriminative(p).collect()} == {"금리 인상", "금리", "x"}
    assert {r.ngram for r in reports.discriminative(p, by_scores=False).collect()} == {"금리 인상", "금리", "x", "y"}
    assert {(r.theme, r.ngram) for r in reports.theme_top(p, k=1).collect()} == {("정책/금리", "금리 인상"), ("물가/성장", "물가")}
    docs = spark.createDataFrame([("a" * 3000, "u"), ("b", "u"), ("", "v"), (None, "")], "content string, url string")
    r = reports.quality_audit(docs).first()
    assert (r.total, r.missing, r.truncated, r.duplicate_urls, r.unique_urls, r.median_length) == (4, 2, 1, 1, 2, 1500.5)
    assert r.score == pytest.approx(100 - 20 * 2 / 4 - 10 / 4 - 10 / 4) and r.grade == "good"
    assert reports.quality_audit(docs.limit(0)).first().total == 0


def test_rate_windows(spark):
    series = spark.createDataFrame([(D(2024, 1, 1), 3.0), (D(2024, 1, 20), 3.25), (D(2024, 1, 21), 3.25)], "date date, rate double")
    assert [r.change_text for r in relational.rate_changes(series).orderBy("date").collect()] == ["-", "+0.25%p", "-"]
    assert [r.gap for r in relational.date_gaps(series).collect()] == [19]
    assert [r.previous_rate for r in relational.latest_rates(series).orderBy("date").collect()] == [None, 3.0, 3.25]


def test_pipeline(spark):
    r = random.Random(3)
    words = {0: ["easing", "cut", "slow"], 1: ["hike", "tight", "hot"]}
    docs = [("yonhap", D(2024, 1, 1) + dt.timedelta(i % 60), "t", ". ".join(f"Market {r.choice(words[i % 60 < 30])} {r.choice(words[i % 60 < 30])} noise{r.randrange(5)}" for _ in range(4)), i) for i in range(240)]
    rates = [(D(2024, 1, 1), 1.0), (D(2024, 2, 1), 2.0), (D(2024, 3, 1), 1.0)]
    own = spark.createDataFrame(docs, "source string, date date, title string, content string, ingest_order int")
    corpus = pipeline.corpus([own], spark.createDataFrame(rates, "date date, rate double"))
    settings = pipeline.Settings(minimum=5, high=2, iterations=4, skip_english=False)
    rows = pipeline.ngram_rows(pipeline.sentence_rows(corpus), settings)
    assert pipeline.sentence_statistics(pipeline.sentence_rows(corpus)).first().documents == corpus.count()
    result = pipeline.train(rows, settings)
    scores = {x.ngram: x.mean_score for x in result.polarity.collect()}
    assert scores["hike"] > 0 > scores["cut"] and result.by_iteration.count() == 4
    assert result.honest.first().f1 > 0.9 and result.ensemble.first().f1 > 0.9


def plain_topics(docs, k, passes, start):
    """Batch variational EM, document by document and number by number."""
    psi = lambda x: float(topics.digamma(np.array([x]))[0])
    weights = {t: list(start[t]) for t in start}
    words = [Counter(d) for d in docs]

    def e_step(c, totals):
        beta = {t: [math.exp(psi(x) - psi(s)) for x, s in zip(weights[t], totals, strict=True)] for t in c}
        gamma = [1.0] * k
        theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
        for _ in range(topics.STEPS):
            norm = {t: sum(x * y for x, y in zip(theta, beta[t], strict=True)) for t in c}
            new = [1 / k + theta[i] * sum(n * beta[t][i] / norm[t] for t, n in c.items()) for i in range(k)]
            change = sum(abs(a - b) for a, b in zip(new, gamma, strict=True)) / k
            gamma = new
            theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
            if change < topics.CLOSE:
                break
        norm = {t: sum(x * y for x, y in zip(theta, beta[t], strict=True)) for t in c}
        return gamma, {t: [n * theta[i] * beta[t][i] / norm[t] for i in range(k)] for t, n in c.items()}

    for _ in range(passes):
        totals = [sum(w[i] for w in weights.values()) for i in range(k)]
        sums = {t: [1 / k] * k for t in weights}
        for c in words:
            for t, x in e_step(c, totals)[1].items():
                sums[t] = [a + b for a, b in zip(sums[t], x, strict=True)]
        weights = sums
    totals = [sum(w[i] for w in weights.values()) for i in range(k)]
    gammas = [e_step(c, totals)[0] for c in words]
    return weights, [sum(g[i] / sum(g) for g in gammas) / len(docs) for i in range(k)]


def test_topics_brute(spark):
    r = random.Random(5)
    pools = [["rate", "hike", "bank"], ["rain", "sun", "wind"], ["rate", "sun"]]
    docs = [[r.choice(pools[i % 3]) for _ in range(r.randrange(0, 12))] for i in range(40)] + [["rate"] * 300, []]
    df = spark.createDataFrame([(i % 7, d) for i, d in enumerate(docs)], "doc_id int, tokens array<string>").repartition(3)
    counts = spark.createDataFrame([(i, t, n) for i, d in enumerate(docs) for t, n in Counter(d).items()], "doc long, token string, n long")
    start = {x.token: x.w for x in topics.fit(counts, 3, 0).collect()}
    assert len({tuple(w) for w in start.values()}) == len(start) == 6
    weights, mean = plain_topics(docs, 3, 4, start)
    got = {x.token: x.w for x in topics.fit(counts, 3, 4).collect()}
    assert got.keys() == weights.keys() and all(got[t] == pytest.approx(weights[t], rel=1e-6) for t in got)
    assert [x.weight for x in topics.topics(df, "doc_id", k=3, passes=4).orderBy("topic").collect()] == pytest.approx(mean, rel=1e-6)
    assert topics.topics(df.limit(0), "doc_id", k=3, passes=1).collect() == []


def test_digamma():
    x = np.array([1e-3, 0.5, 1.0, 2.0, 10.0, 1e6])
    assert topics.digamma(x) == pytest.approx([-1000.5755719318103, -1.9635100260214235, -0.5772156649015329, 0.42278433509846714, 2.2517525890667211, 13.815510057964191], rel=1e-9)


def test_topics_exchange_blocks(spark, monkeypatch):
    """A pass exchanges a few rows a block and part, not one for each token of each document; parts don't change the result."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.sample([f"w{x}" for x in range(300)], 60)) for i in range(100)], "doc_id int, tokens array<string>").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        seq = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(seq.apply, range(seq.size()))}

    before, found = set(stages()), []
    for part in (1 << 17, 100):
        monkeypatch.setattr(topics, "PART", part, raising=False)
        found.append([x.weight for x in topics.topics(df, "doc_id", k=3, passes=3).orderBy("topic").collect()])
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert found[0] == pytest.approx(found[1], rel=1e-6) and sum(found[0]) == pytest.approx(1)
    assert sum(n for i, n in stages().items() if i not in before) < 3000  # of 6,000 tokens of documents in each of 8 passes


def test_topics_whole(spark, sf):
    got = catalogue.lda_topics(spark, sf).collect()
    assert sorted(r.topic for r in got) == list(range(30)) and sum(r.weight for r in got) == pytest.approx(1, abs=1e-4)


def test_frequent_bags_brute(spark):
    """Bags hold what is frequent and little else, whatever repeats: words, texts, ids."""
    random.seed(5)
    some = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(0, 40))) for _ in range(60)]
    docs = [(k % 50, t) for k, t in enumerate([*some, "x y z " * 3, "r s r s r", "q q q q", "", "lone word"])]
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    bags = defaultdict(Counter)
    for i, t in docs:
        w = t.split()
        for n in range(1, 6):
            for j in range(len(w) - n + 1):
                g = w[j : j + n]
                if all(a != b for a, b in zip(g, g[1:])) and (n <= 2 or max(Counter(g).values()) * 2 <= n):
                    bags[i][" ".join(g)] += 1
    total = sum(bags.values(), Counter())
    want = {(i, g): n for i, b in bags.items() for g, n in b.items() if total[g] >= 4}
    own = frequent.Candidates(frequent.words_table(df, F.col("text"), ["id"]), 4)
    got = {(r.id, r.ngram): r.tf for r in own.bags("id", names=True).collect()}
    assert want.items() <= got.items() and len(got) < 1.1 * len(want) < 0.5 * sum(map(len, bags.values()))
    hashed = own.bags("id").collect()
    assert Counter(r.id for r in hashed) == Counter(i for i, _ in got) and len({r.ngram for r in hashed}) == len({g for _, g in got})
    assert {r.id: (r.kinds, r.mass) for r in frequent.masses(own, "id").collect()} == {i: (sum(k == i for k, _ in want), sum(n for (k, _), n in want.items() if k == i)) for i in {k for k, _ in want}}


def test_groups_over_slices(spark, monkeypatch):
    """Groups that are cut by batches and slices stay whole."""
    import pyarrow as pa

    monkeypatch.setattr(frequent, "ROWS", 7)
    grams = sorted(random.Random(3).choices(range(12), k=100))
    batches = [pa.record_batch([pa.array(grams[i : i + 3]), pa.array([1] * len(grams[i : i + 3]))], ["ngram", "tf"]) for i in range(0, 100, 3)]
    seen = [set(zip(g.tolist(), t["ngram"].to_pylist())) for t, g in frequent._groups(8, iter(batches))]
    kept = [x for s in seen for _, x in s]
    assert all(len({g for g, _ in s}) == len(s) for s in seen) and sorted(kept) == [x for x, n in sorted(Counter(grams).items()) if n >= 8]


def test_kinds_brute(spark):
    """How many n-grams there are, and how many are frequent, without counting the rare ones one by one."""
    random.seed(6)
    docs = [" ".join(random.choice("abcdefghijkl") for _ in range(random.randrange(0, 30))) for _ in range(40)] + ["x y x y x", "x y x y x", "once"]
    total = Counter()
    for t in docs:
        w = t.split()
        grams = [w[j : j + n] for n in range(1, 6) for j in range(len(w) - n + 1)]
        total.update(" ".join(g) for g in grams if all(a != b for a, b in zip(g, g[1:])) and (len(g) <= 2 or max(Counter(g).values()) * 2 <= len(g)))
    df = spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)
    own = frequent.Candidates(frequent.words_table(df, F.col("text"), [], merge=False), 2, often=6)
    assert (own.kinds, own.often) == (len(total), sum(n >= 6 for n in total.values()))


@pytest.mark.parametrize("smooth,splitted", [(True, True), (True, False), (False, False)])
def test_sums_brute(spark, smooth, splitted):
    """Sums of log probabilities and totals of one exchange, against a loop over rows, n-grams and iterations."""
    random.seed(8)
    docs = [(i, None if i == 7 else i % 2, " ".join(random.choice("abcdefg") for _ in range(random.randrange(0, 12)))) for i in range(130)]
    n = 25 if splitted else 1
    tests = (lambda ids: frequent.tests_by_modulus(ids, 25)) if splitted else None
    held = {i: {int(x) for x in frequent.tests_by_modulus(np.array([i]), 25)[0] if x >= 0} if splitted else set() for i, _, _ in docs}
    if splitted:
        masks = spark.range(130).select("id", splits.by_modulus(F.col("id"), 25).alias("m")).collect()
        assert held == {r.id: {k for k in range(25) if r.m >> k & 1} for r in masks}
    df = spark.createDataFrame(docs, "id long, label int, text string").repartition(5)
    own = frequent.Candidates(frequent.words_table(df, F.col("text"), ["id", "label"]), 6)
    got, t = frequent.sums(own, n, "id", tests, smooth)
    bags = {}
    for r in own.bags("id", names=True).collect():
        bags.setdefault(r.id, {})[r.ngram] = r.tf
    every = sum(map(Counter, bags.values()), Counter())
    bags = {i: kept for i, b in bags.items() if (kept := {g: x for g, x in b.items() if every[g] >= 6})}
    label = {i: int(y != 0) for i, y, _ in docs}
    want = {}
    for k in range(n):
        c = [Counter(), Counter()]
        for i, b in bags.items():
            if k not in held[i]:
                c[label[i]].update(b)
        size, total = len(c[0] | c[1]), [sum(x.values()) for x in c]
        assert t[:, k].tolist() == [*total, size]
        for i, b in bags.items():
            if k in held[i] or not splitted:
                p = [(lambda g, y=y: (c[y][g] + 1) / (total[y] + size)) if smooth else (lambda g, y=y: max(c[y][g] / total[y], 1e-100)) for y in (0, 1)]
                want[i, k] = [sum(x * math.log(p[y](g)) for g, x in b.items() if c[0][g] + c[1][g]) for y in (0, 1)]
    rows = got.collect()
    assert {(r.id, r.iter) for r in rows} == want.keys() and len(rows) == len(want)
    assert all([r.s0, r.s1] == pytest.approx(want[r.id, r.iter], rel=1e-9) for r in rows)
    assert {r.id: r.label for r in rows} == {i: y for i, y, _ in docs if i in bags}


def test_polarity_brute(spark):
    """Counts by hashes and names by themselves give the lexicon of splits.polarity."""
    random.seed(9)
    docs = [(i, i % 3 % 2, " ".join(random.choice("abcdefg") for _ in range(random.randrange(0, 12)))) for i in range(130)]
    df = spark.createDataFrame(docs, "id long, label int, text string").withColumn("tested", splits.by_modulus(F.col("id"))).repartition(5)
    own = frequent.Candidates(frequent.words_table(df, F.col("text"), ["label", "tested"], merge=False), 6)
    bags = own.bags("label", "tested", names=True)
    often = bags.groupBy("ngram").agg(F.sum("tf").alias("n")).filter("n >= 6")
    want = {r.ngram: r for r in splits.polarity(splits.models(splits.counts(vocabulary.restrict(bags, often)))).collect()}
    got = frequent.polarity(own, 30).collect()
    assert {r.ngram for r in got} == want.keys() and len(got) == len(want) > 40
    for r in got:
        w = want[r.ngram]
        assert (r.num_iterations, r.stance) == (w.num_iterations, w.stance) and [r.mean_score, r.std_score] == pytest.approx([w.mean_score, w.std_score], abs=1e-9)
    names = own.names().collect()
    assert len(names) == len({r.h for r in names}) == len({r.ngram for r in bags.select("ngram").collect()})
