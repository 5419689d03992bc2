"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

The addresses that rules accept and reject train two variable-order Markov models over a folded alphabet: contexts of
two, one and no characters, each weighed against the shorter one by how often and with how many different followers it
has occurred (Witten and Bell), so that rare contexts count little and unseen ones not at all. An address without a
rule is judged by the mean log-likelihood difference per character, against a threshold calibrated on the addresses
that rules decide. For that each of them is scored by models of the other half of the addresses (halves by md5 of host
and path), so none is judged by what it has trained. Everything is DataFrame operations.

The models have one row per character triple. The alphabet has 43 symbols, so that is 79,507 rows at most whatever
the corpus, which bounds the broadcast.

Edge cases: a null address or one without `://` has an empty host and path, and is judged by the model like any other;
without both accepted and rejected addresses the verdict is allow; repeated rows each get a row; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a-z, 0-9, four marks, one symbol for all else, and the marks of begin and end.
SYMBOLS = 43
#: Scores are calibrated on a grid of this step.
STEP = 0.01


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def triples(host: Column, path: Column) -> Column:
    """Every character of the folded address, and its end, with the two before it."""
    folded = F.regexp_replace(F.translate(F.concat(host, path), UPPER, LOWER), r"[^a-z0-9./_-]", "~")
    # an array of characters, since cutting a string at a place counts its characters from the start; within the outer
    # lambda it is computed once, not for each character
    letters = F.split(F.concat(F.lit("^^"), folded, F.lit("$")), "")
    return F.get(F.transform(F.array(letters), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))), 0)


#: The counts of a triple: among accepted and rejected addresses of each half.
COUNTS = ("allow0", "allow1", "block0", "block1")
#: Models by what they are trained on: everything, and all but one half.
MODELS = {"ratio": ("0", "1"), "ratio0": ("1",), "ratio1": ("0",)}


def log_ratio(counts: DataFrame) -> DataFrame:
    """w and for each model the log ratio of the probabilities of its last character after the two before it."""
    classes = {f"{v}_{m}": [f"{v}{h}" for h in halves] for m, halves in MODELS.items() for v in ("allow", "block")}
    own = counts.select("w", *[sum(F.col(c) for c in parts).alias(n) for n, parts in classes.items()])
    keys = {"two": F.substring("w", 1, 2), "pair": F.substring("w", 2, 2), "mid": F.substring("w", 2, 1), "last": F.substring("w", 3, 1)}
    own = own.withColumns(keys)
    add = lambda key: [F.sum(n).alias(f"{key}_{n}") for n in classes]
    kinds = lambda key, of: [F.count_if(F.col(of + n) > 0).alias(f"{key}_kinds_{n}") for n in classes]
    pairs = own.groupBy("pair", "mid").agg(*add("pair"))
    by = {
        "two": own.groupBy("two").agg(*add("two"), *kinds("two", "")),
        "pair": pairs.drop("mid"),
        "mid": pairs.groupBy("mid").agg(*[F.sum(f"pair_{n}").alias(f"mid_{n}") for n in classes], *kinds("mid", "pair_")),
        "last": own.groupBy("last").agg(*add("last")),
    }
    total = own.agg(*[F.sum(n).alias(n) for n in classes]).first()
    out = own
    for key, table in by.items():
        out = out.join(F.broadcast(table), key)  # 43 squared rows at most
    logs = {}
    for n in classes:
        p = (F.col(f"last_{n}") + 1.0) / (float(total[n] or 0) + SYMBOLS)
        for context, follower in (("mid", f"pair_{n}"), ("two", n)):
            seen, different = F.col(f"{context}_{n}"), F.col(f"{context}_kinds_{n}")
            p = F.when(seen > 0, (F.col(follower) + different * p) / (seen + different)).otherwise(p)
        logs[n] = F.log(p)
    return out.select("w", *[(logs[f"allow_{m}"] - logs[f"block_{m}"]).alias(m) for m in MODELS])


def threshold(scores: DataFrame) -> float | None:
    """The middle of the step of the grid at which the two kinds' error rates have the smallest sum; None without both kinds."""
    # scores are means of log ratios, clipped to [-10, 10]: 2,001 rows for each verdict at most
    grid = F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("other_score"))) / STEP).cast("int")
    rows = scores.filter("rule_verdict is not null").groupBy("rule_verdict", grid.alias("g")).agg(F.count("*").alias("n")).collect()
    kinds = {v: {r["g"]: r["n"] for r in rows if r["rule_verdict"] == v} for v in ("allow", "block")}
    n = {v: sum(x.values()) for v, x in kinds.items()}
    if not all(n.values()):
        return None
    steps = sorted({*kinds["allow"], *kinds["block"]})
    best, missed, passed = (2.0, 0.0), 0, n["block"]
    for below, g in zip([steps[0] - 1, *steps], steps, strict=False):
        best = min(best, (missed / n["allow"] + passed / n["block"], (below + g) / 2))
        missed += kinds["allow"].get(g, 0)
        passed -= kinds["block"].get(g, 0)
    return best[1] * STEP


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, and other_score, by models of the other half."""
    host, path = parts(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    half = (F.substring(F.md5(F.concat("host", "path")), 1, 1) >= "8").cast("int")
    own = own.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), half.alias("half"))
    # rows are numbered, so that characters travel with a number and not with their address
    own = C.scratch(own.withColumn("_row", F.monotonically_increasing_id()), "addresses")
    letters = own.select("_row", "half", "rule_verdict", F.explode(triples(F.col("host"), F.col("path"))).alias("w"))
    counts = [F.count_if((F.col("rule_verdict") == c[:-1]) & (F.col("half") == int(c[-1]))).alias(c) for c in COUNTS]
    ratios = log_ratio(C.scratch(letters.groupBy("w").agg(*counts), "triples"))
    other = F.when(F.col("half") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))
    means = letters.join(F.broadcast(ratios), "w").groupBy("_row").agg(F.avg("ratio").alias("score"), F.avg(other).alias("other_score"))
    scores = C.scratch(own.join(means, "_row").select("page_id", "host", "path", "rule", "rule_verdict", "score", "other_score"), "scores")
    limit = threshold(scores)
    model = F.lit("allow") if limit is None else F.when(F.col("score") >= limit, "allow").otherwise("block")
    return scores.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", model).alias("verdict"), "score", "other_score")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.load(spark, sf_dir, "pages")).drop("score", "other_score")


def _case(value) -> str:
    """The SQL of rule_of()."""
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in by_length) + " END"


def _models() -> str:
    """The columns of the two models that one choice of counts gives, as CTEs by name of the choice."""
    parts = []
    for m, halves in MODELS.items():
        sums = ", ".join(f"{' + '.join(v + h for h in halves)} AS {v}" for v in ("allow", "block"))
        windows = ", ".join(
            f"sum({v}) OVER (PARTITION BY substr(w, 1, 2)) AS two_{v}, count(*) FILTER ({v} > 0) OVER (PARTITION BY substr(w, 1, 2)) AS two_kinds_{v}, "
            f"sum({v}) OVER (PARTITION BY substr(w, 2, 2)) AS pair_{v}, sum({v}) OVER (PARTITION BY substr(w, 3, 1)) AS last_{v}, sum({v}) OVER () AS all_{v}"
            for v in ("allow", "block")
        )
        mids = ", ".join(f"sum({v}) AS mid_{v}, count(*) FILTER ({v} > 0) AS mid_kinds_{v}" for v in ("allow", "block"))
        p = {}
        for v in ("allow", "block"):
            x = f"(last_{v} + 1.0) / (all_{v} + {SYMBOLS})"
            for context, follower in (("mid", f"pair_{v}"), ("two", v)):
                x = f"CASE WHEN {context}_{v} > 0 THEN ({follower} + {context}_kinds_{v} * ({x})) / ({context}_{v} + {context}_kinds_{v}) ELSE {x} END"
            p[v] = x
        parts.append(f"""c_{m} AS (SELECT w, {sums} FROM counts), s_{m} AS (SELECT w, substr(w, 2, 1) AS mid, allow, block, {windows} FROM c_{m}),
  m_{m} AS (SELECT substr(pair, 1, 1) AS mid, {mids} FROM (SELECT substr(w, 2, 2) AS pair, sum(allow) AS allow, sum(block) AS block FROM c_{m} GROUP BY 1) GROUP BY 1),
  r_{m} AS (SELECT w, ln({p["allow"]}) - ln({p["block"]}) AS {m} FROM s_{m} JOIN m_{m} USING (mid))""")
    return ",\n  ".join(parts)


SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
  u AS (SELECT *, {_case(lambda h, p, v: h + p)} AS rule, {_case(lambda h, p, v: v)} AS decided, substr(md5(host || path), 1, 1) >= '8' AS half, '^^' || regexp_replace(translate(host || path, '{UPPER}', '{LOWER}'), '[^a-z0-9./_-]', '~', 'g') || '$' AS s FROM h),
  letters AS (SELECT page_id, host, path, rule, decided, half, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS w FROM u),
  counts AS (SELECT w, {", ".join(f"count(*) FILTER (decided = '{c[:-1]}' AND {'' if c[-1] == '1' else 'NOT '}half) AS {c}" for c in COUNTS)} FROM letters GROUP BY 1),
  {_models()},
  scores AS (SELECT page_id, host, path, rule, decided, avg(ratio) AS score, avg(CASE WHEN half THEN ratio1 ELSE ratio0 END) AS other_score FROM letters JOIN r_ratio USING (w) JOIN r_ratio0 USING (w) JOIN r_ratio1 USING (w) GROUP BY ALL),
  grid AS (SELECT CAST(round(greatest(-10.0, least(10.0, other_score)) / {STEP}) AS INT) AS g, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b FROM scores WHERE decided IS NOT NULL GROUP BY 1),
  loss AS (SELECT (coalesce(lag(g) OVER (ORDER BY g), g - 1) + g) / 2.0 AS middle,
      coalesce(sum(a) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(a) OVER (), 0)
      + sum(b) OVER (ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(b) OVER (), 0) AS loss FROM grid),
  cut AS (SELECT min_by(middle, (loss, middle)) * {STEP} AS least_score FROM loss WHERE loss IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score < least_score THEN 'block' ELSE 'allow' END) AS verdict FROM scores, cut
"""
