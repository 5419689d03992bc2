"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added in log space: the likelihood of the page's main text under byte-trigram models of
the languages; the declared markup language and the address suffix, whose likelihoods are estimated from all pages by
grouped aggregation; and a host prior that is smoothed hierarchically: host towards its domain, the domain towards
all pages, each without the page that is judged, so that its own text counts once.

The text models are trained on at most SAMPLE documents of each language, those with the smallest hashes of their ids,
so rare languages have a model too; more than LANGUAGES labels are refused. Everything else covers all pages and whole
texts. Edge cases: pages without text, address or declaration lack that evidence only; a declaration is taken as it is
written, up to its first mark; without any labelled document every page is `und`; repeated rows each get a row; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .html_extract import BLOCK, main_text, tags
from .url_filter import parts

SAMPLE, LANGUAGES = 1_000, 1_000
BITS = 15
#: The text's mean log likelihood counts as that of so many independent trigrams at most.
TEXT_WEIGHT = 60
SMOOTH = 5.0

_LANG = re.compile(r"(?<![^\s\"'/])(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def declared(page: str) -> str:
    """The language that the html element names."""
    for tag, opens, attributes, _, _ in tags(page):
        if tag == "html" and opens and (m := _LANG.search(attributes)):
            return m[1].lower()
        if tag in BLOCK and tag not in ("html", "head"):
            break
    return ""


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts (spaces for digits, marks and white space), and which text each is of."""
    table = C.LOWER.copy()
    table[:0x61][~((np.arange(0x61) >= 0x41) & (np.arange(0x61) <= 0x5A))] = 0x20
    table[0x7B:0x80] = 0x20
    x = table[raw].astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (owner[:-2] == owner[2:]) & ~((x[:-2] == 0x20) & (x[1:-1] == 0x20))
    return h[ok].astype(np.int64), owner[:-2][ok]


class TextModel:
    """counts: language -> (hashes, occurrences)."""

    def __init__(self, counts: dict[str, tuple[list[int], list[int]]]):
        self.languages = sorted(counts)
        table = np.full((max(1, len(counts)), 1 << BITS), 0.05)
        for k, name in enumerate(self.languages):
            hashes, n = counts[name]
            table[k, hashes] += n
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def log_likelihoods(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per text and language: mean log likelihood times the number of trigrams, of which TEXT_WEIGHT count at most."""
        h, owner = trigrams(raw, off)
        n = np.bincount(owner, minlength=len(off) - 1)
        sums = np.stack([np.bincount(owner, weights=t[h], minlength=len(off) - 1) for t in self.log], axis=1)
        return sums / np.maximum(n, 1)[:, None] * np.minimum(n, TEXT_WEIGHT)[:, None]


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """docs: doc_id, text, lang."""
    C.tune(docs.sparkSession)
    known = docs.filter("lang is not null and doc_id is not null")
    if known.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # hashes below a language's bound are a little more than the sample, so that no task orders a whole language
    share = F.least(F.lit(1.0), (sample + 8 * sample**0.5 + 40) / F.col("n"))
    pairs = known.select("doc_id", "lang").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)))
    few = pairs.join(F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n"))), "lang").filter(F.col("h") < share * (1 << 32))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in C.chunks(batches, "text"):
            h, owner = trigrams(raw, off)
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            both, n = np.unique((code[owner].astype(np.int64) << BITS) | h, return_counts=True)
            lang = pa.array(names.tolist(), pa.string()).take(pa.array(both >> BITS))
            yield pa.RecordBatch.from_pydict({"lang": lang, "h": pa.array((both & ((1 << BITS) - 1)).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    # for each language `sample` ids at most, and 2 ** BITS counts, whatever the corpus
    own = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang")
    counts: dict[str, tuple[list[int], list[int]]] = {}
    for lang, h, n in own.mapInArrow(count, "lang string, h int, n long").groupBy("lang", "h").agg(F.sum("n")).toLocalIterator():
        hashes, sums = counts.setdefault(lang, ([], []))
        hashes.append(h)
        sums.append(n)
    return TextModel(counts)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def identify(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, host, lang, confidence, text_lang, declared."""
    C.tune(pages.sparkSession)
    names = model.languages
    host, _ = parts(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(page).alias("html"))
    kind = dict(own.dtypes)["page_id"]
    if not names:
        none = F.lit(None).cast("string")
        return own.select("page_id", "host", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in C.chunks(batches, "html"):
            blob = raw.tobytes()
            whole = [blob[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
            logs = model.log_likelihoods(*C.utf8(pa.array([main_text(x) for x in whole], pa.string())))
            said = [declared(x) for x in whole]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "host": batch.column("host"), "declared": pa.array(said, pa.string()), "logs": pa.array(list(logs.astype(float)), pa.list_(pa.float64()))})

    facts = own.mapInArrow(read, f"page_id {kind}, host string, declared string, logs array<double>")
    facts = facts.withColumns({"domain": domain_of(F.col("host")), "suffix": F.regexp_extract("host", r"[^.]*$", 0), "p": softmax(F.col("logs"))})
    facts = C.scratch(facts, "evidence")
    total = facts.count()
    mass = [F.sum(F.col("p")[k]).alias(f"m{k}") for k in range(len(names))]
    ms = [F.col(f"m{k}") for k in range(len(names))]
    everywhere = facts.agg(*mass).first()
    prior = [((everywhere[k] or 0.0) + 1) / (total + len(names)) for k in range(len(names))]
    def likelihood(key: str) -> DataFrame:
        """log P(value | language), smoothed towards the value's share of all pages."""
        got = facts.groupBy(key).agg(F.count("*").alias(f"n_{key}"), *mass)
        share = (F.col(f"n_{key}") + 1.0) / (total + 2.0)
        logs = F.array(*[F.log((m + SMOOTH * share) / (total * p + SMOOTH)) for m, p in zip(ms, prior, strict=True)])
        return got.select(key, f"n_{key}", F.when(F.col(key) == "", F.array(*[F.lit(0.0)] * len(names))).otherwise(logs).alias(f"l_{key}"))

    domains = C.scratch(facts.groupBy("domain").agg(F.count("*").alias("n_domain"), F.array(*mass).alias("m_domain")), "domains")
    hosts = C.scratch(facts.groupBy("host", "domain").agg(F.count("*").alias("n_host"), F.array(*mass).alias("m_host")), "hosts")
    hosts = C.join_groups(hosts, domains.withColumn("all_domain", F.col("n_domain")), ["domain"], "n_domain", "host", max(total, 1)).drop("domain", "n_domain")
    out = facts.select("page_id", "host", "declared", "suffix", "logs", F.col("p").alias("own"))
    for groups, key in ((hosts, "host"), (likelihood("declared"), "declared"), (likelihood("suffix"), "suffix")):
        out = C.join_groups(out, C.scratch(groups.withColumn("n", F.col(f"n_{key}")), key), [key], "n", "page_id", total).drop("n")
    above = F.array(*[F.lit(p) for p in prior])
    for key, n in (("domain", "all_domain"), ("host", "n_host")):
        others = F.zip_with(f"m_{key}", "own", lambda m, p: F.greatest(m - p, F.lit(0.0)))
        sums = F.zip_with(others, above, lambda m, p: m + SMOOTH * p)
        above = F.transform(sums, lambda x: x / (F.col(n) - 1 + SMOOTH))  # noqa: B023
    both = F.zip_with("logs", F.transform(above, lambda p: F.log(p)), lambda a, b: a + b)
    for column in ("l_declared", "l_suffix"):
        both = F.zip_with(both, column, lambda a, b: a + b)
    labels = F.array(*[F.lit(x) for x in names])
    at = lambda c: F.get(labels, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    out = out.withColumn("p", softmax(both))
    said = F.when(F.col("declared") != "", F.col("declared"))
    text = F.when(F.array_min("logs") < 0, at(F.col("logs")))
    return out.select("page_id", "host", at(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), text.alias("text_lang"), said.alias("declared"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(C.load(spark, sf_dir, "pages"), fit(C.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
