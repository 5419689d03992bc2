"""Repeated splits as arrays: one row an n-gram, with the models of all iterations inside it.

Which iterations test a row is a bit mask of the row (`tested`), a function of its id alone. One grouping of the bags by
n-gram sums the total counts and, for each iteration, the counts of the rows that it tests; an iteration's training
counts are their difference. From these each row computes all its smoothed log probabilities, so no n-gram is repeated
for each iteration and nothing is exchanged by iteration. Scoring joins a row of a bag once with its n-gram's models and
sums one array per document; a row is repeated for the iterations that test it only at the very end.

Up to MOST iterations fit a mask. An n-gram that the training rows of an iteration lack is null there, and ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log_or_minus_infinity, probability_of_one
from .bayes import ITERATIONS, SEED, TEST_SHARE

MOST = 62
#: Hexadecimal digits of a digest that decide about one iteration.
DIGITS = 4


def _checked(iterations: int) -> int:
    if not 0 < iterations <= MOST:
        raise ValueError(f"1 to {MOST} iterations fit a mask")
    return iterations


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def _bit(mask: Column | str, i: int) -> Column:
    return (F.col(mask) if isinstance(mask, str) else mask).bitwiseAND(F.lit(1 << i)) != 0


def by_modulus(row_id: Column, iterations: int = ITERATIONS, modulus: int = 10) -> Column:
    """The mask of bayes.tests_by_modulus: every round of `modulus` iterations tests a row once."""
    higher = F.floor(row_id / F.lit(modulus))
    bits = []
    for first in range(0, _checked(iterations), modulus):
        i = first + F.pmod(row_id + (first // modulus) * higher, F.lit(modulus))
        bits.append(F.when(i < iterations, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return _sum(bits)


def by_digest(key: Column, iterations: int = ITERATIONS, share: float = TEST_SHARE, seed: int = SEED) -> Column:
    """In each iteration an independent share of the rows, by the MD5 digests of seed and key, which every engine has.

    The share is met in expectation, in steps of 1 / 65,536; classes are treated alike, since no digest depends on them.
    """
    below = round(share * 16**DIGITS)
    each = 32 // DIGITS
    digests = [F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), key)) for k in range(-(-_checked(iterations) // each))]
    if below >= 16**DIGITS:
        return F.lit((1 << iterations) - 1)
    hits = [F.substring(digests[i // each], 1 + i % each * DIGITS, DIGITS) < f"{below:0{DIGITS}x}" for i in range(iterations)]
    return _sum([F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, hit in enumerate(hits)])


def counts(bags: DataFrame, tested: str = "tested", iterations: int = ITERATIONS) -> DataFrame:
    """ngram, count_0 and count_1: the training counts of all iterations. bags: label, ngram, tf, tested; labels other than 0 are class 1."""
    tf = {"0": F.when(F.col("label") == 0, F.col("tf")).otherwise(0), "1": F.when(F.col("label") == 0, 0).otherwise(F.col("tf"))}
    own = bags.select("ngram", F.col(tested).alias("_m"), *[c.cast("long").alias(f"_c{k}") for k, c in tf.items()])
    held = {k: [F.sum(F.when(_bit("_m", i), F.col(f"_c{k}")).otherwise(0)) for i in range(_checked(iterations))] for k in tf}
    return own.groupBy("ngram").agg(*[F.array(*[F.sum(f"_c{k}") - h for h in held[k]]).alias(f"count_{k}") for k in tf])


def models(counts: DataFrame, iterations: int = ITERATIONS, alpha: float = 1.0) -> DataFrame:
    """ngram, theta_0 and theta_1: the smoothed log probabilities of each iteration, null where its vocabulary lacks the n-gram."""
    at = lambda k, i: F.get(F.col(f"count_{k}"), i)
    known = [at(0, i) + at(1, i) > 0 for i in range(_checked(iterations))]
    totals = counts.agg(
        *[F.array(*[F.sum(at(k, i)) for i in range(iterations)]).alias(f"_t{k}") for k in (0, 1)],
        F.array(*[F.count_if(x) for x in known]).alias("_v"),
    )
    out = counts.join(F.broadcast(totals))  # one row
    theta = lambda k, i: F.log((at(k, i) + alpha) / (F.get(F.col(f"_t{k}"), i) + alpha * F.get(F.col("_v"), i)))
    return out.select("ngram", *[F.array(*[F.when(known[i], theta(k, i)) for i in range(iterations)]).alias(f"theta_{k}") for k in (0, 1)])


def priors(rows: DataFrame, tested: str = "tested", iterations: int = ITERATIONS) -> DataFrame:
    """One row: prior_0 and prior_1, the classes' shares of the training rows of each iteration."""
    left = lambda k, i: F.count_if((F.col("label") == k) & ~_bit(tested, i))
    n = rows.agg(*[F.array(*[left(k, i) for i in range(_checked(iterations))]).alias(f"n{k}") for k in (0, 1)])
    share = lambda k: F.zip_with(f"n{k}", f"n{1 - k}", lambda a, b: a / F.nullif(a + b, F.lit(0)))
    return n.select(share(0).alias("prior_0"), share(1).alias("prior_1"))


def polarity(models: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Mean and population deviation over the iterations, and how many had the n-gram; positive is hawkish."""
    own = models.select("ngram", F.array(*[F.get("theta_1", F.lit(i)) - F.get("theta_0", F.lit(i)) for i in range(_checked(iterations))]).alias("_p"))
    p = [F.get("_p", F.lit(i)) for i in range(iterations)]
    own = own.withColumn("num_iterations", _sum([x.isNotNull().cast("int") for x in p])).filter("num_iterations > 0")
    own = own.withColumn("mean_score", _sum([F.coalesce(x, F.lit(0.0)) for x in p]) / F.col("num_iterations"))
    off = [F.coalesce((x - F.col("mean_score")) * (x - F.col("mean_score")), F.lit(0.0)) for x in p]
    own = own.withColumn("std_score", F.sqrt(_sum(off) / F.col("num_iterations")))
    return own.select("ngram", "mean_score", "std_score", "num_iterations", F.when(F.col("mean_score") > 0, "hawkish").otherwise("dovish").alias("stance"))


def predict(rows: DataFrame, bags: DataFrame, models: DataFrame, prior: DataFrame, row_id: str, tested: str = "tested", iterations: int = ITERATIONS) -> DataFrame:
    """The rows for each iteration that tests them, with iter, l0, l1, pred and proba.

    Unknown n-grams are ignored; rows without a known one have the priors; a tie is class 0.
    """
    held = bags.filter(F.col(tested) != 0).select(row_id, "ngram", "tf", F.col(tested).alias("_m")).join(models, "ngram")
    term = lambda k, i: F.when(_bit("_m", i), F.col("tf") * F.coalesce(F.get(f"theta_{k}", F.lit(i)), F.lit(0.0))).otherwise(0.0)
    sums = held.groupBy(row_id).agg(*[F.array(*[F.sum(term(k, i)) for i in range(_checked(iterations))]).alias(f"_s{k}") for k in (0, 1)])
    out = rows.filter(F.col(tested) != 0).join(sums, row_id, "left").join(F.broadcast(prior))  # one row
    own = F.filter(F.sequence(F.lit(0), F.lit(iterations - 1)), lambda i: F.call_function("shiftright", F.col(tested), i).bitwiseAND(F.lit(1)) == 1)
    out = out.withColumn("iter", F.explode(own))
    logs = {f"l{k}": log_or_minus_infinity(F.get(f"prior_{k}", "iter")) + F.coalesce(F.get(f"_s{k}", "iter"), F.lit(0.0)) for k in (0, 1)}
    out = out.withColumns(logs).drop("_s0", "_s1", "prior_0", "prior_1", tested)
    return out.withColumns({"pred": F.when(F.col("l1") > F.col("l0"), 1).otherwise(0), "proba": probability_of_one(F.col("l0"), F.col("l1"))})
