"""Multinomial naive Bayes over long-form bags of n-grams: sentence-level and date-level. Repeated splits are in splits.py.

Priors are empirical (not smoothed), theta has Laplace smoothing, and the vocabulary is what occurs in the training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPSILON, floored, log_or_minus_infinity, probability_of_one

# Iterations, test share and the first seed.
ITERATIONS, TEST_SHARE, SEED = 30, 0.1, 33


def stratified_test(rows: DataFrame, label: str, row_id: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds in_test: the share of each class with the smallest digests of seed and id, the same in every engine.

    The cut is found from the counts of the digests' first digits, so no class is sorted in one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id)))
    bucket = F.substring(h, 1, 3)
    keyed = rows.withColumns({"_h": h, "_b": bucket})
    sizes = keyed.groupBy(label, "_b").agg(F.count("*").alias("_n"))  # 4096 rows for each class at most
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(label))})
    out = keyed.join(F.broadcast(sizes.drop("_n")), [label, "_b"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", row_id))
    return out.withColumn("in_test", place <= F.round(F.col("_all") * share)).select(*rows.columns, "in_test")


def class_counts(bags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ngram, count_0, count_1; every label other than 0 counts as 1."""
    return bags.groupBy(*(keys or []), "ngram").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("tf"))), F.lit(0)).alias("count_0"),
        F.coalesce(F.sum(F.when((F.col("label") != 0) | F.col("label").isNull(), F.col("tf"))), F.lit(0)).alias("count_1"),
    )


def theta(counts: DataFrame, keys: list[str] | None = None, alpha: float = 1.0) -> DataFrame:
    """Adds log_theta_0, log_theta_1 and polarity (their difference: positive for class 1)."""
    keys = keys or []
    totals = counts.groupBy(*keys).agg(F.sum("count_0").alias("_t0"), F.sum("count_1").alias("_t1"), F.count("*").alias("_v"))
    out = counts.join(F.broadcast(totals), keys) if keys else counts.join(F.broadcast(totals))  # a row for each key, or one
    logs = [F.log((F.col(f"count_{k}") + alpha) / (F.col(f"_t{k}") + alpha * F.col("_v"))) for k in (0, 1)]
    out = out.withColumns({"log_theta_0": logs[0], "log_theta_1": logs[1]}).withColumn("polarity", F.col("log_theta_1") - F.col("log_theta_0"))
    return out.drop("_t0", "_t1", "_v")


def priors(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """prior_0, prior_1: the classes' shares of the rows."""
    return rows.groupBy(*(keys or [])).agg(F.avg((F.col("label") == 0).cast("double")).alias("prior_0"), F.avg((F.col("label") == 1).cast("double")).alias("prior_1"))


def predict(rows: DataFrame, bags: DataFrame, model: DataFrame, prior: DataFrame, row_id: str, keys: list[str] | None = None) -> DataFrame:
    """Adds l0, l1, pred and proba. Unknown n-grams are ignored; rows without a known one have the priors; a tie is class 0."""
    keys = keys or []
    known = bags.join(model.select(*keys, "ngram", "log_theta_0", "log_theta_1"), [*keys, "ngram"])
    sums = known.groupBy(*keys, row_id).agg(*[F.sum(F.col("tf") * F.col(f"log_theta_{k}")).alias(f"_s{k}") for k in (0, 1)])
    return predict_by_sums(rows.join(sums.withColumnsRenamed({"_s0": "s0", "_s1": "s1"}), [*keys, row_id], "left"), prior, keys)


def predict_by_sums(sums: DataFrame, prior: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """l0, l1, pred and proba in place of s0 and s1, the sums of the known n-grams' log probabilities."""
    out = sums.join(F.broadcast(prior), keys) if keys else sums.join(F.broadcast(prior))
    logs = {f"l{k}": log_or_minus_infinity(F.col(f"prior_{k}")) + F.coalesce(f"s{k}", F.lit(0.0)) for k in (0, 1)}
    out = out.withColumns(logs)
    return out.withColumns({"pred": F.when(F.col("l1") > F.col("l0"), 1).otherwise(0), "proba": probability_of_one(F.col("l0"), F.col("l1"))}).drop("s0", "s1", "prior_0", "prior_1")


def vote(predictions: DataFrame, row_id: str) -> DataFrame:
    """The ensemble: mean vote of 0.5 or more is class 1, and the mean probability."""
    out = predictions.groupBy(row_id, "label").agg(F.avg("pred").alias("mean_vote"), F.avg("proba").alias("proba"))
    return out.withColumn("pred", F.when(F.col("mean_vote") >= 0.5, 1).otherwise(0))


def probability_table(bags: DataFrame, minimum: int = 5, epsilon: bool = True) -> DataFrame:
    """The date-level model: ngram, counts, sum, unsmoothed probabilities of n-grams of a minimum frequency.

    With epsilon zero becomes 1e-100; without, it stays and its log counts as minus infinity.
    """
    return table_of(class_counts(bags).filter(F.col("count_0") + F.col("count_1") >= minimum), epsilon)


def table_of(counts: DataFrame, epsilon: bool = True) -> DataFrame:
    """The table of counts that have been filtered."""
    counts = counts.withColumn("sum", F.col("count_0") + F.col("count_1"))
    totals = counts.agg(F.sum("count_0").alias("_t0"), F.sum("count_1").alias("_t1"))
    p = {f"prob_{k}": F.col(f"count_{k}") / F.nullif(f"_t{k}", F.lit(0)) for k in (0, 1)}
    out = counts.join(F.broadcast(totals)).withColumns(p).drop("_t0", "_t1")
    return out.withColumns({k: floored(F.col(k)) for k in p}) if epsilon else out


def mass_priors(table: DataFrame) -> DataFrame:
    """Priors from the n-gram mass after the frequency filter."""
    both = F.sum("count_0") + F.sum("count_1")
    return table.agg((F.sum("count_0") / both).alias("prior_0"), (F.sum("count_1") / both).alias("prior_1"))


def predict_by_table(rows: DataFrame, bags: DataFrame, table: DataFrame, prior: DataFrame, row_id: str) -> DataFrame:
    model = table.select("ngram", *[log_or_minus_infinity(F.col(f"prob_{k}")).alias(f"log_theta_{k}") for k in (0, 1)])
    return predict(rows, bags, model, prior, row_id)


def tone(sentences: DataFrame, row_id: str, pred: Column | None = None) -> DataFrame:
    """(hawkish - dovish) / (hawkish + dovish) sentences of a document."""
    pred = F.col("pred") if pred is None else pred
    h, d = F.count_if(pred == 1), F.count_if(pred == 0)
    return sentences.groupBy(row_id).agg(((h - d) / F.nullif(h + d, F.lit(0))).alias("tone"), h.alias("hawkish"), d.alias("dovish"))
