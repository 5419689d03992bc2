"""Evaluation: confusion matrix, metrics, precision-recall curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """0 for a zero denominator."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(pred) == p))
    return df.groupBy(*(keys or [])).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def metrics(df: DataFrame, keys: list[str] | None = None, **columns) -> DataFrame:
    """The four cells, accuracy, and precision, recall and F1 of class 1, and the macro and weighted F1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return confusion(df, keys, **columns).withColumns({
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": f1,
        "macro_f1": (f1 + f0) / 2,
        "weighted_f1": _ratio(f1 * (tp + fn) + f0 * (tn + fp), n),
    })


def cell_shares(cells: DataFrame) -> DataFrame:
    """class, predicted, n, share of all."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rows = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(c).alias("n"), (100.0 * F.col(c) / F.nullif(n, F.lit(0))).alias("pct")) for c, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    return cells.select(F.inline(rows))


#: Ranges of probabilities that are ordered on their own.
BINS = 4096


def _bin() -> Column:
    return F.least(F.floor(F.col("threshold") * BINS), F.lit(BINS - 1))


def pr_curve(df: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """threshold, precision, recall, f1 for each distinct probability, when that and more counts as class 1.

    Counts are grouped by threshold first. Running sums are within BINS ranges of probabilities, to which the sums of
    the higher ranges are added, so no task sorts all thresholds.
    """
    by = df.groupBy(F.col(proba).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_n"))
    by = by.withColumn("_bin", _bin())
    ranges = by.groupBy("_bin").agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    higher = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_bin", F.coalesce(F.sum("_ps").over(higher), F.lit(0)).alias("_pb"), F.coalesce(F.sum("_ns").over(higher), F.lit(0)).alias("_nb"), F.sum("_ps").over(every).alias("positives"))
    w = Window.partitionBy("_bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = by.join(F.broadcast(ranges), "_bin").withColumns({"tp": F.col("_pb") + F.sum("_p").over(w), "called": F.col("_nb") + F.sum("_n").over(w)})
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("positives"))
    return out.select("threshold", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """The area by trapezoids, from recall 0 at precision 1."""
    own = curve.select("threshold", "precision", "recall", _bin().alias("_bin"))
    # the point before a range's first one is the last of the range before it
    last = own.groupBy("_bin").agg(F.min(F.struct("threshold", "precision", "recall")).alias("_last"))
    order = Window.orderBy(F.desc("_bin"))
    last = last.select("_bin", F.lag("_last").over(order).alias("_last"))
    w = Window.partitionBy("_bin").orderBy(F.desc("threshold"))
    own = own.join(F.broadcast(last), "_bin")
    before = lambda c, start: F.coalesce(F.lag(c).over(w), F.col(f"_last.{c}"), F.lit(start))
    area = (F.col("recall") - before("recall", 0.0)) * (F.col("precision") + before("precision", 1.0)) / 2
    return own.select(area.alias("area")).agg(F.sum("area").alias("auc"))


def f1_summary(by_iteration: DataFrame, score: str = "f1") -> DataFrame:
    """One row: mean and population deviation of a score over the splits, and their number."""
    return by_iteration.agg(F.avg(score).alias("mean_f1"), F.stddev_pop(score).alias("std_f1"), F.count("*").alias("n"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The smallest threshold of the highest F1."""
    return curve.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1", "precision", "recall")


def cells_from_accuracy(total: int, accuracy: float, prevalence: float = 0.5) -> dict[str, int]:
    """A symmetric matrix that has the accuracy, for a display without the real one."""
    ones = round(total * prevalence)
    tp, tn = round(ones * accuracy), round((total - ones) * accuracy)
    return {"tp": tp, "fn": ones - tp, "tn": tn, "fp": total - ones - tn}
