"""Numbers: smoothed and floored log probabilities, percentages, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the probability that stands for zero.
EPSILON = 1e-100


def laplace_log(n: Column, total: Column, size: Column, alpha: float = 1.0) -> Column:
    return F.log((n + alpha) / (total + alpha * size))


def floored(p: Column) -> Column:
    return F.when(p == 0, F.lit(EPSILON)).otherwise(p)


def log_or_minus_infinity(p: Column) -> Column:
    """SQL's log(0) is null; this one is minus infinity."""
    return F.when(p > 0, F.log(p)).when(p == 0, F.lit(float("-inf")))


def probability_of_one(l0: Column, l1: Column) -> Column:
    """From two joint log likelihoods."""
    return 1 / (1 + F.exp(F.least(l0 - l1, F.lit(700.0))))


def percent(rate: Column) -> Column:
    return F.format_string("%.2f%%", rate)


def signed_points(change: Column) -> Column:
    """`+0.25%p`, or `-` without a change."""
    return F.when(F.coalesce(change, F.lit(0.0)) == 0, F.lit("-")).otherwise(F.format_string("%+.2f%%p", change))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent, null for an empty whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def reduction(before: Column, after: Column) -> Column:
    return 100.0 * (before - after) / F.nullif(before, F.lit(0))


def md5_key(*columns: Column) -> Column:
    return F.md5(F.concat_ws("_", *columns))
