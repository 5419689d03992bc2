"""Labels from the forward change of a rate series.

The backward as-of lookup runs on distinct days: days and rates are united and the last rate is carried forward, so
the only unpartitioned window has one row for each day of the calendar, whatever the number of documents. The result
is joined back by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The horizon and the threshold. The comparison is in binary floating point.
MONTHS, THRESHOLD = 1, 0.03


def _as_of(days: DataFrame, rates: DataFrame) -> DataFrame:
    """day, rate: the rate of the latest date up to each day; null before the first one. days: day; rates: date, rate."""
    both = days.select("day", F.lit(1).alias("asks"), F.lit(None).cast("double").alias("rate"))
    both = both.unionByName(rates.select(F.col("date").alias("day"), F.lit(0).alias("asks"), F.col("rate").cast("double")))
    w = Window.orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rate", F.last("rate", ignorenulls=True).over(w)).filter("asks = 1").select("day", "rate")


def as_of(docs: DataFrame, rates: DataFrame, day: str = "date", name: str = "rate") -> DataFrame:
    """Adds the rate that was in effect on each row's day."""
    days = docs.select(F.col(day).alias("day")).filter("day is not null").distinct()
    found = _as_of(days, rates).withColumnsRenamed({"day": "_day", "rate": name})
    return docs.join(found, docs[day] == F.col("_day"), "left").drop("_day")


def direction(now: Column, later: Column, threshold: float = THRESHOLD) -> Column:
    """1 for a rise above the threshold, 0 for a fall below it, else null."""
    change = later.cast("double") - now.cast("double")
    return F.when(change > threshold, 1).when(change < -threshold, 0)


def forward_label(docs: DataFrame, rates: DataFrame, day: str = "date", months: int | None = MONTHS, days: int | None = None, threshold: float = THRESHOLD, censor_tail: bool = False) -> DataFrame:
    """Adds rate_now, rate_later and label; both lookups are as-of joins, at the day and at the horizon.

    Beyond the series' end the last rate counts, unless censor_tail asks for nulls there.
    """
    dates = docs.select(F.col(day).alias("day")).filter("day is not null").distinct()
    later = F.add_months("day", months) if days is None else F.date_add("day", days)
    pairs = dates.withColumn("later", later)
    asked = pairs.select("day").union(pairs.select("later")).distinct()
    found = _as_of(asked, rates)
    table = pairs.join(found.withColumnRenamed("rate", "rate_now"), "day").join(found.select(F.col("day").alias("later"), F.col("rate").alias("rate_later")), "later")
    if censor_tail:
        end = rates.agg(F.max("date").alias("_end"))
        table = table.join(F.broadcast(end)).withColumn("rate_later", F.when(F.col("later") <= F.col("_end"), F.col("rate_later"))).drop("_end")
    table = table.select(F.col("day").alias("_day"), "rate_now", "rate_later", direction(F.col("rate_now"), F.col("rate_later"), threshold).alias("label"))
    return docs.join(table, docs[day] == F.col("_day"), "left").drop("_day")


def exact_label(days: DataFrame, rates: DataFrame, day: str = "date", months: int = 2, threshold: float = 0.01) -> DataFrame:
    """An audit row for each day: the rates on the very day and months later, their difference, and the label as text."""
    own = rates.select(F.col("date").alias("_d"), F.col("rate"))
    out = days.select(F.col(day).alias("date")).distinct().withColumn("date_later", F.add_months("date", months))
    out = out.join(own.select(F.col("_d").alias("date"), F.col("rate").alias("rate_now")), "date", "left")
    out = out.join(own.select(F.col("_d").alias("date_later"), F.col("rate").alias("rate_later")), "date_later", "left")
    change = F.col("rate_later") - F.col("rate_now")
    return out.select("date", "date_later", "rate_now", "rate_later", change.alias("difference"), direction(F.col("rate_now"), F.col("rate_later"), threshold).cast("string").alias("label"))
