"""Running numbers and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SOURCE_CODES
from ..session import shared_folder


def source_code(source: Column, codes: dict[str, str] | None = None) -> Column:
    """The digit of a source; null for others."""
    pairs = [F.lit(x) for kv in (codes or SOURCE_CODES).items() for x in kv]
    return F.create_map(*pairs)[source]


def source_of_link(link: Column) -> Column:
    """The source that an address names, in this order of priority."""
    return F.when(link.contains("infomax"), "infomax").when(link.contains("edaily"), "edaily").when(link.contains("yna"), "yonhap")


def surrogate_key(df: DataFrame, source: str, day: str, order: list, name: str = "pk") -> DataFrame:
    """Source digit, yyyyMMdd and the running number of that source and day, of three digits at least.

    Null where the source is unknown or there is no day.
    """
    n = F.row_number().over(Window.partitionBy(source, day).orderBy(*order))
    return df.withColumn(name, F.concat(source_code(F.col(source)), F.date_format(day, "yyyyMMdd"), F.format_string("%03d", n)))


def with_row_number(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """0, 1, 2, ... in a global order, without a window over one partition.

    Rows are range-sorted; the partitions' sizes (a row for each partition) give the offsets. The sorted rows are written
    to the shared folder first: sizes and rows would else come from two sorts, whose ranges are sampled, and merged by
    size, each on its own.
    """
    path = shared_folder(df.sparkSession, "ordered")
    ordered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    ordered = df.sparkSession.read.schema(ordered.schema).parquet(path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    out = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before")


def document_id(source: Column, day: Column, row: Column) -> Column:
    return F.concat_ws("_", source, F.date_format(day, "yyyyMMdd"), F.format_string("%06d", row))


def document_metadata(df: DataFrame, order: list, source: str = "source", date: str = "date") -> DataFrame:
    """Adds document_id (source, date without marks, running number of all rows), type, year, month and day, and the
    empty fields that later stages fill. year, month and day are null unless the date is written with its time.
    """
    out = with_row_number(df, order, "_row")
    stamp = F.translate(F.translate(date, " ", "_"), "-:", "")
    when = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd HH:mm:ss"))
    none = {c: F.lit(None).cast("double") for c in ("hawkish_score", "dovish_score", "sentiment_confidence", "call_rate", "call_rate_change")}
    labels = {c: F.lit(None).cast("string") for c in ("sentiment_label", "market_label")}
    lists = {c: F.array().cast("array<string>") for c in ("unigrams", "bigrams", "trigrams", "fourgrams", "fivegrams", "tokenized_content", "pos_tags", "filtered_tokens")}
    own = {"document_id": F.concat_ws("_", source, stamp, F.format_string("%06d", "_row")), "document_type": F.lit("news"), "year": F.year(when), "month": F.month(when), "day": F.day(when)}
    return out.withColumns(own | none | labels | lists).drop("_row")


def even_parts(df: DataFrame, order: list, parts: int = 10, name: str = "part") -> DataFrame:
    """Numbers 1 to `parts` in order, in parts whose sizes differ by one at most, without a window over one partition."""
    out = with_row_number(df, order, "_row")
    total = df.count()
    small, larger = total // parts, total % parts
    row = F.col("_row")
    inside = F.when(row < larger * (small + 1), F.floor(row / (small + 1))).otherwise(larger + F.floor((row - larger * (small + 1)) / max(small, 1)))
    return out.withColumn(name, (inside + 1).cast("long")).drop("_row")
