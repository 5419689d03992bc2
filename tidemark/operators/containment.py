"""Strings of a large set that are parts of others, found by equality instead of by a loop.

A string is a proper part of another one if it equals one of its shorter substrings. Each string gives its substrings of
the lengths that occur in the set; a bitmap of the set's hashes, of about eight bits a string and MAX_BITS at most, is
broadcast, so only substrings that may be members are exchanged; these meet the set by equality. No pair of strings is
ever made, and the work is linear in the number of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest bitmap: 32 MB.
MAX_BITS = 1 << 28


def members_bitmap(values: DataFrame, key: str) -> tuple[DataFrame, int]:
    """bucket and bitmap of the hashes of the values, and the number of bits."""
    bits = min(max(1 << 20, 1 << (8 * values.count()).bit_length()), MAX_BITS)
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return values.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bitmap")), bits


def maybe_member(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The rows but for those whose key is certainly none of the values, without an exchange of the rows."""
    bitmap, bits = members_bitmap(values, key)
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    both = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), "_bucket")
    return both.filter(hit).select(*rows.columns)


def _substrings(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of these lengths that are shorter than the text."""
    shorter = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.length(text))
    return F.array_distinct(F.flatten(F.transform(shorter, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n)))))


def contained(strings: DataFrame, column: str) -> DataFrame:
    """The strings (distinct, column of the same name) that are proper parts of another one. Null and empty ones are not looked at."""
    own = strings.select(column).filter(F.col(column) != "").distinct()
    lengths = sorted(r[0] for r in own.select(F.length(column)).distinct().collect())  # as many as the longest string has characters at most
    if len(lengths) < 2:
        return own.limit(0)
    parts = own.select(F.explode(_substrings(F.col(column), lengths)).alias(column))
    return maybe_member(parts, own, column).distinct().join(own, column, "left_semi")


def drop_contained(strings: DataFrame, column: str = "ngram") -> DataFrame:
    """The rows whose string isn't a proper part of another row's."""
    return strings.join(contained(strings, column), column, "left_anti").select(*strings.columns)
