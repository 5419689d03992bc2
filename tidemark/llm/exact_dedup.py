"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of their normalised text; rows of lengths that occur once are settled. The others are
grouped by a hash of the first PREFIX characters too, and only rows of groups that survive both take part in the
grouping by the full hash. Texts are never shuffled: each step exchanges a few numbers per row, pre-aggregated, and
groups that hold a large share of the rows are joined by broadcast (see common.join_groups).

Normalised means without every character of `[\\x20\\x09-\\x0D]`. Edge cases: a null text counts as empty, and all
empty texts are equal; a group keeps its longest original text, then the smallest doc_id; ids may be of any type that
has an order, and null ones come last; rows that repeat the doc_id that stays are all marked as kept, of which
distinct_documents() returns one; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _grouped(docs: DataFrame, doc_id: str, text: str, prefix: int) -> tuple[DataFrame, DataFrame, int]:
    """Facts of every row; and of every group of equal texts its size and the row that stays."""
    own = C.with_row_hashes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    norm = own.select("doc_id", "t1", "t2", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    facts = norm.select("doc_id", "t1", "t2", "n_chars", F.octet_length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    facts = C.scratch(facts, "exact")
    total = facts.count()

    by_length = facts.groupBy("n").agg(F.count("*").alias("size")).filter("size > 1")
    by_length = C.scratch(by_length, "lengths")
    longs = C.join_groups(facts.select("t1", "n", "head"), by_length, ["n"], "size", "t1", total).filter("size is not null")
    by_head = longs.groupBy("n", "head").agg(F.count("*").alias("size")).filter("size > 1")
    by_head = C.scratch(by_head, "heads")
    alive = C.join_groups(facts, by_head, ["n", "head"], "size", "t1", total).filter("size is not null").drop("size")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2"))
    groups = alive.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")
    return facts, C.scratch(groups.select("sha", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.t1").alias("k1"), F.col("best.t2").alias("k2")), "equal"), total


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    facts, groups, total = _grouped(docs, doc_id, text, prefix)
    out = C.join_groups(facts.select("doc_id", "t1", "sha"), groups.drop("k1", "k2"), ["sha"], "size", "t1", total)
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    facts, groups, total = _grouped(docs, doc_id, text, prefix)
    rows = C.join_groups(facts.select("t1", "t2", "sha"), groups.drop("keep_id"), ["sha"], "size", "t1", total).filter("size is not null")
    stays = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    marks = rows.withColumn("stays", stays).groupBy("t1", "t2").agg(F.count("*").alias("size"), F.max("stays").alias("stays"))
    return C.keep_rows(docs, marks, doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(C.load(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS m FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY m ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY m) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY m ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(m) AS text_sha256
FROM n
"""
