"""Helpers shared by the training-data operators: scratch tables, skew-safe joins and numpy text kernels.

The kernels read the bytes of an Arrow string column directly. UTF-8 keeps every byte of a non-ASCII character at
0x80 or above, so classes of ASCII characters can be decided byte by byte.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; bounds the temporary arrays of a worker.
CHUNK = 1 << 19
#: A group of more than this share of all rows is hot; there can be at most 1 / HOT of them.
HOT = 0.001
#: Bits of the largest bitmap that is broadcast: 32 MB.
MAX_BITS = 1 << 28


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, since single texts can be very long, and let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, safe for groups that hold a large share of all rows.

    Groups of more than HOT of the total are at most 1 / HOT many, so they are broadcast; their rows then go through
    the second join under a key of their own each (from column spread), so no task gets a hot group.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) > max(8, int(total * HOT)))
    hot = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = groups.filter(F.col(size) <= max(8, int(total * HOT)))
    cold = cold.select(*[F.col(k).alias(f"_cold_{k}") for k in keys], *[F.col(c).alias(f"_cold_{c}") for c in values])
    both = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.col(f"_hot_{size}").isNotNull()
    both = both.withColumn("_spread", F.when(is_hot, F.xxhash64(F.lit("spread"), spread)).otherwise(F.lit(0)))
    on = [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_spread") == F.col("_zero")]
    both = both.join(cold.withColumn("_zero", F.lit(0).cast("long")), on, "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Adds _maybe: false only where no row of `wanted` has this key, so that others need not be shuffled.

    A bitmap of about eight bits per wanted row is broadcast, of at most MAX_BITS whatever the tables; beyond, more rows
    are true, and results stay the same.
    """
    bits = min(max(1 << 20, 1 << (8 * wanted.count()).bit_length()), MAX_BITS)
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    bitmap = wanted.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bitmap"))
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    both = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), "_bucket", "left")
    return both.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("_maybe"))


def within(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Semi-join, for which only rows that may have a partner are shuffled."""
    return maybe_in(rows, wanted, key).filter("_maybe").drop("_maybe").join(wanted, key, "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Anti-join, for which only rows that may have a partner are shuffled."""
    own = maybe_in(rows, gone, key)
    return own.filter("not _maybe").drop("_maybe").union(own.filter("_maybe").drop("_maybe").join(gone, key, "left_anti"))


def left_join_some(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a scratch table of one row a key, for which only rows that may have a partner are shuffled."""
    own = maybe_in(rows, table, keys[-1])
    new = [f for f in table.schema if f.name not in keys]
    hit = own.filter("_maybe").drop("_maybe").join(table.hint("shuffle_hash"), keys, "left").select(*rows.columns, *[f.name for f in new])
    rest = own.filter("not _maybe").select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    return hit.union(rest)


def with_row_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds t1 and t2, 128 bits that tell rows apart by id and text."""
    return docs.withColumns({"t1": F.xxhash64(doc_id, text), "t2": F.xxhash64(F.lit("again"), text, doc_id)})


def keep_rows(docs: DataFrame, marks: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows that may stay, with all their columns. marks: t1, t2, size, stays, at most one row per t1 and t2.

    Rows without a mark stay, those marked otherwise go, and of `size` rows that share a mark that stays, one stays.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    id_, text_ = (names[docs.columns.index(c)] for c in (doc_id, text))
    own = with_row_hashes(own, id_, text_).withColumn("_row", F.monotonically_increasing_id())
    marks = scratch(marks.filter("size > 1 or not stays"), "marks")
    again = marks.filter("stays").limit(1).count()
    own = maybe_in(own, marks, "t1")
    both = join_groups(own.filter("_maybe"), marks, ["t1", "t2"], "size", "_row", docs.count())
    out = own.filter("not _maybe").select(*names).union(both.filter("size is null").select(*names))
    if again:
        one = both.filter("stays").groupBy("t1", "t2").agg(F.first(F.struct(*names)).alias("row"))
        out = out.union(one.select("row.*"))
    return out.toDF(*docs.columns)


def keep_by_text(docs: DataFrame, text: str, decide: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows whose texts decide() accepts, with all their columns, in one pass without a shuffle."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    text_ = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches, text_):
            yield batch.filter(pa.array(decide(raw, off), pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


# --- numpy text kernels -------------------------------------------------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about CHUNK bytes of text each, with bytes and offsets."""
    for batch in batches:
        raw, off = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1))
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text in lower case.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more at the end)."""
    inside = table[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < len(raw))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process. Long texts are taken in pieces of CHUNK bytes."""
    h = np.zeros(len(starts), np.uint64)
    up = np.uint64(1)  # the base to the power of the piece's place
    carry = np.uint64(0)
    with np.errstate(over="ignore"):
        for a in range(0, len(raw), CHUNK):
            piece = raw[a : a + CHUNK]
            n = len(piece)
            total = np.empty(n + 1, np.uint64)
            total[0] = carry
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(_B, n)[:n] * up, out=total[1:])
            total[1:] += carry
            s, e = (np.searchsorted(x, [a, a + n]) for x in (starts, ends - 1))
            # what a word has in this piece counts from its own start: the sum before it is taken off
            h[s[0] : s[1]] -= total[starts[s[0] : s[1]] - a]
            h[e[0] : e[1]] += total[ends[e[0] : e[1]] - a]
            carry = total[-1]
            up = up * _power(_B, CHUNK)[CHUNK]
        step = np.uint64(1)
        for a in range(0, len(raw), CHUNK):
            s = np.searchsorted(starts, [a, a + CHUNK])
            h[s[0] : s[1]] *= _power(_B_INV, CHUNK)[starts[s[0] : s[1]] - a] * step
            step = step * _power(_B_INV, CHUNK)[CHUNK]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one array (also those that cross texts: see inside())."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(_B, n)[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * _power(_B_INV, n)[: n - k + 1] + np.uint64(k))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one text; first as words() returns it."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n - k + 1, bool)
    counts = np.zeros(n + 1, np.int32)
    # a run that starts at i crosses into another text when a text begins in i+1 .. i+k-1
    marks = first[1:-1]
    marks = np.unique(marks[(marks > 0) & (marks < n)])
    if len(marks):
        np.add.at(counts, np.maximum(marks - k + 1, 0), 1)
        np.add.at(counts, marks, -1)
        ok = np.cumsum(counts)[: n - k + 1] == 0
    return ok
