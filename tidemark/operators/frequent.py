"""Bags of frequent n-grams without an exchange of the rare ones.

An n-gram is as rare as its rarest part. So n-grams are counted by length: those of n words only where both of their
parts of n - 1 words may be frequent. What is frequent is kept as one bitmap a length, of about 32 bits an n-gram and
MAX_BITS at most; false members cost room only, since every count is taken again, exactly. Of the texts' n-grams only
those in the bitmaps are exchanged, and the exchanges of one length are given up before the next.

N-grams are known by 64-bit hashes of their words where their names aren't needed, and by their names where they are.
Rows of a bag are then grouped in partitions sorted by n-gram (`by_group`), by numpy, a slice of whole groups at a time.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bits of the largest bitmap: 32 MB. Bits for each n-gram.
MAX_BITS, BITS_EACH = 1 << 28, 32
#: Bytes of text that one numpy step looks at, and rows of a bag that are grouped at a time.
TEXT, ROWS = 3 << 20, 1 << 18
HIGH = 5
#: The log of the least probability of a model without smoothing, as numeric.floored.
LEAST = float(np.log(1e-100))


def words_table(docs: DataFrame, words: Column, carry: list[str], merge: bool = True) -> DataFrame:
    """The carried columns and texts, each the words of a text joined by blanks; written.

    With merge one row for each value of the carried columns, else one for each text.
    """
    if not merge:
        return written(docs.select(*carry, F.array(words).alias("_t")).select(*carry, F.filter("_t", lambda t: t != "").alias("texts")), "words")
    texts = F.filter(F.collect_list("_t"), lambda t: t != "")  # a filter of rows would be moved below joins, and compute the words twice
    own = docs.select(*carry, words.alias("_t")).groupBy(*carry).agg(texts.alias("texts"))
    return written(own.filter(F.size("texts") > 0), "words")


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, and let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def release(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- kernels over texts ---------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(b["texts"].flatten()).to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(pc.list_value_length(b["texts"]).to_numpy(zero_copy_only=False))])])
        block = np.cumsum(sizes) // TEXT
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


class Words:
    """The words of a slice: values, numbers of equal words, hashes, and the texts and rows that they are in."""

    def __init__(self, texts: pa.ListArray):
        split = pc.split_pattern(texts.flatten(), " ")
        self.values = split.flatten()
        coded = self.values.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        kinds = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False)
        self.base = _mix(kinds + np.uint64(0x9E3779B97F4A7C15))[self.ids] if len(kinds) else np.empty(0, np.uint64)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        self.text = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        self.row = np.repeat(rows, counts)

    def valid(self, k: int) -> int:
        """How many valid n-grams of k words there are."""
        w, m = self.ids, len(self.ids) - k + 1
        if m <= 0:
            return 0
        ok = self.text[:m] == self.text[k - 1 :]
        for i in range(k - 1):
            ok = ok & (w[i : m + i] != w[i + 1 : m + i + 1])
        if k == 3:
            ok = ok & (w[:m] != w[2:])
        elif k == 5:
            ok = ok & ~((w[:m] == w[2 : m + 2]) & (w[2 : m + 2] == w[4:]))
        return int(ok.sum())

    def lengths(self, members: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length up to one more than there are bitmaps: it, the hashes at all places, where an n-gram without
        equal neighbours has frequent parts, and which of these places have a valid one."""
        n, h, parts = len(self.ids), self.base, None
        w = self.ids
        for k in range(1, min(len(members) + 1, HIGH) + 1):
            m = n - k + 1
            if m <= 0:
                return
            if k > 1:
                h = _mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + self.base[k - 1 :] + np.uint64(k))
                at = parts[:m] & parts[1 : m + 1] & (self.text[:m] == self.text[k - 1 :]) & (w[k - 2 : n - 1] != w[k - 1 :])
            else:
                at = np.ones(m, bool)
            valid = at
            if k == 3:
                valid = at & (w[:m] != w[2:])
            elif k == 5:  # of neighbours that differ, only a word at all odd places is too many
                valid = at & ~((w[:m] == w[2 : m + 2]) & (w[2 : m + 2] == w[4:]))
            yield k, h, at, valid
            if k <= len(members):
                parts = at.copy()
                parts[at] = _in(members[k - 1], h[at])


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _counted(members, rest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n, valid of the n-grams of the length after the bitmaps'. With rest, null has the number of valid ones with a rare part."""
    for b in _slices(batches):
        words, size = Words(b["texts"]), len(members) + 1
        if rest:
            rare = words.valid(size) - sum(int(valid.sum()) for k, _, _, valid in words.lengths(members) if k == size)
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([rare]), pa.array([True])], ["h", "n", "valid"])
        for k, h, at, valid in words.lengths(members):
            if k == len(members) + 1:
                for own, ok in ((valid, True), (at & ~valid, False)):
                    kinds, n = np.unique(h[own], return_counts=True)
                    if len(kinds):
                        yield pa.record_batch([pa.array(kinds.view(np.int64)), pa.array(n), pa.array(np.full(len(n), ok))], ["h", "n", "valid"])


def _bagged(members, carry: list[str], names: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The carried columns, ngram and tf of candidates; rows of a slice with equal ones are one."""
    for b in _slices(batches):
        words, numbers = Words(b["texts"]), {}
        code = np.array([numbers.setdefault(x, len(numbers)) for x in zip(*[b[c].to_pylist() for c in carry], strict=True)] if carry else [0] * b.num_rows)
        first = np.unique(code, return_index=True)[1]
        found = []
        for k, h, _, valid in words.lengths(members):
            at = np.flatnonzero(valid)
            at = at[_in(members[k - 1], h[at])]
            found.append((h[at], at, np.full(len(at), k, np.int8)))
        if not found:
            continue
        h, at, k = (np.concatenate(x) for x in zip(*found, strict=True))
        row = code[words.row[at]]
        order = np.lexsort((row, h))
        h, at, k, row = h[order], at[order], k[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)])
        if not len(start):
            continue
        tf = np.diff(np.concatenate([start, [len(h)]]))
        parts = [np.arange(len(start))] if not names else [np.flatnonzero(k[start] == n) for n in range(1, HIGH + 1)]
        for n, p in enumerate(parts, 1):
            if len(p):
                one = start[p]
                gram = pa.array(h[one].view(np.int64)) if not names else pc.binary_join_element_wise(*[words.values.take(pa.array(at[one] + i)) for i in range(n)], " ")
                rows = pa.array(first[row[one]])
                yield pa.record_batch([*[b[c].take(rows) for c in carry], gram, pa.array(tf[p])], [*carry, "ngram", "tf"])


def _named(members, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different hashes of a slice's candidates, and their names."""
    for b in _slices(batches):
        words = Words(b["texts"])
        for n, h, _, valid in words.lengths(members):
            at = np.flatnonzero(valid)
            at = at[_in(members[n - 1], h[at])]
            kinds, first = np.unique(h[at], return_index=True)
            if len(kinds):
                one = at[first]
                gram = pc.binary_join_element_wise(*[words.values.take(pa.array(one + i)) for i in range(n)], " ")
                yield pa.record_batch([pa.array(kinds.view(np.int64)), gram], ["h", "ngram"])


# --- tables ---------------------------------------------------------------------------------------------------------


class Candidates:
    """What may be frequent in a table of words: one broadcast bitmap a length.

    kinds: how many different valid n-grams there are; often: how many of them occur `often` times. Where the minimum is
    2, an n-gram with a rare part occurs once and is one more kind, so these are exact; else kinds is null.
    """

    def __init__(self, words: DataFrame, minimum: int, high: int = HIGH, often: int | None = None):
        self.words, self.minimum = words, minimum
        self.kinds, self.often = 0 if minimum == 2 else None, 0
        spark = words.sparkSession
        _tune(spark)
        self.members: list[np.ndarray] = []
        for _ in range(high):
            seen = spark.sparkContext.broadcast(self.members)
            counts = words.select("texts").mapInArrow(lambda it, s=seen: _counted(s.value, minimum == 2, it), "h long, n long, valid boolean")
            summed, seen_all = counts.groupBy("h").agg(F.sum("n").alias("n"), F.max("valid").alias("valid")), Observation()
            known = F.col("h").isNotNull() & F.col("valid")
            summed = summed.observe(seen_all, F.count_if(known).alias("kinds"), F.sum(F.when(F.col("h").isNull(), F.col("n"))).alias("rare"), F.count_if(known & (F.col("n") >= (often or minimum))).alias("often"))
            kept = written(summed.filter((F.col("n") >= minimum) & F.col("h").isNotNull()).select("h"), "frequent")
            if self.kinds is not None:
                self.kinds += seen_all.get["kinds"] + (seen_all.get["rare"] or 0)
            self.often += seen_all.get["often"]
            self.members.append(self._bitmap(kept))
            seen.destroy()
        self.shared = spark.sparkContext.broadcast(self.members)

    @staticmethod
    def _bitmap(kept: DataFrame) -> np.ndarray:
        bits = min(max(1 << 15, 1 << (BITS_EACH * kept.count()).bit_length()), MAX_BITS)
        slot = F.col("h").bitwiseAND(F.lit(bits - 1))
        parts = kept.groupBy(F.bitmap_bucket_number(slot + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("m")).collect()
        out = np.zeros(bits // 8, np.uint8)
        for b, m in parts:  # 4 KB each; buckets count from 1
            out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
        return out

    def names(self) -> DataFrame:
        """h, ngram: the hashes and names of what may be frequent."""
        return self.words.select("texts").mapInArrow(lambda it, s=self.shared: _named(s.value, it), "h long, ngram string").distinct()

    def bags(self, *carry: str, names: bool = False) -> DataFrame:
        """The carried columns, ngram (its name, or its hash) and tf: not yet what is frequent alone."""
        kinds = dict(self.words.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], f"ngram {'string' if names else 'long'}", "tf long"])
        return self.words.select(*carry, "texts").mapInArrow(lambda it, s=self.shared: _bagged(s.value, list(carry), names, it), schema)


def by_group(bags: DataFrame, kernel: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, minimum: int) -> DataFrame:
    """Runs the kernel over slices of whole groups of equal n-grams that occur `minimum` times: rows, and each row's group."""
    rows = bags.repartition("ngram").sortWithinPartitions("ngram")
    return rows.mapInArrow(lambda it: kernel(_groups(minimum, it)), schema)


def _groups(minimum: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += b.num_rows
        if size >= ROWS and waiting[-1]["ngram"][b.num_rows - 1] != waiting[0]["ngram"][0]:
            whole = pa.Table.from_batches(waiting)
            number = _numbered(whole["ngram"])
            cut = int(np.searchsorted(number, number[-1]))
            yield from _frequent(minimum, whole.slice(0, cut), number[:cut])
            waiting = whole.slice(cut).combine_chunks().to_batches()
            size = whole.num_rows - cut
    if size:
        whole = pa.Table.from_batches(waiting)
        yield from _frequent(minimum, whole, _numbered(whole["ngram"]))


def _numbered(grams: pa.ChunkedArray) -> np.ndarray:
    """Of sorted n-grams, 0 for the first and one more at each change."""
    own = grams.combine_chunks()
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    differs = pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(differs)])


def _frequent(minimum: int, rows: pa.Table, number: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    keep = np.bincount(number, rows["tf"].to_numpy())[number] >= minimum
    if keep.any():
        yield rows.filter(pa.array(keep)), np.unique(number[keep], return_inverse=True)[1]


# --- models over groups ---------------------------------------------------------------------------------------------


def _split_counts(rows: pa.Table, g: np.ndarray, n: int) -> list[np.ndarray]:
    """Training counts of the classes, a row a group and a column an iteration; labels other than 0 are class 1."""
    tf, mask = rows["tf"].to_numpy(), rows["tested"].to_numpy()
    zero = pc.fill_null(pc.equal(rows["label"], 0), False).to_numpy()
    size = int(g[-1]) + 1
    out = []
    for own in (np.where(zero, tf, 0), np.where(zero, 0, tf)):
        held = np.stack([np.bincount(g, own * (mask >> i & 1), size) for i in range(n)], axis=1)
        out.append(np.rint(np.bincount(g, own, size)[:, None] - held).astype(np.int64))
    return out


def _theta(c: list[np.ndarray], t: np.ndarray, smooth: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Log probabilities of both classes, and which n-grams the training rows have."""
    if smooth:
        return [np.log((c[k] + 1.0) / np.maximum(t[k] + t[2], 1)) for k in (0, 1)], c[0] + c[1] > 0
    return [np.log(np.maximum(c[k] / np.maximum(t[k], 1), 1e-100)) for k in (0, 1)], c[0] + c[1] > 0


def _blocks(rows: np.ndarray) -> pa.Array:
    """Rows of integers as bytes."""
    size = rows.shape[1] * 8
    data = np.ascontiguousarray(rows, np.int64)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)), pa.py_buffer(data)])


def _counts(n: int, slices) -> Iterator[pa.RecordBatch]:
    """Each n-gram's training counts of both classes, and at last the totals, without an n-gram."""
    t = np.zeros((3, n), np.int64)
    for rows, g in slices:
        c = _split_counts(rows, g, n)
        t += np.stack([c[0].sum(0), c[1].sum(0), (c[0] + c[1] > 0).sum(0)])
        first = pa.array(np.searchsorted(g, np.arange(len(c[0]))))
        yield pa.record_batch([rows["ngram"].combine_chunks().take(first), _blocks(np.concatenate(c, axis=1))], ["h", "counts"])
    yield pa.record_batch([pa.nulls(1, pa.int64()), _blocks(t.reshape(1, -1))], ["h", "counts"])


def _polarity(n: int, t: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = np.frombuffer(b"".join(b["counts"].to_pylist()), np.int64).reshape(-1, 2, n)
        theta, known = _theta([c[:, 0], c[:, 1]], t, True)
        p, times = np.where(known, theta[1] - theta[0], 0), known.sum(1)
        mean = p.sum(1) / np.maximum(times, 1)
        off = np.where(known, p - mean[:, None], 0)
        std = np.sqrt((off * off).sum(1) / np.maximum(times, 1))
        yield pa.record_batch([b["h"], pa.array(mean), pa.array(std), pa.array(times.astype(np.int32))], ["h", "mean_score", "std_score", "num_iterations"]).filter(pa.array(times > 0))


def polarity(candidates: Candidates, iterations: int) -> DataFrame:
    """ngram, mean_score, std_score, num_iterations, stance: as splits.polarity, of words that carry label and tested.

    The bags are exchanged once, by hashes, and give each n-gram's counts and the totals; names are exchanged by
    themselves, without the rows, and joined at the end.
    """
    spark = candidates.words.sparkSession
    counts = written(by_group(candidates.bags("label", "tested"), lambda s: _counts(iterations, s), "h long, counts binary", candidates.minimum), "counts")
    release(spark)
    parts = counts.filter("h is null").collect()  # a row a task
    t = sum((np.frombuffer(bytes(r["counts"]), np.int64).reshape(3, iterations) for r in parts), np.zeros((3, iterations), np.int64))
    own = counts.filter("h is not null").mapInArrow(lambda it: _polarity(iterations, t, it), "h long, mean_score double, std_score double, num_iterations int")
    out = candidates.names().join(own, "h").select("ngram", "mean_score", "std_score", "num_iterations")
    return out.withColumn("stance", F.when(F.col("mean_score") > 0, "hawkish").otherwise("dovish"))


def tests_by_modulus(ids: np.ndarray, iterations: int, modulus: int = 10) -> np.ndarray:
    """The iterations that test a row, as splits.by_modulus: a row an id, a column a round; -1 for none."""
    i = np.stack([first + (ids + first // modulus * (ids // modulus)) % modulus for first in range(0, iterations, modulus)], axis=1)
    return np.where(i < iterations, i, -1)


def _training(rows: pa.Table, g: np.ndarray, n: int, at: np.ndarray | None) -> list[np.ndarray]:
    """As _split_counts, by the iterations that test each row."""
    tf, size = rows["tf"].to_numpy(), int(g[-1]) + 1
    zero = pc.fill_null(pc.equal(rows["label"], 0), False).to_numpy()
    out = []
    for own in (np.where(zero, tf, 0), np.where(zero, 0, tf)):
        held = np.zeros(size * n)
        for i in at.T if at is not None else ():
            held += np.bincount((g * n + i)[i >= 0], own[i >= 0], size * n)
        out.append(np.rint(np.bincount(g, own, size)[:, None] - held.reshape(size, n)).astype(np.int64))
    return out


def _sums(n: int, tests: Callable[[np.ndarray], np.ndarray] | None, smooth: bool, slices) -> Iterator[pa.RecordBatch]:
    """For each row and column of its tests: the sums of tf * log(count + 1), or log(count), of both classes, and the
    occurrences that the logs of the totals are to be subtracted for. At last rows with total: those of the totals."""
    t = np.zeros((3, n), np.int64)
    rounds = 1
    for rows, g in slices:
        ids, tf = rows["row_id"].to_numpy(), rows["tf"].to_numpy()
        at = tests(ids) if tests else None
        c = _training(rows, g, n, at)
        t += np.stack([c[0].sum(0), c[1].sum(0), (c[0] + c[1] > 0).sum(0)])
        logs = [np.log(x + 1.0) if smooth else np.where(x > 0, np.log(np.maximum(x, 1)), LEAST) for x in c]
        counted = [c[0] + c[1] > 0] if smooth else [x > 0 for x in c]
        kinds, code = np.unique(ids, return_inverse=True)
        sums = []
        rounds = at.shape[1] if tests else 1
        for i in at.T if tests else [np.zeros(len(g), np.int64)]:
            use = np.where((i >= 0) & (c[0] + c[1] > 0)[g, i], tf, 0)
            sums += [np.bincount(code, use * x[g, i], len(kinds)) for x in (*logs, *counted)]
        label = rows["label"].combine_chunks().take(pa.array(np.unique(code, return_index=True)[1]))
        yield pa.record_batch([pa.array(kinds), label, pa.array(np.zeros(len(kinds), bool)), *map(pa.array, sums)], _sum_names(rounds, smooth))
        kind = label.type
    if t.any():
        rest = [np.zeros(n)] * (rounds * (3 if smooth else 4) - 3)
        yield pa.record_batch([pa.array(np.arange(n)), pa.nulls(n, kind), pa.array(np.ones(n, bool)), *[pa.array(x.astype(np.float64)) for x in (*t, *rest)]], _sum_names(rounds, smooth))


def _sum_names(rounds: int, smooth: bool) -> list[str]:
    return ["row_id", "label", "total", *[f"_{r}{x}" for r in range(rounds) for x in (("a0", "a1", "m") if smooth else ("a0", "a1", "m0", "m1"))]]


def _scores(t: np.ndarray, tests: Callable[[np.ndarray], np.ndarray] | None, smooth: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of log probabilities: those of log counts, less the logs of the totals."""
    logs = [np.log(np.maximum(t[k] + (t[2] if smooth else 0), 1)) for k in (0, 1)]
    each = 3 if smooth else 4
    for b in batches:
        ids = b["row_id"].to_numpy()
        x = [b.column(k).to_numpy() for k in range(2, b.num_columns)]
        for r, i in enumerate(tests(ids).T if tests else [np.zeros(len(ids), np.int64)]):
            own = x[r * each : (r + 1) * each]
            s = [own[k] - own[2 if smooth else 2 + k] * logs[k][i] for k in (0, 1)]
            keep = pa.array(i >= 0)
            yield pa.record_batch([b["row_id"], b["label"], pa.array(i.astype(np.int32)), *map(pa.array, s)], ["row_id", "label", "iter", "s0", "s1"]).filter(keep)


def sums(candidates: Candidates, iterations: int, row_id: str, tests: Callable[[np.ndarray], np.ndarray] | None = None, smooth: bool = True) -> tuple[DataFrame, np.ndarray]:
    """row_id, label, iter, s0, s1: the sums of log probabilities of the rows' n-grams, for the iterations that test
    them; and the totals. Without tests, all rows train the one model that scores them. Rows without a frequent n-gram
    are left out.

    log((c + 1) / (t + v)) is log(c + 1) - log(t + v), so sums and totals come from one exchange of the bags.
    """
    spark = candidates.words.sparkSession
    bags = candidates.bags(row_id, "label").withColumnRenamed(row_id, "row_id")
    kind = dict(bags.dtypes)["label"]
    names = _sum_names(tests(np.zeros(1, np.int64)).shape[1] if tests else 1, smooth)
    schema = ", ".join([f"row_id long, label {kind}, total boolean", *[f"{c} double" for c in names[3:]]])
    parts = by_group(bags, lambda s: _sums(iterations, tests, smooth, s), schema, candidates.minimum)
    del bags
    table = written(parts.groupBy("row_id", "label", "total").agg(*[F.sum(c).alias(c) for c in names[3:]]), "sums")
    t = np.zeros((3, iterations), np.int64)
    for r in table.filter("total").collect():  # a row an iteration
        t[:, r.row_id] = [int(r[c]) for c in names[3:6]]
    del parts
    release(spark)
    out = table.filter("not total").drop("total").mapInArrow(lambda it: _scores(t, tests, smooth, it), f"row_id long, label {kind}, iter int, s0 double, s1 double")
    return out.withColumnRenamed("row_id", row_id), t


def _masses(slices) -> Iterator[pa.RecordBatch]:
    for rows, _ in slices:
        ids, code = np.unique(rows["row_id"].to_numpy(), return_inverse=True)
        yield pa.record_batch([pa.array(ids), pa.array(np.bincount(code)), pa.array(np.bincount(code, rows["tf"].to_numpy()).astype(np.int64))], ["row_id", "kinds", "mass"])


def masses(candidates: Candidates, row_id: str) -> DataFrame:
    """row_id, kinds, mass: how many frequent n-grams a row has, and their occurrences."""
    bags = candidates.bags(row_id).withColumnRenamed(row_id, "row_id")
    out = by_group(bags, _masses, "row_id long, kinds long, mass long", candidates.minimum)
    return out.groupBy(F.col("row_id").alias(row_id)).agg(F.sum("kinds").alias("kinds"), F.sum("mass").alias("mass"))
