"""SimHash near-deduplication: fingerprints of 64 bits, linked where 2 bits or fewer differ.

1. A text in lower case (A-Z) becomes its shingles of 3 words, repeats included, joined by blanks; fewer words are one
   shingle. A bit of the fingerprint is set where it is set in over half of the shingles' XXH64 hashes (seed 42).
2. Equal fingerprints are one class; all that follows works on distinct fingerprints.
3. Classes meet in buckets: of the four quarters of two fingerprints that differ in two bits at most, two quarters at
   least are equal, so each class goes to the six buckets of its pairs of quarters. A bucket of more than BLOCK classes
   is dealt out anew by pairs of bytes of its free bits, and then by pairs of half bytes, after which no bucket can have
   more than 256 classes. No link is lost, and no bucket is unbounded.
4. Within the buckets, pivot distance tables decide: the Hamming distances of each class to PIVOTS reference
   fingerprints. A pair whose distances to any of them differ by more than the limit can't be linked. The classes of a
   bucket are sorted by the first distance, a class is paired with those that follow it within the limit only, and one
   pivot after the other discards pairs; what survives all is verified by the XOR of the fingerprints.
5. A task emits the links that join two trees, fewer than its buckets have members. Links give components.

Edge cases: a null text, and one without words, has the fingerprint zero and is linked like any other; ids may be of any
type that has an order; rows that share a doc_id are judged each by its own text; a null doc_id is larger than all
others, and the component_id where all are null; repeated rows get a row each; other columns are not read. Texts of any
length are hashed in pieces of PIECE bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common as C
from .minhash import components, forest

SHINGLE, LIMIT, SEED = 3, 2, 42
#: Reference fingerprints, and classes of a bucket before it is dealt out anew.
PIVOTS, BLOCK = 16, 1024
#: Bytes of a text that are split into words at a time, and pairs that are looked at at a time.
PIECE, PAIRS = 1 << 20, 1 << 20

_REFERENCES = np.random.default_rng(11).integers(1 << 63, size=PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(12).integers(2, size=PIVOTS, dtype=np.uint64)
_LOWER = bytes(C.LOWER)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in arrays of bounded size."""
    text, held, any_, at = text.translate(_LOWER), [], False, 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        to = cut.start() if cut else len(text)
        words = held + text[at:to].split()
        if len(words) >= k:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            slices = map(slice, (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
            yield np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), np.uint64, len(words) - k + 1)
            any_ = True
        held, at = words[-(k - 1) :] if k > 1 else [], to
    if held and not any_:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    count, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        for a in range(0, len(h), 255):  # sums of 255 bits fit a byte
            part = np.unpackbits(h[a : a + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += np.add.reduce(part, axis=0, dtype=np.uint8)
        n += len(h)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def sign(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in C.chunks(batches, "text"):
        own = [fingerprint(raw[a:b].tobytes(), k) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(own, np.uint64).view(np.int64))})


def distance_table(fingerprints: np.ndarray, references: np.ndarray = _REFERENCES) -> np.ndarray:
    """A row of Hamming distances for each reference fingerprint."""
    return np.bitwise_count(fingerprints[None, :] ^ references[:, None]).astype(np.int8)


def survivors(fingerprints: np.ndarray, bucket: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links (as places in the arrays) between fingerprints of the same bucket."""
    table = distance_table(fingerprints)
    order = np.lexsort((table[0], bucket))
    fingerprints, bucket, table = fingerprints[order], bucket[order], table[:, order]
    key = bucket.astype(np.int64) * 256 + table[0]
    many = np.searchsorted(key, key + limit, "right") - np.arange(len(key)) - 1
    upto = np.cumsum(many)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        for row in table[1:]:
            near = np.abs(row[i] - row[j]) <= limit
            i, j = i[near], j[near]
        near = np.bitwise_count(fingerprints[i] ^ fingerprints[j]) <= limit
        yield order[i[near]], order[j[near]]
        at = to


def link(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row has the fingerprints of a bucket; emits the links that join two trees."""
    for batch in batches:
        members = batch.column("members")
        own = np.asarray(members.flatten()).view(np.uint64)
        bucket = np.repeat(np.arange(batch.num_rows), np.asarray(members.value_lengths()))
        for i, j in survivors(own, bucket, limit):
            signed = own.view(np.int64)
            joined = forest(np.stack([signed[i], signed[j]], axis=1))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in joined], pa.int64()), "b": pa.array([x for _, x in joined], pa.int64())})


def finer(mask: int, width: int) -> list[int]:
    """The masks that add two of the four blocks of this many bits which the mask leaves free."""
    blocks = [((1 << width) - 1) << at for at in range(0, 64, width)]
    return [mask | x | y for x, y in combinations([b for b in blocks if not mask & b], 2)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def links(classes: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct) that chains of links connect."""
    if not 0 <= limit <= 2:
        raise ValueError("buckets of two equal quarters are whole up to two differing bits")
    masks = finer(0, 16)
    rows = classes.select("fp", F.explode(F.array(*map(_signed, masks))).alias("mask"))
    found = None
    for width in (8, 4, None):
        rows = rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        sizes = C.scratch(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        own = C.maybe_in(rows, sizes, "key").filter("_maybe").drop("_maybe")
        held = C.scratch(C.join_groups(own, sizes, ["key"], "n", "fp", own.count()).filter("n > 1"), "buckets")
        small = held if width is None else held.filter(F.col("n") <= block)
        lists = small.groupBy("key").agg(F.collect_set("fp").alias("members")).select("members")
        own = lists.mapInArrow(lambda it: link(limit, it), "a long, b long")
        found = own if found is None else found.union(own)
        if width is None or not held.filter(F.col("n") > block).limit(1).count():
            break
        children = {m: finer(m, width) for m in masks}
        pieces = F.create_map(*[x for m, own in children.items() for x in (_signed(m), F.array(*map(_signed, own)))])
        rows = held.filter(F.col("n") > block).select("fp", F.explode(pieces[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({x for own in children.values() for x in own})
    return C.scratch(found.distinct(), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    C.tune(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    signed = C.scratch(own.mapInArrow(lambda it: sign(shingle, it), f"doc_id {kind}, fp long").withColumn("_row", F.monotonically_increasing_id()), "signed")
    total = signed.count()
    classes = C.scratch(signed.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("size")), "classes")
    comps = components(links(classes, limit, block))
    labelled = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "size", "lowest", F.coalesce("comp", "fp").alias("comp"))
    labelled = C.scratch(labelled, "labelled")
    lowest = C.scratch(labelled.groupBy("comp").agg(F.min("lowest").alias("component_id"), F.count("*").alias("n")), "lowest")
    held = C.scratch(C.join_groups(labelled.drop("lowest"), lowest, ["comp"], "n", "fp", total).select("fp", "size", "component_id"), "held")
    C.discard(labelled, lowest)
    out = C.join_groups(signed, held, ["fp"], "size", "_row", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.load(spark, sf_dir, "documents"))
