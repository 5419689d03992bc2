"""MinHash near-deduplication with odd sketches, and exact confirmation of every link.

1. Each document becomes the set of its distinct shingles (64-bit hashes), of 3 words unless told otherwise. Its MinHash
   samples give the keys of as many bands as the similarity needs (`banding`), and are folded into a parity bitmap of
   SKETCH bits, the odd sketch. Rows are numbered here; all that follows works on these numbers.
2. Rows with equal sets form one class, held by its smallest number; copies are never expanded.
3. In every bucket (equal band key) each class is paired with the bucket's smallest one. The population count of the
   XOR of two odd sketches estimates their similarity; pairs that are clearly below the limit go, the rest are
   confirmed on the full sets. Links give components.
4. Buckets whose members are in several components are looked at again. Their members are dealt in blocks of bounded
   count and bytes. A task gets a block with odd sketches and keeps the members that may have a link to another
   component in it; then it gets the full sets of these, counts their intersections, and emits the components that it
   has joined: fewer rows than it has members, never pairs of documents. Buckets of
   one block are settled by that. Larger ones are dealt anew with the contracted components while that halves what
   lies outside of each bucket's largest component; the remainder is then compared with every block of its bucket.
Components come from min-label propagation with pointer jumping; every step is a table in the shared folder.

Bands are chosen so that a pair of just the similarity asked for shares no bucket with a probability of MISS at most:
40 bands of 8 samples at 0.85 (and 1e-10 at 0.9), 42 bands of 6 samples at 0.8.

Edge cases: documents without words have the empty set, are linked with nothing and kept; fewer words than a shingle
has are one shingle; ids may be of any type that has an order; rows that share a doc_id are judged each by its own
text; a null doc_id is larger than all others, and the component_id where all are null; other columns are not read.
representatives() keeps one row of each component, also where ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS, SKETCH = 40, 8, 512
SHINGLE, SIMILARITY = 3, 85
#: The largest chance that a pair of just the similarity asked for shares no bucket.
MISS = 3e-6
#: Members of a block, and shingles of its sets together: 32 MB.
BLOCK, BLOCK_SHINGLES = 1024, 4 << 20
#: Columns of the matrices that count intersections, and the most pairs of a shingle that are added one by one.
COLUMNS, FEW = 2048, 32

_random = np.random.default_rng(20)
_SEEDS = _random.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SALTS = _random.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_COEFFICIENTS = _random.integers(1 << 63, size=ROWS, dtype=np.uint64) | np.uint64(1)


def largest_distance(similarity: int) -> int:
    """The largest XOR population count of two odd sketches at which a pair may still be as similar as asked for.

    Twice the number of differing samples is the size of the difference of the folded sets; the expected count follows
    from it, and five standard deviations are allowed.
    """
    k, bits, p = BANDS * ROWS, SKETCH, 1 - similarity / 100
    decay = (1 - 2 / bits) ** (2 * k * p)
    expected = bits / 2 * (1 - decay)
    from_samples = decay * 2 * np.sqrt(k * p * (1 - p))
    from_folding = np.sqrt(bits * (1 - decay**2)) / 2
    return int(np.ceil(expected + 5 * np.hypot(from_samples, from_folding)))


def banding(similarity: int) -> tuple[int, int]:
    """bands, rows: the most samples to a band, and then the fewest bands, with which at most MISS of the links are lost."""
    for rows in range(ROWS, 0, -1):
        if (alike := (similarity / 100) ** rows) < 1:
            bands = int(np.ceil(np.log(MISS) / np.log1p(-alike)))
        else:
            bands = 1
        if bands * rows <= BANDS * ROWS:
            return bands, rows
    raise ValueError(f"{BANDS * ROWS} samples are too few for a similarity of {similarity} %")


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted hashes."""
    raw = C.LOWER[raw]
    starts, ends, first = C.words(raw, off, C.NOT_SPACE)
    h = C.word_hashes(raw, starts, ends)
    w = C.window_hashes(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        else:
            out.append(C.window_hashes(h[a:b], int(b - a)) if b > a else h[:0])
    return out


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of one set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * _SEEDS).min(axis=0), out=low)
    return low


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Rows of samples, folded into parity bitmaps."""
    n = len(low)
    place = (C.mix(low.astype(np.uint64) + _SALTS) & np.uint64(SKETCH - 1)).astype(np.int64) + SKETCH * np.arange(n)[:, None]
    parity = np.bincount(place.ravel(), minlength=SKETCH * n) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, SKETCH), axis=1).view(np.int64)


def sign(similarity: int, shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands, rows = banding(similarity)
    for batch, raw, off in C.chunks(batches, "text"):
        sets = shingle_sets(raw, off, shingle)
        n = np.array([len(s) for s in sets], np.int64)
        low = np.stack([samples(s) for s in sets])
        keys = (low[:, : bands * rows].reshape(len(sets), bands, rows).astype(np.uint64) * _COEFFICIENTS[:rows]).sum(axis=2)
        keys = C.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sketch = odd_sketches(low)
        digest = [[int(C.mix(s ^ np.uint64(c)).sum(dtype=np.uint64)) for s in sets] for c in (0, 0x5851F42D4C957F2D)]
        none = n == 0
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "t1": batch.column("t1"),
            "t2": batch.column("t2"),
            "n_shingles": pa.array(n),
            "c1": pa.array(np.array(digest[0], np.uint64).view(np.int64)),
            "c2": pa.array(np.array(digest[1], np.uint64).view(np.int64)),
            "bands": _lists(keys.view(np.int64), none),
            "sketch": _lists(sketch, none),
        })


def _lists(rows: np.ndarray, none: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(np.where(none, 0, rows.shape[1]))]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(rows[~none]).ravel()))
    return out


def sets_of(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in C.chunks(batches, "text"):
        yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "shingles": pa.array([s.tobytes() for s in shingle_sets(raw, off, shingle)], pa.binary())})


def confirm(similarity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, other = batch.column("shingles"), batch.column("other")
        keep = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (mine, other))
            small, large = min(len(a), len(b)), max(len(a), len(b))
            if 100 * small < similarity * large:
                keep.append(False)
                continue
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= similarity * (len(both) - same))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """XOR population counts of all rows of x with all rows of y (rows of 64-bit words)."""
    out = np.zeros((len(x), len(y)), np.int32)
    for w in range(x.shape[1]):
        d = x[:, w, None] ^ y[None, :, w]
        out += np.bitwise_count(d) if hasattr(np, "bitwise_count") else _POPCOUNT[np.ascontiguousarray(d).view(np.uint16)].reshape(*d.shape, 4).sum(axis=2)
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    known, at_left = np.unique(np.concatenate(left), return_inverse=True)
    own_left = np.repeat(np.arange(len(left)), [len(s) for s in left])
    values = np.concatenate(right)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    hit = known[place] == values
    at_right, own_right = place[hit], np.repeat(np.arange(len(right)), [len(s) for s in right])[hit]
    many_left, many_right = np.bincount(at_left, minlength=len(known)), np.bincount(at_right, minlength=len(known))
    few = many_left * many_right <= FEW

    # shingles of few pairs, one by one
    order = np.argsort(at_right, kind="stable")
    begin = np.cumsum(many_right) - many_right
    mine = few[at_left] & (many_right[at_left] > 0)
    times = many_right[at_left[mine]]
    rows = np.repeat(own_left[mine], times)
    first = np.repeat(begin[at_left[mine]] - np.cumsum(times) + times, times)
    out += np.bincount(rows * len(right) + own_right[order[first + np.arange(len(rows))]], minlength=out.size).reshape(out.shape)

    # the others as products of 0-1 matrices
    column = np.cumsum(~few) - 1
    keep_left, keep_right = ~few[at_left], ~few[at_right]
    sides = []
    for own, place in ((own_left[keep_left], column[at_left[keep_left]]), (own_right[keep_right], column[at_right[keep_right]])):
        order = np.argsort(place, kind="stable")
        sides.append((own[order], place[order]))
    for low in range(0, int((~few).sum()), COLUMNS):
        parts = []
        for n, (own, place) in zip(out.shape, sides, strict=True):
            a, b = np.searchsorted(place, [low, low + COLUMNS])
            m = np.zeros((n, COLUMNS), np.float32)
            m[own[a:b], place[a:b] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees, as (larger root, smaller root)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


#: A row of a unit is compared as one of its left members, as one of its right members, or as both.
LEFT, RIGHT, BOTH = 1, 2, 3


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit (key, i, j), by which they are sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if s == e:
                continue
            unit = tuple(key[:, s])
            if held and unit != now:
                yield pa.Table.from_batches(held)
                held = []
            now = unit
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _near(t: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right members of different components whose odd sketches allow a link, and which of them with which."""
    comp, role = t.column("comp").to_numpy(), t.column("role").to_numpy()
    sketch = np.asarray(t.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(comp), -1)
    left, right = np.flatnonzero(role & LEFT), np.flatnonzero(role & RIGHT)
    ok = (distances(sketch[left], sketch[right]) <= limit) & (comp[left][:, None] != comp[right][None, :])
    rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    return left[rows], right[columns], ok[np.ix_(rows, columns)]


def sift(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that may have a link, in the roles in which they may."""
    for t in by_unit(batches):
        left, right, _ = _near(t, limit)
        role = np.zeros(t.num_rows, np.int32)
        role[left] |= LEFT
        role[right] |= RIGHT
        t = t.set_column(t.column_names.index("role"), "role", pa.array(role))
        yield from t.filter(pa.array(role > 0)).to_batches()


def join_components(similarity: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emits the components that links between left and right members of a unit join."""
    for t in by_unit(batches):
        left, right, ok = _near(t, limit)
        if not len(left):
            continue
        comp, shingles = t.column("comp").to_numpy(), t.column("shingles")
        a, b = ([np.frombuffer(shingles[int(i)].as_buffer(), np.uint64) for i in side] for side in (left, right))
        same = intersections(a, b)
        either = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - same
        p, q = np.nonzero(ok & (100 * same >= similarity * either))
        joined = forest(np.unique(np.sort(np.stack([comp[left[p]], comp[right[q]]], axis=1), axis=1), axis=0))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in joined], pa.int64()), "b": pa.array([x for _, x in joined], pa.int64())})


def _sets(docs: DataFrame, places: DataFrame, ids: DataFrame, shingle: int, total: int) -> DataFrame:
    """rep, shingles of the rows with these numbers; docs and places have t1 and t2, a hash of a row's id and text."""
    wanted = C.scratch(places.join(ids, "rep", "left_semi"), "wanted")
    own = C.maybe_in(docs.select("t1", "t2", "text").withColumn("_row", F.monotonically_increasing_id()), wanted, "t1").filter("_maybe")
    own = C.join_groups(own, wanted, ["t1", "t2"], "size", "_row", total)
    out = own.filter("rep is not null").select("rep", "text").mapInArrow(lambda it: sets_of(shingle, it), "rep long, shingles binary")
    if wanted.filter("size > 1").limit(1).count():
        out = out.groupBy("rep").agg(F.first("shingles").alias("shingles"))
    out = C.scratch(out, "sets")
    C.discard(wanted)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; pairs must be a scratch table. Sets of a hot b are dealt by salt."""
    total = pairs.count()
    counts = C.scratch(pairs.groupBy("b").agg(F.count("*").alias("n")), "fan")
    dealt = C.join_groups(pairs.select("a", "b"), counts, ["b"], "n", "a", total)
    dealt = C.scratch(dealt.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / 64))).drop("n"), "dealt")
    heads = dealt.select("b", "salt").distinct().join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("other")), "b")
    both = dealt.join(sets.select(F.col("rep").alias("a"), "shingles"), "a").join(heads, ["b", "salt"])
    links = C.scratch(both.select("a", "b", "shingles", "other").mapInArrow(lambda it: confirm(similarity, it), "a long, b long"), "links")
    C.discard(counts, dealt)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that can be reached. links: a, b. Hubs and large components are dealt out."""
    both = links.select("a", "b").union(links.select("b", "a"))
    edges = C.scratch(both.distinct(), "edges")
    degrees = C.scratch(edges.groupBy("b").agg(F.count("*").alias("n")), "degrees")
    total = edges.count()
    labels = C.scratch(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        heads = degrees.join(labels.select(F.col("node").alias("b"), "comp"), "b")
        near = C.join_groups(edges, heads, ["b"], "n", "a", total).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = C.scratch(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "low")
        roots = low.groupBy("comp").agg(F.count("*").alias("n")).join(low.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp")
        jump = C.join_groups(low, roots, ["comp"], "n", "node", total)
        new = C.scratch(jump.select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        C.discard(labels, low)
        labels = new
        if not changed:
            C.discard(edges, degrees)
            return labels.select("node", "comp")


def _merged(comps: DataFrame, joined: DataFrame, total: int) -> DataFrame:
    """The components after some of them (a, b) have been joined."""
    higher = components(joined)
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n")).join(higher.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp")
    moved = C.join_groups(comps, sizes, ["comp"], "n", "node", total).select("node", F.coalesce("top", "comp").alias("comp"))
    return C.scratch(moved.union(higher.join(comps, "node", "left_anti").select("node", "comp")), "comps")


def _open(members: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """Members (key, rep, weight) of the buckets that hold several components, with the number of blocks of their bucket."""
    labelled = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = C.scratch(labelled.select("key", "rep", "weight", F.coalesce("comp", "rep").alias("comp")), "labelled")
    kinds = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    most = F.max(F.struct("n", "comp", "weight"))
    buckets = kinds.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"), F.sum("weight").alias("all"), most.alias("most"))
    blocks = lambda n, weight: F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    every, minor = blocks(F.col("size"), F.col("all")), blocks(F.col("size") - F.col("most.n"), F.col("all") - F.col("most.weight"))
    buckets = C.scratch(buckets.filter("kinds > 1").select("key", "size", F.col("most.comp").alias("main"), every.alias("blocks"), minor.alias("minor_blocks")), "open")
    out = C.join_groups(labelled, buckets, ["key"], "size", "rep", labelled.count()).filter("size is not null")
    out = C.scratch(out.withColumn("minor", F.col("comp") != F.col("main")).drop("main"), "open")
    C.discard(labelled, buckets)
    del labelled, kinds, buckets
    C.release(members.sparkSession)
    return out


def _units(open_: DataFrame, turn: int, cross: bool) -> DataFrame:
    """key, i, j, role, rep, comp: each block on its own, or each block of the minor members with each block of all."""
    place = lambda blocks: F.pmod(F.xxhash64(F.lit(turn), "rep"), F.col(blocks)).cast("int")
    if not cross:
        return open_.select("key", place("blocks").alias("i"), F.lit(-1).alias("j"), F.when(F.col("minor"), BOTH).otherwise(RIGHT).alias("role"), "rep", "comp")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = open_.filter("minor").select("key", place("minor_blocks").alias("i"), each("blocks").alias("j"), F.lit(LEFT).alias("role"), "rep", "comp")
    return minor.union(open_.select("key", each("minor_blocks").alias("i"), place("blocks").alias("j"), F.lit(RIGHT).alias("role"), "rep", "comp"))


def _dealt(units: DataFrame) -> DataFrame:
    return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _classified(docs: DataFrame, doc_id: str, text: str, similarity: int, block: int, shingle: int) -> DataFrame:
    """A row per document: number, doc_id, t1, t2, n_shingles, comp, component_id; comp is null without words."""
    C.tune(docs.sparkSession)
    docs = C.with_row_hashes(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, t1 long, t2 long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>"
    signed = C.scratch(docs.mapInArrow(lambda it: sign(similarity, shingle, it), schema).withColumn("number", F.monotonically_increasing_id()), "signed")
    total = signed.count()
    same = ["c1", "c2", "n_shingles"]
    full = signed.filter("n_shingles > 0")
    groups = C.scratch(full.groupBy(*same).agg(F.min("number").alias("rep"), F.min("doc_id").alias("lowest"), F.count("*").alias("size")), "classes")
    places = C.scratch(full.groupBy("t1", "t2").agg(F.min("number").alias("rep"), F.count("*").alias("size")), "places")
    limit = largest_distance(similarity)

    copies = C.join_groups(full.select("number", *same), groups.filter("size > 1").select(*same, "rep", "size"), same, "size", "number", total)
    copies = C.scratch(copies.filter("number <> rep").select("number"), "copies")
    C.release(docs.sparkSession)
    reps = C.without(full.select("number", "n_shingles", "bands", "sketch"), copies, "number").withColumnRenamed("number", "rep")
    rows = reps.select("rep", F.col("n_shingles").alias("weight"), F.explode("bands").alias("key"))
    exploded = total * banding(similarity)[0]
    buckets = C.scratch(rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = C.scratch(C.join_groups(rows, buckets, ["key"], "size", "rep", exploded).filter("size is not null"), "members")
    C.release(docs.sparkSession)
    sketches = C.scratch(C.within(reps.select("rep", "sketch"), C.scratch(members.select("rep").distinct(), "ids"), "rep"), "sketches")
    # texts move once: the sets of all members of buckets serve both looks
    sets = _sets(docs, places, sketches.select("rep"), shingle, total)
    C.discard(buckets, places)
    del reps, rows, buckets, places
    C.release(docs.sparkSession)
    star = C.scratch(members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
    fan = star.groupBy("b").agg(F.count("*").alias("n"))
    pivots = C.scratch(fan.join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("other")), "b"), "pivots")
    near = C.join_groups(star, pivots, ["b"], "n", "a", star.count()).join(sketches.select(F.col("rep").alias("a"), "sketch"), "a")
    far = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    tried = C.scratch(near.filter(far <= limit).select("a", "b"), "near")
    links = _confirmed(tried, sets, similarity)
    C.discard(star, pivots, tried)
    del star, fan, pivots, near, tried
    C.release(docs.sparkSession)
    comps = components(links)

    # a bucket of two has been settled by its one pair
    pool, turn, before = members.filter("size > 2").select("key", "rep", "weight"), 0, 0
    while (minor := (open_ := _open(pool, comps, block)).filter("minor").count()):
        cross = turn > 0 and 2 * minor > before
        # sketches first: full sets travel only for members that may have a link in their unit
        units = _dealt(_units(open_, turn, cross).join(sketches, "rep"))
        units = C.scratch(units.mapInArrow(lambda it: sift(limit, it), units.schema), "units")
        units = _dealt(units.join(sets, "rep"))
        joined = C.scratch(units.mapInArrow(lambda it: join_components(similarity, limit, it), "a long, b long").distinct(), "joined")
        comps = _merged(comps, joined, total)
        if cross:
            break
        pool, turn, before = open_.filter("blocks > 1").select("key", "rep", "weight"), turn + 1, minor
    C.discard(members, sets, sketches)
    C.release(docs.sparkSession)

    labelled = groups.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "size", "lowest", F.coalesce("comp", "rep").alias("comp"))
    labelled = C.scratch(labelled, "labelled")
    lowest = C.scratch(labelled.groupBy("comp").agg(F.min("lowest").alias("component_id"), F.count("*").alias("n")), "lowest")
    held = C.scratch(C.join_groups(labelled.drop("lowest"), lowest, ["comp"], "n", "c1", total).drop("n"), "held")
    C.discard(labelled, lowest)
    out = C.join_groups(signed.select("number", "doc_id", "t1", "t2", *same), held, same, "size", "number", total)
    return out.select("number", "doc_id", "t1", "t2", "n_shingles", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. similarity in per cent, shingle in words."""
    out = _classified(docs, doc_id, text, similarity, block, shingle)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id; of rows that share it, one."""
    rows = C.scratch(_classified(docs, doc_id, text, similarity, block, shingle).filter("comp is not null"), "rows")
    best = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min("number").alias("number"))
    # a row's id and text decide: rows that agree in both are one place
    places = rows.groupBy("t1", "t2").agg(F.min("number").alias("number"), F.count("*").alias("size"))
    stays = best.select("number", F.lit(True).alias("stays"))
    marks = places.join(stays, "number", "left").select("t1", "t2", "size", F.coalesce("stays", F.lit(False)).alias("stays"))
    return C.keep_rows(docs, marks, doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
  sets AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(t) - 1, 2)), lambda i: array_to_string(t[i:i + 2], ' '))) AS g FROM docs WHERE len(t) > 0),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach AS (SELECT doc_id AS node, doc_id AS other FROM docs UNION SELECT node, b FROM reach JOIN links ON a = other)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, docs.doc_id = min(other) AS kept
FROM docs JOIN reach ON node = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id GROUP BY docs.doc_id, n
"""
