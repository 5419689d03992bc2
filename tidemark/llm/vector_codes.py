"""Product quantisation of vectors: a codebook for each part position, refined in rounds on integers.

Components become integers floor(scale * x), and a vector is cut into PARTS equal parts. The codebook of a part position
starts as that part of the vectors of the smallest ids. In each round a kd-tree of every codebook is broadcast, every
part looks up its nearest entry, tasks emit one row of sums an entry and component at most, and the sums' floored means
become the new entries. The trees hold PARTS * ENTRIES entries whatever the corpus, and so do the rows that the driver
gets, so both are bounded.

A tree's inner node splits the entries at the middle of their widest component; a leaf holds one entry, or several
equal ones. A search goes to the nearer child first and to the other one where the distance to its range is not greater
than the best distance so far. Equal bounds are visited too, and an entry of equal distance replaces the best one if its
index is lower, so ties go to the lowest index. The search moves all parts of a batch through the tree together.

All arithmetic is on integers: in 64 bits where squared distances fit, else on Python's integers.

Edge cases: vectors that are null or have null or non-finite components are left out, as are empty ones, and those
whose length isn't the most frequent one that PARTS divides (of equally frequent ones the shorter); fewer vectors than
ENTRIES make smaller codebooks; rows that repeat an id are vectors of their own, and at the start equal ids are taken in
the order of their components; null ids come last; an empty table gives an empty result; components of 2^40 or more in
size are refused, and so are errors beyond 64 bits; labels may be null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of this size or more are refused.
LARGEST = float(1 << 40)
#: Rows of a batch that are looked up at a time.
STEP = 1 << 14


@dataclass(frozen=True)
class Node:
    """Entries of a leaf (indexes in ascending order), or a split: component, the two children and their nearest edges."""

    entries: tuple[int, ...] = ()
    component: int = 0
    low: Node | None = None
    high: Node | None = None
    low_end: int = 0
    high_begin: int = 0


def tree(codebook: np.ndarray, entries: tuple[int, ...] | None = None) -> Node:
    """The kd-tree of a codebook, whose rows are integers."""
    entries = tuple(range(len(codebook))) if entries is None else entries
    own = codebook[list(entries)]
    widths = own.max(axis=0) - own.min(axis=0) if len(own) and own.shape[1] else np.zeros(1, int)
    if not widths.max():
        return Node(entries)
    c = int(widths.argmax())
    values = sorted(int(x) for x in own[:, c])
    # the middle value, unless it is the largest: both sides get some
    cut = max(v for v in values if v <= values[(len(values) - 1) // 2] and v < values[-1])
    low, high = (tuple(e for e in entries if (codebook[e, c] <= cut) == side) for side in (True, False))
    return Node((), c, tree(codebook, low), tree(codebook, high), int(max(codebook[e, c] for e in low)), int(min(codebook[e, c] for e in high)))


def nearest(root: Node, codebook: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, and the squared distance, of every row of parts."""
    n = len(parts)
    far = np.iinfo(np.int64).max if parts.dtype != object else None
    best = np.full(n, far, parts.dtype) if far is not None else np.array([float("inf")] * n, object)
    index = np.zeros(n, np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.low is None:
            d = ((parts[rows] - codebook[node.entries[0]]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (node.entries[0] < index[rows]))
            nearer = nearer.astype(bool)
            best[rows[nearer]], index[rows[nearer]] = d[nearer], node.entries[0]
            return
        x = parts[rows, node.component]
        left = (x - node.low_end <= node.high_begin - x).astype(bool)
        visit(node.low, rows[left])
        visit(node.high, rows[~left])
        gap = np.where(left, node.high_begin - x, x - node.low_end)  # to the other child's range, from outside
        bound = np.where(gap > 0, gap, 0) ** 2
        again = (bound <= best[rows]).astype(bool)
        visit(node.high, rows[left & again])
        visit(node.low, rows[~left & again])

    visit(root, np.arange(n))
    return index, best


Codebooks = list[np.ndarray]


def exact_kind(values: np.ndarray, codebooks: Codebooks):
    """int64 where every squared distance fits it, else Python's integers."""
    most = max([int(np.abs(values).max(initial=0)), *(int(abs(c).max()) if c.size else 0 for c in codebooks)])
    width = codebooks[0].shape[1] if codebooks else 0
    return np.int64 if width * len(codebooks) * (2 * most) ** 2 < 1 << 63 else object


def looked_up(state: list[tuple[Node, np.ndarray]], batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """first row, integers (rows, parts, width), indexes (rows, parts) and errors of steps of a batch."""
    if not batch.num_rows:
        return
    values = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
    books = [c for _, c in state]
    for at in range(0, len(values), STEP):
        own = values[at : at + STEP]
        kind = exact_kind(own, books)
        own = own.astype(kind).reshape(len(own), len(state), -1)
        found = [nearest(t, c.astype(kind), own[:, p]) for p, (t, c) in enumerate(state)]
        yield at, own, np.stack([i for i, _ in found], axis=1), sum(e for _, e in found)


def sums(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, entry, position, total, n: what a task has gathered, in one row for each entry and component."""
    total, count = {}, {}
    for batch in batches:
        for _, own, index, _ in looked_up(state, batch):
            for p in range(len(state)):
                for e in np.unique(index[:, p]).tolist():
                    mine = own[index[:, p] == e, p]
                    total[p, e] = total.get((p, e), 0) + mine.sum(axis=0).astype(object)
                    count[p, e] = count.get((p, e), 0) + len(mine)
    rows = [(p, e, k, int(x), count[p, e]) for (p, e), own in total.items() for k, x in enumerate(own)]
    if rows:
        kinds = dict(part=pa.int32(), entry=pa.int32(), position=pa.int32(), total=pa.decimal128(38, 0), n=pa.int64())
        columns = [list(x) for x in zip(*rows, strict=True)]
        columns[3] = [Decimal(x) for x in columns[3]]
        yield pa.RecordBatch.from_pydict({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), columns, strict=True)})


def encoded(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, index, error in looked_up(state, batch):
            own = batch.slice(at, len(index))
            codes = [x.tobytes().hex() for x in index.astype(np.uint8)]
            yield pa.RecordBatch.from_pydict({"vec_id": own.column("vec_id"), "label": own.column("label"), "code": pa.array(codes, pa.string()), "error": pa.array([int(x) for x in error], pa.int64())})


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int, parts: int) -> DataFrame:
    """vec_id, label and the integers v of the vectors that take part, as a table."""
    x = F.col("x")
    own = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[embedding].cast("array<double>").alias("x"))
    infinite = float("inf")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite))
    own = own.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & whole)
    # bounded: a row for each length, of which the most frequent one is taken
    most = own.groupBy(F.size(x).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    integer = lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * float(scale))).otherwise(F.raise_error(F.lit(f"a component is {LARGEST:g} or more in size")).cast("long"))
    own = own.filter(F.size(x) == (most["width"] if most else 0))
    return C.scratch(own.select("vec_id", "label", F.transform(x, integer).alias("v")), "vectors")


def train(own: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks:
    """The codebooks after all rounds."""
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return []
    start = np.array([r["v"] for r in first], object).reshape(len(first), parts, -1)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):
        state = own.sparkSession.sparkContext.broadcast([(tree(c), c) for c in books])
        mine = own.select("v").mapInArrow(lambda it, s=state: sums(s.value, it), "part int, entry int, position int, total decimal(38,0), n long")
        rows = mine.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # entries * components at most
        books = [c.copy() for c in books]
        for r in rows:
            books[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
        state.unpersist()
    return books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for c in books for x in c.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code and error of every vector, and the codebooks that decode them."""
    if not 0 < entries <= 256:
        raise ValueError("an index is two hexadecimal digits: 1 to 256 entries")
    C.tune(vectors.sparkSession)
    own = whole_vectors(vectors, vec_id, embedding, label, scale, parts)
    books = train(own, parts, entries, rounds)
    state = own.sparkSession.sparkContext.broadcast([(tree(c), c) for c in books])
    kinds = dict(own.dtypes)
    out = own.mapInArrow(lambda it: encoded(state.value, it), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return C.scratch(out, "codes"), books


def decode(code: str, books: Codebooks) -> list[int]:
    """The integers that a code stands for."""
    return [int(x) for p, c in enumerate(books) for x in c[int(code[2 * p : 2 * p + 2], 16)]]


def report(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The codes with the errors summed over equal labels, nulls together, and a digest of the codebooks."""
    own = codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_row": F.monotonically_increasing_id()})
    keys = ["_none", "_label"]
    labels = own.groupBy(*keys).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("_n"))
    out = C.join_groups(own, C.scratch(labels, "labels"), keys, "_n", "_row", codes.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(*compress(C.load(spark, sf_dir, "embeddings")))


def _sql() -> str:
    near = """near{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
    (SELECT v.vec_id, part, e.entry, list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p v JOIN book{k} e USING (part)) GROUP BY 1, 2)"""
    # floored quotients; the remainder takes the sign of the dividend
    mean = """mean{k} AS MATERIALIZED (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS c FROM
    (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k} JOIN p USING (vec_id, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  book{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
    steps = [part.format(k=k, n=k + 1) for k in range(ROUNDS) for part in (near, mean)]
    return ",\n  ".join([*steps, near.format(k=ROUNDS)])


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
  p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
  first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
  book0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN first USING (vec_id)),
  {_sql()},
  codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY 1),
  books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM book{ROUNDS}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books
"""
