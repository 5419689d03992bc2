"""SimHash, vector codes and phrases against plain implementations."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.data import edge_rows, frame
from tidemark.llm import phrases, queries, simhash, vector_codes


def oracle(sf, name, *tables):
    c = duckdb.connect()
    for n in tables:
        c.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    return c.sql(queries.oracle_sql()[name])


# --- SimHash


def test_fingerprints():
    for text in ["", " \t", "a", "A b", "one two three", "é ü  日本\n語 x Y", "w " * 700, " ".join(str(k) for k in range(3000))]:
        for piece in (7, 1 << 20):
            before, simhash.PIECE = simhash.PIECE, piece
            try:
                assert simhash.fingerprint(text.encode()) == brute.simhash(text)
            finally:
                simhash.PIECE = before


def test_masks():
    """Two differing bits leave one mask equal on each level."""
    r = random.Random(3)
    for _ in range(500):
        x = r.getrandbits(64)
        y = x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        masks = [m for m in simhash.finer(0, 16) if not (x ^ y) & m]
        for width in (8, 4):
            assert masks
            masks = [n for m in masks for n in simhash.finer(m, width) if not (x ^ y) & n]
        assert masks and all(bin(m).count("1") == 56 for m in masks)


@pytest.mark.parametrize("pairs", [5, 1 << 20])
def test_survivors(pairs):
    r = np.random.default_rng(4)
    base = r.integers(1 << 63, size=6, dtype=np.uint64)
    own = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(r.integers(64))) ^ (np.uint64(1) << np.uint64(r.integers(64))) for _ in range(40)]]))
    bucket = r.integers(3, size=len(own))
    before, simhash.PAIRS = simhash.PAIRS, pairs
    try:
        got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.survivors(own, bucket) for i, j in zip(a, b, strict=True)}
    finally:
        simhash.PAIRS = before
    assert got == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if bucket[i] == bucket[j] and bin(int(own[i] ^ own[j])).count("1") <= 2}


@pytest.mark.parametrize("block", [2, 1024])
def test_links(spark, block):
    """A dense ball and scattered fingerprints; small blocks go through all levels."""
    r = random.Random(5)
    centre = r.getrandbits(64)
    own = {centre}
    while len(own) < 300:
        own.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) if r.random() < 0.6 else r.getrandbits(64))
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in own]
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame(rows, "fp long"), block=block).collect()]
    assert all(bin(a ^ b).count("1") <= 64 for a, b in links)
    root = {x: x for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = brute.linked({x: x for x in own})
    assert len({(find(x), want[x]) for x in own}) == len({find(x) for x in own}) == len(set(want.values()))


def test_simhash_edges(spark):
    rows = edge_rows() + [(None, "one"), (None, "lonely words here"), (7, "another text of its own"), (3, "one")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    fps = [brute.simhash(t) for _, t in rows]
    comps = brute.linked(dict(enumerate(fps)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comps[k]] = min((x for x in (least.get(comps[k]), i) if x is not None), default=None)
    want = sorted(((i, f"{fps[k]:016x}", least[comps[k]]) for k, (i, _) in enumerate(rows)), key=str)
    assert got == want
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_simhash_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    fps = {i: brute.simhash(t) for i, t in docs.items()}
    comps = brute.linked(fps)
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in docs} and len(set(comps.values())) < len(docs)


# --- vector codes


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest(kind):
    """Many ties: few values, repeated entries."""
    r = np.random.default_rng(6)
    for entries, span in ((1, 3), (16, 2), (16, 5), (40, 100)):
        book = r.integers(-span, span, size=(entries, 3)).astype(kind)
        parts = r.integers(-span, span, size=(300, 3)).astype(kind)
        index, error = vector_codes.nearest(vector_codes.tree(book), book, parts)
        d = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2).astype(np.int64)
        assert (index == d.argmin(axis=1)).all() and (error.astype(np.int64) == d.min(axis=1)).all()


def vectors(spark, rows):
    """Columns of the operator's own names come along."""
    return spark.createDataFrame([(i, v, k, 7, 7, 7) for i, v, k in rows], "vec_id long, embedding array<float>, label int, v int, error int, code int")


def test_vector_edges(spark):
    r = random.Random(7)
    rows = [(k, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.3]) for _ in range(16)], r.choice([None, 1, 2])) for k in range(90)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 2), (203, [float("inf")] + [0.0] * 15, 2), (204, [], 3), (205, [1.0] * 9, 3), (206, [1.0] * 8, 3), (207, [1e6] * 16, None)]
    codes, books = vector_codes.compress(vectors(spark, rows))
    got = {x.vec_id: (x.code, x.error, x.label_error) for x in vector_codes.report(codes, books).collect()}
    want, values = brute.vector_codes([x for x in rows if x[1] is None or len(x[1]) == 16])
    assert got == want
    assert vector_codes.digest(books) == hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()
    assert len(vector_codes.decode(got[0][0], books)) == 16
    few = [(None, [1.0] * 8, None), (3, [0.5] * 8, 1), (3, [0.25] * 8, 1)]
    assert [x.error for x in vector_codes.report(*vector_codes.compress(vectors(spark, few))).collect()] == [0, 0, 0]
    assert vector_codes.report(*vector_codes.compress(vectors(spark, []))).collect() == []


def test_vector_query(spark, sf):
    df = vector_codes.query(spark, sf)
    columns = sorted(df.columns)
    want = oracle(sf, "op12_vector_codes", "embeddings").select(*columns).fetchall()
    assert sorted(tuple(x) for x in df.select(*columns).collect()) == sorted(want) and len(want) == 500


# --- phrases


def test_joined(spark):
    r = np.random.default_rng(8)
    a, b = (r.integers(-(1 << 63), (1 << 63) - 1, size=50) for _ in range(2))
    got = [x[0] for x in spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").coalesce(1).select(F.xxhash64("a", "b")).collect()]
    assert phrases.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == got
    assert xxhash.xxh64_intdigest(b"x" * 8, 42) == int(phrases._hash(np.frombuffer(b"x" * 8, np.uint64), np.uint64(42))[0])


def phrase_rows(n=400, seed=9):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "日本", "a", "b", "the"]
    out = [(None, None), ("en", ""), (None, "new york city, new york city"), ("", "x y x y"), ("en", "the " * 700), ("de", " \t. , ;;! ?\n\r\x0b\x0c")]
    for _ in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(r.randrange(0, 60)))
        out.append((r.choice(["en", "de", None, "", "und"]), t + r.choice(["", "once upon a time there"])))
    return out


@pytest.mark.parametrize("size,group", [(64, 1), (1000, 50), (1 << 20, 1 << 18)])
def test_phrases_brute(spark, size, group):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, k, 1, 2, "x") for k, t in rows], "text string, lang string, n int, g int, phrase string").repartition(3)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=12, first=60, size=size, group=group).collect())
    assert got == sorted(brute.phrases(rows, least=12, first=60)) and len(got) > 100


def test_phrases_long_piece(spark):
    text = "la di da " * 3000
    got = phrases.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), size=500).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.phrases([("en", text)]))


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_many_ties(spark):
    """More rows of one score than are kept."""
    rows = spark.range(5000).select(F.lit("en").alias("lang"), F.format_string("p%05d", "id").alias("phrase"), F.lit(100).cast("long").alias("a"), *[F.lit(100).cast("long").alias(c) for c in ("l", "r", "n", "score")])
    assert [x.phrase for x in phrases.ranked(rows, 10).orderBy("rank").collect()] == [f"p{k:05d}" for k in range(10)]


def test_phrases_query(spark, sf):
    df = phrases.query(spark, sf)
    columns = sorted(df.columns)
    want = oracle(sf, "op13_phrases", "documents").select(*columns).fetchall()
    assert sorted(tuple(x) for x in df.select(*columns).collect()) == sorted(want) and want
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(x) for x in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(brute.phrases(docs))


def test_shards_cut_anywhere():
    batch = pa.RecordBatch.from_pydict({"text": ["a b c. d e f g h", None, "i j"], "lang": ["x", "x", "y"]})
    parts = list(phrases.shards(iter([batch]), 3, size=2))
    assert [own for *_, own in parts] == [2] * 5 and [len(h) for h, *_ in parts] == [4, 4, 4, 4, 2]
