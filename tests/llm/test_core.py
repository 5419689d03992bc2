import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.data import edge_rows, frame
from tidemark.llm import common as C
from tidemark.llm import decontaminate, exact_dedup, minhash, packing, quality, queries


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_words_and_windows():
    raw, off = C.utf8(pa.array([None, "a b", "", " a  bc\n", "a b"]))
    starts, ends, first = C.words(raw, off, C.NOT_SPACE)
    assert list(np.diff(first)) == [0, 2, 0, 2, 2]
    h = C.word_hashes(raw, starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[5] != h[3]
    assert list(C.inside(first, 2)) == [True, False, True, False, True]
    w = C.window_hashes(h, 2)
    assert w[0] == w[4] != w[2]


@pytest.mark.parametrize("block", [10, 500_000])
def test_contamination_brute(spark, block):
    rows = edge_rows()
    items = [(1, None), (2, ""), (30, "one"), (4, rows[20][1]), (5, " ".join(rows[7][1].split()[100:130])), (6, rows[25][1][:60]), (7, "two WORDS"), (8, "w1 w2")]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=block)
    rows_got = got.collect()
    assert sorted(tuple(r)[:6] for r in rows_got) == sorted(brute.contamination(rows, items))
    assert {r.doc_id: (r.longest_match, r.longest_at) for r in rows_got} == brute.longest_matches(rows, items)
    clean = decontaminate.clean_documents(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert clean.columns == frame(spark, []).columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in rows_got if not r.contaminated)


def test_repeated_items(spark):
    """A passage that fills the documents and the items alike makes no pairs of both."""
    line = " ".join(f"v{k}" for k in range(15))
    rows = [(k, (line + " ") * 400) for k in range(20)]
    items = [(k, line) for k in range(3000)]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.n_hit, r.n_items, r.longest_match, r.longest_at) for r in got} == {(6000, 3000, 15, 0)}


def test_contamination_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    want = sorted(c.sql(queries.oracle_sql()["op2_decontamination"]).fetchall())
    assert sorted(tuple(r) for r in decontaminate.query(spark, sf).collect()) == want


def test_long_words_and_texts():
    r = np.random.default_rng(2)
    text = "".join(r.choice(list("abc "), size=40_000)) + "x" * 3000 + " é " * 50
    raw, off = C.utf8(pa.array([text]))
    starts, ends, _ = C.words(raw, off, C.NOT_SPACE)
    whole = C.word_hashes(raw, starts, ends)
    for chunk in (7, 1000):
        before, C.CHUNK = C.CHUNK, chunk
        try:
            assert (C.word_hashes(raw, starts, ends) == whole).all()
        finally:
            C.CHUNK = before


def test_contamination_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r)[:6] for r in decontaminate.query(spark, sf).collect())
    assert got == sorted(brute.contamination(documents(spark, sf), items))
    assert any(r[5] for r in got)


def test_longest_match(spark):
    docs = [(1, "x a b c d e f g h i j k l y"), (2, "a b c")]
    items = [(1, "a b c d e f g h i j k l z")]
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].longest_match, got[1].longest_at, got[1].n_hit) == (12, 1, 12)
    assert (got[2].longest_match, got[2].longest_at) == (0, None)
    empty = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect()
    assert not any(r.contaminated for r in empty)


def test_exact_dedup(spark):
    rows = edge_rows() + [(100, "One "), (101, "O ne"), (101, "O ne")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((i, t or ""))
    want = set()
    for own in groups.values():
        keep = min(own, key=lambda x: (-len(x[1]), x[0]))[0]
        want |= {(i, keep, len(own), i == keep) for i, _ in own}
    assert got == want


def test_exact_dedup_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(c.sql(f"select {', '.join(names)} from ({queries.oracle_sql()['op4_exact_dedup']})").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.query(spark, sf).select(*names).collect()) == want


@pytest.mark.parametrize("block", [256, 2])
def test_near_brute(spark, block):
    rows = edge_rows(seed=5, n=120)
    got = sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows), block=block).collect())
    assert got == sorted(brute.near(rows))


@pytest.mark.parametrize("block", [1024, 7])
def test_near_families(spark, block):
    """Copies with changed words of their own: most pairs lie about the limit, and buckets hold several components."""
    r = np.random.default_rng(8)
    rows = []
    for family in range(6):
        base = [f"f{family}w{x}" for x in range(120)]
        for k in range(60):
            w = list(base)
            for at in r.choice(120, size=2 + family % 4, replace=False):
                w[at] = f"x{family}_{k}_{at}"
            rows.append((family * 100 + k, " ".join(w)))
    got = sorted(tuple(x) for x in minhash.near_duplicates(frame(spark, rows), block=block).collect())
    assert got == sorted(brute.near(rows))
    assert 6 < sum(x[3] for x in got) < 300


def test_intersections(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    for most in (60, 4000) * 10:
        a, b = ([np.unique(r.integers(0, most, size=r.integers(1, 40)).astype(np.uint64)) for _ in range(r.integers(1, 60))] for _ in "ab")
        assert (minhash.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_links_share_a_bucket():
    """Of 1,500 pairs of sets at 0.85 to 0.89 none is lost, neither by the bands nor by the sketch."""
    r = np.random.default_rng(4)
    bands, n = minhash.banding(85)
    for _ in range(1500):
        size = int(r.integers(50, 400))
        same = int(np.ceil(size * r.uniform(0.85, 0.89)))
        values = r.integers(1 << 63, size=size, dtype=np.uint64) << np.uint64(1)
        half = same + (size - same) // 2
        a, b = (minhash.samples(x) for x in (values[:half], np.concatenate([values[:same], values[half:]])))
        equal = (a == b)[: bands * n].reshape(bands, n).all(axis=1).any()
        assert equal and minhash.distances(*(minhash.odd_sketches(x[None, :]).view(np.uint64) for x in (a, b)))[0, 0] <= minhash.largest_distance(85)


LONG = " ".join(f"long{k}" for k in range(60))
STRAY = [(None, LONG), (None, LONG), (None, LONG + " x"), (7, "seven words of a text that is another one"), (7, "again seven but not the same text as that"), (7, "again seven but not the same text as that"), (None, None), (None, "")]


def full_frame(spark, rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, t1 long")


def test_rows_without_ids(spark):
    """Null and repeated ids: the stages decide by row."""
    docs = full_frame(spark, STRAY)
    texts = lambda df: sorted((r.text or "") for r in df.collect())
    assert texts(exact_dedup.distinct_documents(docs)) == sorted({t or "" for _, t in STRAY})
    near = minhash.representatives(docs)
    assert len({r.t1 for r in near.collect()}) == near.count() == 5
    assert sorted(t for t in texts(near) if t and not t.startswith("long")) == sorted({t for i, t in STRAY if i})
    bench = spark.createDataFrame([(1, "x " + " ".join(LONG.split()[:12]))], "item_id long, text string")
    assert not any("long" in t for t in texts(decontaminate.clean_documents(docs, bench)))
    assert decontaminate.clean_documents(docs, bench).count() == 5


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", LONG), ("a", LONG + " x"), ("c", LONG.replace(" ", "  ")), ("é", None)], "doc_id string, text string")
    assert sorted(tuple(r)[::2] for r in minhash.near_duplicates(docs).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("é", "é")]
    assert sorted(tuple(r)[:2] for r in exact_dedup.duplicate_groups(docs).collect()) == [("a", "a"), ("b", "c"), ("c", "c"), ("é", "é")]
    assert sorted(r.doc_id for r in minhash.representatives(docs).collect()) == ["a", "é"]
    assert sorted(r.doc_id for r in exact_dedup.distinct_documents(docs).collect()) == ["a", "c", "é"]


def test_near_query(spark, sf):
    assert sorted(tuple(r) for r in minhash.query(spark, sf).collect()) == sorted(brute.near(documents(spark, sf)))


def test_near_stage_brute(spark):
    """The pipeline's stage links by five words and 0.8: a text with a fifth of new words at its end or inside is a near copy."""
    import corpus_pipeline as p

    r = np.random.default_rng(3)
    words = lambda n: [f"v{x}" for x in r.integers(10_000, size=n)]
    base, other = words(200), words(200)
    rows = edge_rows(seed=6, n=120)
    rows += [(1000, " ".join(base)), (1001, " ".join(base + words(40))), (2000, " ".join(other)), (2001, " ".join(other[:100] + words(40) + other[100:])), (2002, " ".join(other + words(60)))]
    kept = {x.doc_id for x in p.near_copies(spark, frame(spark, rows), "").select("doc_id").collect()}
    assert kept == {x[0] for x in brute.near(rows, similarity=80, shingle=5) if x[3]}
    assert kept & {1000, 1001, 2000, 2001, 2002} == {1000, 2000, 2002}


def test_near_stage_table(spark, sf):
    import corpus_pipeline as p

    kept = {x.doc_id for x in p.near_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    assert kept == {x[0] for x in brute.near(documents(spark, sf), similarity=80, shingle=5) if x[3]}


@pytest.mark.parametrize("similarity,shingle", [(80, 5), (60, 2)])
def test_near_brute_parameters(spark, similarity, shingle):
    rows = edge_rows(seed=7, n=120)
    got = sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows), similarity=similarity, shingle=shingle).collect())
    assert got == sorted(brute.near(rows, similarity, shingle))


def test_banding():
    assert minhash.banding(85) == (minhash.BANDS, minhash.ROWS) and minhash.banding(80) == (42, 6)
    for s in range(40, 100):
        bands, n = minhash.banding(s)
        assert (1 - (s / 100) ** n) ** bands <= minhash.MISS and bands * n <= minhash.BANDS * minhash.ROWS


def test_odd_sketch_distance():
    assert 100 < minhash.largest_distance(85) < 200 < 256
    r = np.random.default_rng(1)
    base = r.integers(1 << 63, size=1000, dtype=np.uint64)
    other = np.concatenate([base[:919], r.integers(1 << 63, size=81, dtype=np.uint64)])  # similarity 0.85
    a, b = minhash.samples(base), minhash.samples(other)
    assert abs((a == b).mean() - 0.85) < 0.1


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def check_packing(rows, got, tokenizer):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = used = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    return used / padded


def test_packing_edges(spark, tokenizer):
    rows = [*edge_rows(), (200, "a <|endoftext|> b"), (201, "   　x​ 'll\r\n\t é́ 🙂‍🙂 " * 5), (202, "=" * 5000)]
    check_packing(rows, packing.pack_documents(frame(spark, rows), packing.tokenizer_path()).collect(), tokenizer)


def test_packing_query(spark, sf, tokenizer):
    assert check_packing(documents(spark, sf), packing.query(spark, sf).collect(), tokenizer) > 0.97


@pytest.mark.parametrize("length", [1, 2, 3, 5, 9, 17, 24, 31, 32, 33, 60, 100, 200, 255])
def test_short_pieces_fill(length):
    bins = list(packing.pack(iter([(i, 0, length) for i in range(20_000)])))
    assert 20_000 * length / (2048 * len(bins)) > 0.87 if length > 32 else 20_000 * length / (2048 * len(bins)) > 0.9


def test_mixed_short_pieces_fill():
    r = np.random.default_rng(1)
    pieces = [(i, 0, int(n)) for i, n in enumerate(r.integers(3, 33, size=50_000))]
    bins = list(packing.pack(iter(pieces)))
    assert sum(p[2] for p in pieces) / (2048 * len(bins)) > 0.95 and sorted(p for b in bins for p in b) == pieces


def test_packing_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id string, text string")
    assert sorted(r.doc_tokens for r in packing.pack_documents(docs, packing.TOKENIZER).collect()) == [1, 3]


def test_harmonic_bins():
    bins = list(packing.pack(iter([(i, 0, 1 + i * 37 % 2048) for i in range(5000)])))
    assert sum(map(len, bins)) == 5000 and all(sum(p[2] for p in b) <= 2048 for b in bins)
    assert [sum(packing.cuts(n)) for n in range(1, 5000)] == list(range(1, 5000))


def test_quality(spark):
    got = quality.query(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_statistics_brute():
    texts = [t for _, t in edge_rows()] + ["A-b (c) [d] {e} | f/g \\ #$% \"q\" 'x' ~`^_ @ <x>=+*&", "x\n\nx\ny\n", "ÀÉ日本🙂 ok!?"]
    got = quality.statistics(*C.utf8(pa.array(texts)))
    assert np.allclose(got, [brute.quality_statistics(t) for t in texts])


def test_quality_brute(spark, sf):
    rows = documents(spark, sf)
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = brute.quality_scores(rows, labels, quality.SHRINK)
    got = {r.doc_id: r.score for r in quality.query(spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-4


def test_quality_edges(spark):
    rows = edge_rows()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(frame(spark, rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(frame(spark, rows), one).collect()} == {1.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    assert len(quality.classify(frame(spark, rows), some).collect()) == len(rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, packing.tokenizer_path()).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, empty and long texts, repeated rows and clashing columns, through every stage."""
    import corpus_pipeline as p

    rows = edge_rows(seed=9, n=80) + STRAY + [(3, "one"), (3, "one"), (None, "w1 " * 40_000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, LONG), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = p.run(spark, f"{tmp_path}").collect()
    ids = {r.doc_id for r in pieces}
    assert {2, 7, None} <= ids and not any(r.doc_tokens == 121 for r in pieces)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), f"{tmp_path}").count() == 0, name


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = documents(spark, sf)
    for name, stage in p.STAGES[:-1]:
        out = C.scratch(stage(spark, docs, sf), name)
        assert out.columns == columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
            assert kept == {d for d, x in brute.quality_scores(rows, labels, quality.SHRINK).items() if x >= 0.3}
        if name == "exact_dedup":
            assert kept == {r.doc_id for r in exact_dedup.duplicate_groups(docs).filter("kept").collect()}
        if name == "near_dedup":
            assert kept == {r[0] for r in brute.near(rows, similarity=80, shingle=5) if r[3]}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept == {r[0] for r in brute.contamination(rows, items) if not r[5]}
        docs, rows = out, [r for r in rows if r[0] in kept]
    pieces = p.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows}
    assert json.dumps(p.ORACLE_SQL) == "null"


def test_maybe_in(spark, monkeypatch):
    rows = spark.range(3000).select(F.xxhash64("id").alias("t1"), "id")
    for bits in (C.MAX_BITS, 1 << 13):
        monkeypatch.setattr(C, "MAX_BITS", bits)
        got = C.maybe_in(rows, rows.filter("id % 7 = 0"), "t1").collect()
        assert len(got) == 3000 and all(r._maybe for r in got if r.id % 7 == 0)
        assert sum(r._maybe for r in got) < (440 if bits > 1 << 20 else 700)
        assert C.within(rows, rows.filter("id % 7 = 0"), "t1").count() == 429 and C.without(rows, rows.filter("id % 7 = 0"), "t1").count() == 2571


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "x " + " " * 1_000_000 + "y", "\t " * 600_000, "a" * 2_000_000], ids=["blanks", "lines", "between", "tabs", "letters"])
def test_packing_long_runs(spark, tokenizer, text):
    """White space beyond the regular expression's stack, through the operator: the ids are the tokenizer's."""
    got = packing.pack_documents(frame(spark, [(1, text), (2, "short")]), packing.TOKENIZER, keep_ids=True).collect()
    pieces = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4")
    assert ids[-1] == 1 and list(ids[:-1]) == tokenizer.encode(text, add_special_tokens=False).ids
    assert pieces[0].doc_tokens == len(ids) and any(r.doc_id == 2 for r in got)


def test_plain_vocabulary():
    spec = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3}, "merges": ["a b", "b a"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    assert packing._is_plain(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": ["b a", "a b"]}}, {"model": spec["model"] | {"dropout": 0.1}}):
        assert not packing._is_plain(spec | change)
