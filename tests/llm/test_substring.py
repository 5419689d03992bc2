import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.data import edge_rows, frame
from tidemark.llm import substring_dedup as S


def test_brute(spark):
    rows = edge_rows(seed=3, n=150)
    got = sorted(tuple(r) for r in S.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted(brute.repeats(rows))
    assert any(r[2] for r in got)


def test_frequent_passage(spark):
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" for _ in range(10)) + " " + passage) for i in range(900)]
    assert sorted(tuple(x) for x in S.remove_repeats(frame(spark, rows)).collect()) == sorted(brute.repeats(rows))


def test_shared_fingerprints_brute():
    """The same rows for every way to cut them into batches."""
    r = np.random.default_rng(1)
    for t in range(100):
        rows = sorted(zip(r.integers(0, 12, size=60).tolist(), r.integers(0, 3 + t % 5, size=60).tolist(), strict=True))
        docs = {f: {d for g, d in rows if g == f} for f, _ in rows}
        want = {(f, d, d > min(docs[f])) for f, d in rows if len(docs[f]) > 1}
        cuts = [0, *sorted(r.integers(0, 61, size=t % 7).tolist()), 60]
        batches = [pa.RecordBatch.from_pydict({"fp": pa.array([x[0] for x in rows[a:b]], pa.int64()), "doc_id": pa.array([x[1] for x in rows[a:b]], pa.int64())}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        got = [tuple(x.values()) for b in S.shared_fingerprints(iter(batches)) for x in b.to_pylist()]
        assert set(got) == want and len({x for x in got if not x[2]}) == len([x for x in got if not x[2]])


def test_string_ids(spark):
    with pytest.raises(ValueError):
        S.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.query(spark, sf).collect()) == sorted(brute.repeats(docs))


def test_kept_text(spark):
    rows = edge_rows(seed=4, n=80)
    for r in S.remove_repeats(frame(spark, rows), keep_text=True).collect():
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_empty(spark):
    assert S.remove_repeats(frame(spark, [])).count() == 0
    assert S.remove_repeats(frame(spark, [(None, "a b"), (1, None)])).count() == 2


def test_automaton():
    r = random.Random(1)
    for _ in range(200):
        refs = [[r.randrange(3) for _ in range(r.randrange(12))] for _ in range(3)]
        words = [r.randrange(3) for _ in range(15)]
        runs = {tuple(s[i:j]) for s in refs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([0, *(n for n in range(1, k + 2) if tuple(words[k + 1 - n : k + 1]) in runs)]) for k in range(len(words))]
        assert S.SuffixAutomaton(refs).matching_statistics(words) == want


def test_reference_spans(spark):
    rows, refs = edge_rows(seed=6, n=60), [(" ".join(f"w{i}" for i in range(30)),), (edge_rows(seed=6, n=60)[30][1],), (None,)]
    got = {r.doc_id: r for r in S.remove_reference_spans(frame(spark, rows), spark.createDataFrame(refs, "text string"), window=5, shard_words=20).collect()}
    grams = {tuple(w[k : k + 5]) for (t,) in refs for w in [brute.plain_words(t)] for k in range(len(w) - 4)}
    for d, t in rows:
        w = brute.plain_words(t)
        gone = {k + j for k in range(len(w) - 4) if tuple(w[k : k + 5]) in grams for j in range(5)}
        assert got[d].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_repeated_rows(spark):
    """Rows that share a doc_id are judged each by their own text, and not by each other's."""
    run = lambda a: " ".join(f"{a}{i}" for i in range(20))
    rows = [(1, run("a")), (2, run("a") + " " + run("b")), (2, run("c")), (2, run("c")), (3, run("c"))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 20, 0), (2, 20, 0), (2, 20, 0), (2, 40, 20), (3, 20, 20)]


def test_many_equal_rows(spark):
    """Rows that repeat an id and a long text cost no more than others."""
    import time

    text = " ".join(f"w{k}" for k in range(2000))
    rows = [(1, text)] + [(2, text + " tail")] * 4000 + [(3, "a b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    began = time.time()
    got = {tuple(r) for r in S.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {(1, 2000, 0), (2, 2001, 2000), (3, 2, 0)}
    assert time.time() - began < 240


def test_equal_pairs_over_batches():
    batch = lambda rows: pa.RecordBatch.from_pydict({"fp": pa.array([f for f, _ in rows], pa.int64()), "doc_id": pa.array([d for _, d in rows], pa.int64())})
    parts = [[(1, 1), (1, 1), (1, 2)], [(1, 2)], [(1, 2), (1, 3), (2, 5)], [(2, 5), (3, 1), (3, 4)]]
    got = [(f, d, later) for b in S.shared_fingerprints(map(batch, parts)) for f, d, later in zip(*(b.column(c).to_pylist() for c in ("fp", "doc_id", "later")), strict=True)]
    assert sorted(got) == [(1, 1, False), (1, 2, True), (1, 3, True), (3, 1, False), (3, 4, True)]
