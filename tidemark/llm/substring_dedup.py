"""Substring deduplication: words in passages that an earlier document has too are removed.

Two operators.

remove_reference_spans() has a bounded reference. Its words become suffix automata of at most SHARD_WORDS words each,
which are broadcast; documents are streamed through them for matching statistics, and every maximal span of at least
`window` words goes.

remove_repeats() has the corpus itself as its reference, whose automata would be as large as the corpus, so nothing
may broadcast them, and streaming all documents through all shards is quadratic. It takes another way to the same
spans: the windows of `window` words that two documents share.
1. Winnowing: the smallest hash of a window's GRAM-word grams is its fingerprint. Equal windows have equal
   fingerprints, and neighbouring windows mostly share theirs, so a document has few. (fingerprint, document) pairs
   are dealt by fingerprint and sorted; only fingerprints of two documents go on. The FREQUENT most frequent ones of a
   sample are known to be of several documents, so they take part without being dealt; any other one has less than
   1 / FREQUENT of the sample's pairs, so no task gets a hot one.
2. Windows of the remaining fingerprints are grouped by their own 64-bit hash, pre-aggregated: smallest document.
3. Windows whose smallest document is another one mark their words; the rest is joined by single spaces.

Edge cases: a null or empty text has no words; texts shorter than a window lose nothing; repeats within one document
stay; rows that share a doc_id count as one document for each other but each get a row; rows without a doc_id lose and
lend nothing; ids are integers, since windows are judged by smaller ids, and others are refused; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 13, 5
#: Share of the documents, by hash of their id, in which frequent fingerprints are looked for, and how many are kept.
SAMPLE, FREQUENT = 64, 50_000
#: Words of one automaton, and of all that may be broadcast.
SHARD_WORDS, REFERENCE_WORDS = 200_000, 4_000_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def fingerprints(raw: np.ndarray, off: np.ndarray, window: int) -> tuple:
    """Word starts and ends, first words, fingerprint of each window, and whether the window lies in one text."""
    starts, ends, first = C.words(raw, off, C.NOT_SPACE)
    h = C.word_hashes(raw, starts, ends)
    gram = min(GRAM, window)
    return starts, ends, first, h, sliding_min(C.window_hashes(h, gram), window - gram + 1), C.inside(first, window)


def _bounds(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each text, as ranges."""
    return first[:-1], np.maximum(first[1:] - window + 1, first[:-1])


def emit_fingerprints(window: int, frequent: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in C.chunks(batches, "text"):
        *_, first, _, fp, ok = fingerprints(raw, off, window)
        new = ok.copy()
        new[1:] &= (fp[1:] != fp[:-1]) | ~ok[:-1]
        at = np.flatnonzero(new)
        doc = np.searchsorted(first, at, "right") - 1
        fp = fp[at].view(np.int64)
        if len(frequent):
            keep = frequent[np.minimum(np.searchsorted(frequent, fp), len(frequent) - 1)] != fp
            fp, doc = fp[keep], doc[keep]
        ids = batch.column("doc_id").take(pa.array(doc))
        yield pa.RecordBatch.from_pydict({"fp": pa.array(fp), "doc_id": ids})


def shared_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by fingerprint and document; keeps those of several documents, and says who isn't first.

    Only the open group's fingerprint and first document are held from batch to batch; of the first document's rows one
    is kept, as soon as another document turns up.
    """
    held_fp = held_doc = None
    sent = (None, None)  # the last pair of the batch before
    waiting = False  # whether the open group's first document has yet to be sent
    for batch in batches:
        fp, doc = batch.column("fp").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(fp):
            continue
        new = np.ones(len(fp), bool)  # a document counts once for a fingerprint
        new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
        new[0] = (fp[0], doc[0]) != sent
        sent = (fp[-1], doc[-1])
        fp, doc = fp[new], doc[new]
        if not len(fp):
            continue
        start = np.ones(len(fp), bool)
        start[1:] = fp[1:] != fp[:-1]
        start[0] = held_fp is None or fp[0] != held_fp
        group = np.cumsum(start)
        own = np.flatnonzero(start)
        lowest = np.concatenate([[held_doc or 0], doc[own]])
        later = doc > lowest[group]
        several = np.bincount(group[later], minlength=len(lowest)) > 0
        first_fp, first_doc = fp[own][several[1:]], doc[own][several[1:]]
        if waiting and several[0]:
            first_fp, first_doc = np.append(first_fp, held_fp), np.append(first_doc, held_doc)
        yield pa.RecordBatch.from_pydict({
            "fp": pa.array(np.concatenate([fp[later], first_fp]), pa.int64()),
            "doc_id": pa.array(np.concatenate([doc[later], first_doc]), pa.int64()),
            "later": pa.array(np.arange(later.sum() + len(first_fp)) < later.sum()),
        })
        waiting = (waiting or len(own) > 0) and not several[-1]
        held_fp, held_doc = fp[-1], lowest[-1]


def _values(lists, i: int) -> np.ndarray:
    return lists.values.to_numpy()[lists.offsets[i].as_py() : lists.offsets[i + 1].as_py()]


def candidate_windows(window: int, frequent: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For documents with shared fingerprints the hashes and places of the windows in question."""
    for batch, raw, off in C.chunks(batches, "text"):
        _, _, first, h, fp, _ = fingerprints(raw, off, window)
        fp = fp.view(np.int64)
        own = C.window_hashes(h, window).view(np.int64)
        hot = np.zeros(len(fp), bool)
        if len(frequent) and len(fp):
            hot = frequent[np.minimum(np.searchsorted(frequent, fp), len(frequent) - 1)] == fp
        lo, hi = _bounds(first, window)
        later, firsts = batch.column("later"), batch.column("firsts")
        rows, w, places, lent = [], [], [], []
        for i in range(batch.num_rows):
            a, b = lo[i], hi[i]
            if b <= a:
                continue
            mine, likely, unlikely = fp[a:b], hot[a:b].copy(), None
            if later[i].is_valid:
                likely |= np.isin(mine, _values(later, i))
                unlikely = own[a:b][np.isin(mine, _values(firsts, i)) & ~likely]
            at = np.flatnonzero(likely)
            if len(at) or unlikely is not None and len(unlikely):
                rows.append(i)
                w.append(own[a:b][at])
                places.append(at.astype(np.int32))
                lent.append(np.unique(unlikely) if unlikely is not None else own[:0])
        keep = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(keep),
            "t": batch.column("t").take(keep),
            "w": pa.array(w, pa.list_(pa.int64())),
            "at": pa.array(places, pa.list_(pa.int32())),
            "w_first": pa.array(lent, pa.list_(pa.int64())),
        })


def cut(window: int, keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        gone, texts = batch.column("gone"), batch.column("text").to_pylist()
        n_words, n_removed, digest, kept_text = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [None] * n
        for i, text in enumerate(texts):
            own = (text or "").encode().split()
            n_words[i] = len(own)
            if gone[i].is_valid:
                edge = np.zeros(len(own) + 1, np.int32)
                places = np.asarray(gone[i].values)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
                own = [x for x, k in zip(own, np.cumsum(edge[:-1]).tolist(), strict=True) if not k]
            n_removed[i] = n_words[i] - len(own)
            joined = b" ".join(own)
            digest.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                kept_text[i] = joined.decode()
        out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            out["kept_text"] = pa.array(kept_text, pa.string())
        yield pa.RecordBatch.from_pydict(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with keep_text also the kept words."""
    spark = docs.sparkSession
    C.tune(spark)
    if dict(docs.dtypes)[doc_id] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{doc_id} must be an integer")
    # t tells rows apart that share a doc_id
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("t"))
    pairs = "fp long, doc_id long"
    none = np.empty(0, np.int64)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    seen = some.mapInArrow(lambda it: emit_fingerprints(window, none, it), pairs).distinct().groupBy("fp").agg(F.count("doc_id").alias("n"))
    frequent = np.sort(np.array([r[0] for r in seen.filter("n >= 3").orderBy(F.desc("n"), "fp").limit(FREQUENT).collect()], np.int64))

    # "later" rows may lose words; the first document of a fingerprint only lends its windows
    named = docs.filter("doc_id is not null")
    dealt = named.mapInArrow(lambda it: emit_fingerprints(window, frequent, it), pairs).repartition("fp").sortWithinPartitions("fp", "doc_id")
    shared = dealt.mapInArrow(shared_fingerprints, "fp long, doc_id long, later boolean")
    lists = shared.groupBy("doc_id").agg(F.collect_list(F.when(F.col("later"), F.col("fp"))).alias("later"), F.collect_list(F.when(~F.col("later"), F.col("fp"))).alias("firsts"))
    lists = C.scratch(lists, "fingerprints")
    C.release(spark)
    both = C.left_join_some(docs, lists, ["doc_id"])
    schema = "doc_id long, t long, w array<long>, at array<int>, w_first array<long>"
    windows = C.scratch(both.mapInArrow(lambda it: candidate_windows(window, frequent, it), schema), "windows")
    C.discard(lists)
    # rows that repeat an id and text have the same windows, which count once and mark all of them
    repeated = C.scratch(docs.groupBy("doc_id", "t").agg(F.count("*").alias("n")).filter("n > 1").select("t"), "repeated")
    if repeated.limit(1).count():
        own = C.maybe_in(windows, repeated, "t")
        windows = C.scratch(own.filter("not _maybe").drop("_maybe").union(own.filter("_maybe").drop("_maybe").dropDuplicates(["doc_id", "t"])), "windows")
    C.discard(repeated)
    del both, lists, shared, dealt
    C.release(spark)

    all_ = windows.select("doc_id", F.explode(F.array_distinct(F.concat("w", "w_first"))).alias("win"))
    lowest = C.scratch(all_.groupBy("win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("win", "lo", "n"), "lowest")
    del all_
    C.release(spark)
    asked = windows.select("doc_id", "t", F.inline(F.arrays_zip(F.col("w").alias("win"), F.col("at").alias("place"))))
    # a common window has as many rows as documents: hot ones are broadcast and dealt out
    pairs = lowest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = C.join_groups(asked, lowest, ["win"], "n", "doc_id", pairs).filter("doc_id > lo").groupBy("doc_id", "t").agg(F.collect_list("place").alias("gone"))
    gone = C.scratch(gone, "gone")
    C.discard(lowest, windows)
    del asked, lowest, windows
    C.release(spark)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return C.left_join_some(docs, gone, ["doc_id", "t"]).select("doc_id", "text", "gone").mapInArrow(lambda it: cut(window, keep_text, it), out)


class SuffixAutomaton:
    """Of sequences of word hashes, one after the other; no match runs across two of them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's words and c; a copy of q where q stands for longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def matching_statistics(self, words: list[int]) -> list[int]:
        """For each place the length of the longest match that ends there."""
        state = n = 0
        out = []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            out.append(n)
        return out


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", limit: int = REFERENCE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text after removing every span of `window` or more words of a reference text.

    reference: a column `text`. A reference of more than `limit` words is refused: union it with the documents, under
    smaller ids, and take remove_repeats() instead.
    """
    spark = docs.sparkSession
    C.tune(spark)
    shards, own, size, total = [], [], 0, 0

    def hashes(column) -> list[list[int]]:
        raw, off = C.utf8(column)
        starts, ends, first = C.words(raw, off, C.NOT_SPACE)
        h = C.word_hashes(raw, starts, ends).tolist()
        return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    for row in reference.select("text").toLocalIterator():
        s = hashes(pa.array([row[0]], pa.string()))[0]
        own.append(s)
        size, total = size + len(s), total + len(s)
        if total > limit:
            raise ValueError(f"the reference has more than {limit} words")
        if size >= shard_words:
            shards.append(spark.sparkContext.broadcast(SuffixAutomaton(own)))
            own, size = [], 0
    if own:
        shards.append(spark.sparkContext.broadcast(SuffixAutomaton(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, h in zip(batch.column("text").to_pylist(), hashes(batch.column("text")), strict=True):
                edge = np.zeros(len(h) + 1, np.int64)
                for shard in shards:
                    n = np.array(shard.value.matching_statistics(h), np.int64)
                    end = np.flatnonzero(n >= window)
                    np.add.at(edge, end + 1 - n[end], 1)
                    np.add.at(edge, end + 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = (t or "").encode().split()
                rows.append((len(h), int((~keep).sum()), b" ".join(w for w, k in zip(words, keep, strict=True) if k).decode()))
            n_words, n_removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.load(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
  grams AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i + 12], ' '))) AS g, unnest(range(1, len(t) - 11)) AS i FROM docs WHERE len(t) >= 13),
  firsts AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM grams JOIN firsts USING (g) WHERE lo < doc_id),
  words AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS j FROM docs),
  kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""
