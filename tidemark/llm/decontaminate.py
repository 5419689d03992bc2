"""Benchmark decontamination with sparse suffix arrays of the training shards.

Every slice of training texts is a shard. Its suffix array holds the suffixes that begin with a word triple of some
test window (other suffixes can't be found); the distinct test windows are binary-searched in it, which gives all their
places. From each place the training suffix is binary-searched in the test texts' own suffix array, which gives the
longest verbatim match. No step lists pairs of a repeated passage with a repeated item.

Test words travel in broadcast blocks of BLOCK words, ROUND blocks at a time, so what is broadcast and held is bounded
whatever the benchmark's size; a larger benchmark takes several passes over the documents. Documents aren't shuffled.

Edge cases: a null or empty text has no words and no hits; a null item has no window; ids may be of any type; rows are
judged each by its own text, so null and repeated ids lose nothing; an empty benchmark contaminates nothing; an item of
more than BLOCK words is a block of its own. Other columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Words of one broadcast block of the benchmark, and blocks that a worker holds at once.
BLOCK, ROUND = 500_000, 4
_BITS = 20


def suffix_array(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All suffixes of all texts in the order of their words, by doubling the compared length; each ends with its text."""
    stop = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(h))
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1
    order, step, longest = np.argsort(rank, kind="stable"), 1, int(np.diff(first).max(initial=0))
    while step < longest:
        behind = place + step
        behind = np.where(behind < stop, rank[np.minimum(behind, len(h) - 1)], 0)
        order = np.lexsort((behind, rank))
        new = np.ones(len(h), np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (behind[order[1:]] != behind[order[:-1]])
        rank[order] = np.cumsum(new)
        step *= 2
    return order


class Needles:
    """The test windows of one block of items; what the searches need is made where it is needed."""

    def __init__(self, items: list, texts: list[str | None], window: int):
        raw, off = C.utf8(pa.array(texts, pa.string()))
        raw = C.LOWER[raw]
        starts, ends, self.first = C.words(raw, off, C.ALNUM)
        self.h, self.window, self.items = C.word_hashes(raw, starts, ends), window, [str(i) for i in items]

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("h", "first", "window", "items")}

    @cached_property
    def order(self) -> np.ndarray:
        return suffix_array(self.h, self.first)

    @cached_property
    def windows(self) -> tuple:
        """Of the distinct windows: lengths, lowest and highest keys; and their items, as bounds and numbers."""
        n = np.diff(self.first)
        many = np.where(n > 0, np.maximum(1, n - self.window + 1), 0)
        owner = np.repeat(np.arange(len(n)), many)
        at = np.repeat(self.first[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
        length = np.minimum(n[owner], self.window)
        keys = suffix_keys(self.h, at, self.first[owner + 1], self.window)
        _, one, kind = np.unique(as_bytes(np.concatenate([keys, length[:, None].astype(np.uint64)], axis=1)), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([kind, owner], axis=1), axis=0)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        low, length = keys[one], length[one]
        short = np.flatnonzero(length < self.window)
        high = low[short]
        high[np.arange(self.window)[None, :] >= length[short][:, None]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        return length, as_bytes(low), short, as_bytes(high), bounds, pairs[:, 1], at[one]

    @cached_property
    def tables(self) -> dict[int, np.ndarray]:
        """Gram length -> bitmap of the grams with which windows begin."""
        length, *_, at = self.windows
        out = {}
        for g in (1, 2, 3):
            mine = at[length == g] if g < 3 else at[length >= 3]
            if len(mine):
                out[g] = np.zeros(1 << _BITS, bool)
                out[g][C.window_hashes(self.h, g)[mine] >> np.uint64(64 - _BITS)] = True
        return out


def suffix_keys(h: np.ndarray, at: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """The first words of the suffixes at these places as rows of hashes; 0 beyond the text's end."""
    place = at[:, None] + np.arange(window)[None, :]
    keys = h[np.minimum(place, max(len(h) - 1, 0))] if len(h) else np.zeros(place.shape, np.uint64)
    keys[place >= stop[:, None]] = 0
    return keys


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows as byte strings that compare like the rows."""
    big = np.ascontiguousarray(keys.astype(">u8"))
    return big.view(f"S{8 * keys.shape[1]}").ravel()


def matches(h: np.ndarray, first: np.ndarray, test: Needles) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the distinct test window, place of a training word at which it begins)."""
    found = [np.flatnonzero(C.inside(first, g) & t[C.window_hashes(h, g) >> np.uint64(64 - _BITS)]) for g, t in test.tables.items()]
    at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = as_bytes(suffix_keys(h, at, first[np.searchsorted(first, at, "right")], test.window))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    _, low, short, high, *_ = test.windows
    lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low, "right")
    hi[short] = np.searchsorted(keys, high, "right")
    n = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(n)), n)
    return window, at[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]]


def longest(h: np.ndarray, first: np.ndarray, test: Needles, at: np.ndarray) -> np.ndarray:
    """Words of the longest match of each training suffix with any test suffix: a neighbour of its place in their order."""
    end = first[np.searchsorted(first, at, "right")]
    lo, hi, best = np.zeros(len(at), np.int64), np.full(len(at), len(test.order)), np.zeros(len(at), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        middle = (lo[live] + hi[live]) // 2
        begin = test.order[middle]
        stop = test.first[np.searchsorted(test.first, begin, "right")]
        n = np.zeros(len(live), np.int64)
        going = np.arange(len(live))
        while len(going):
            p, q = at[live[going]] + n[going], begin[going] + n[going]
            going, p, q = (x[(p < end[live[going]]) & (q < stop[going])] for x in (going, p, q))
            going = going[h[p] == test.h[q]]
            n[going] += 1
        best[live] = np.maximum(best[live], n)
        p, q = at[live] + n, begin + n
        # the test suffix comes first if it ends here or goes on with a smaller word
        ended = q >= stop
        before = ended | (p < end[live]) & (test.h[np.minimum(q, len(test.h) - 1)] < h[np.minimum(p, len(h) - 1)])
        lo[live] = np.where(before, middle + 1, lo[live])
        hi[live] = np.where(before, hi[live], middle)
    return best


class Findings:
    """What is known of the texts of one slice: covered words, items, longest matches."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        raw = C.LOWER[raw]
        starts, ends, self.first = C.words(raw, off, C.ALNUM)
        self.h = C.word_hashes(raw, starts, ends)
        n = len(off) - 1
        self.edge = np.zeros(len(self.h) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.best, self.best_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def cover(self, at: np.ndarray, stop: np.ndarray) -> None:
        np.add.at(self.edge, at, 1)
        np.add.at(self.edge, stop, -1)

    def add(self, test: Needles) -> None:
        window, at = matches(self.h, self.first, test)
        if not len(at):
            return
        lengths, *_, bounds, owners, _ = test.windows
        length = lengths[window]
        self.cover(at, at + length)
        doc = np.searchsorted(self.first, at, "right") - 1
        for d, k in np.unique(np.stack([doc, window]), axis=1).T:
            self.items[d].update(test.items[i] for i in owners[bounds[k] : bounds[k + 1]])
        full = length == test.window
        length[full] = longest(self.h, self.first, test, at[full])
        order = np.lexsort((at, -length, doc))
        for j in order[np.unique(doc[order], return_index=True)[1]]:
            d, place = doc[j], at[j] - self.first[doc[j]]
            if length[j] > self.best[d] or length[j] == self.best[d] and place < self.best_at[d]:
                self.best[d], self.best_at[d] = length[j], place

    def covered(self) -> np.ndarray:
        return np.cumsum(self.edge[:-1]) > 0

    def n_hit(self) -> np.ndarray:
        hit = np.concatenate([[0], np.cumsum(self.covered())])
        return hit[self.first[1:]] - hit[self.first[:-1]]


def scan(blocks: list, batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """The findings of these blocks and of earlier rounds: as results, or in the form that the next round adds to."""
    for batch, raw, off in C.chunks(batches, "text"):
        found = Findings(raw, off)
        if "spans" in batch.schema.names:
            for d in range(batch.num_rows):
                spans = batch.column("spans")[d].as_py()
                found.cover(found.first[d] + np.array(spans[::2], np.int64), found.first[d] + np.array(spans[1::2], np.int64))
                found.items[d] = set(batch.column("items")[d].as_py())
            found.best, found.best_at = (batch.column(c).to_numpy().copy() for c in ("best", "best_at"))
        for b in blocks:
            found.add(b.value)
        if last:
            n_hit = found.n_hit()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(np.diff(found.first), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in found.items], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items],
                "contaminated": pa.array(n_hit > 0),
                "longest_match": pa.array(found.best, pa.int64()),
                "longest_at": pa.array(found.best_at, pa.int64(), mask=found.best_at < 0),
            })
        else:
            covered = found.covered()
            spans = []
            for a, b in zip(found.first[:-1], found.first[1:], strict=True):
                spans.append(np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text": batch.column("text"),
                "spans": pa.array(spans, pa.list_(pa.int64())),
                "items": pa.array([sorted(x) for x in found.items], pa.list_(pa.string())),
                "best": found.best,
                "best_at": found.best_at,
            })


SCHEMA = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"
STATE = "doc_id {id}, text string, spans array<long>, items array<string>, best long, best_at long"


def rounds(benchmark: DataFrame, window: int, item_id: str, item_text: str, block: int) -> Iterator[tuple[list, bool]]:
    """Broadcast blocks of the benchmark, ROUND at a time, and whether these are the last."""
    context = benchmark.sparkSession.sparkContext
    blocks, items, texts, size = [], [], [], 0

    def close() -> None:
        nonlocal items, texts, size
        blocks.append(context.broadcast(Needles(items, texts, window)))
        items, texts, size = [], [], 0

    for row in benchmark.select(item_id, item_text).toLocalIterator():
        if size >= block:
            close()
            if len(blocks) > ROUND:
                yield blocks[:ROUND], False
                blocks = blocks[ROUND:]
        items.append(row[0])
        texts.append(row[1])
        raw, off = C.utf8(pa.array([row[1]], pa.string()))
        size += len(C.words(C.LOWER[raw], off, C.ALNUM)[0]) + 1
    close()
    if len(blocks) > ROUND:
        yield blocks[:ROUND], False
        blocks = blocks[ROUND:]
    yield blocks, True


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document the words that lie in an occurrence of a window of the benchmark, and its longest match.

    A window is `window` consecutive words of an item; a shorter item is one window. longest_match counts the words of
    the longest verbatim match that begins at a window's place, longest_at is its first place in the document.
    """
    C.tune(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    state = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    for blocks, last in rounds(benchmark, window, item_id, item_text, block):
        found = state.mapInArrow(lambda it, own=blocks, end=last: scan(own, it, end), (SCHEMA if last else STATE).format(id=kind))
        if last:
            return found
        before, state = state, C.scratch(found, "contamination")
        C.discard(before)
        for b in blocks:
            b.destroy()


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents without a contaminated word, each judged by its own text, with all their columns."""
    C.tune(docs.sparkSession)

    def decide(blocks: list, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        found = Findings(raw, off)
        for b in blocks:
            found.add(b.value)
        return found.n_hit() == 0

    for blocks, last in rounds(benchmark, window, item_id, item_text, block):
        kept = C.keep_by_text(docs, text, lambda raw, off, own=blocks: decide(own, raw, off))
        if last:
            return kept
        before, docs = docs, C.scratch(kept, "clean")
        C.discard(before)
        for b in blocks:
            b.destroy()


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
  docs AS (SELECT doc_id, {_WORDS} AS t FROM documents),
  win AS (SELECT item_id, least(len(t), 10) AS n, unnest(list_transform(range(1, greatest(len(t) - 8, 2)), lambda k: array_to_string(t[k:k + 9], ' '))) AS g, unnest(range(1, greatest(len(t) - 8, 2))) AS i FROM items WHERE len(t) > 0),
  sizes AS (SELECT DISTINCT n FROM win),
  grams AS (SELECT doc_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda k: array_to_string(t[k:k + n - 1], ' '))) AS g, unnest(range(1, len(t) - n + 2)) AS k FROM docs, sizes WHERE len(t) >= n),
  hit AS (SELECT doc_id, k, n, item_id, i FROM grams JOIN win USING (n, g)),
  covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hit) GROUP BY 1),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1),
  runs AS (SELECT doc_id, n, k, k - row_number() OVER (PARTITION BY doc_id, item_id, n, k - i ORDER BY k) AS r, item_id, k - i AS d FROM hit),
  long AS (SELECT doc_id, n + count(*) - 1 AS words, min(k) - 1 AS place FROM runs GROUP BY doc_id, item_id, n, d, r),
  best AS (SELECT doc_id, max(words) AS words, min(place) FILTER (words = most) AS place FROM (SELECT *, max(words) OVER (PARTITION BY doc_id) AS most FROM long) GROUP BY 1)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(words, 0) AS BIGINT) AS longest_match, CAST(place AS BIGINT) AS longest_at
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""
