"""Phrase collocations of each language: frequent phrases by how much more often their parts meet than chance has it.

Texts in lower case (A-Z) are split into pieces at MARKS and pieces into words at blanks and tabs. Everything is counted
by language: words carry their language in their 64-bit hash, and a phrase's hash is made of its words' hashes in order.

Counting follows SPAM. A task takes its texts as shards of about SHARD words. A shard holds, for each word that is
frequent in the whole corpus, a compressed bitmap of the positions at which it occurs: the 64-bit blocks that have any
bit, with the numbers of these blocks, all words' blocks in one sorted array. A phrase's bitmap is shifted by one place
(the top bit of a block is carried into the next), ANDed with the complement of the bitmap of positions that begin a
piece, and ANDed with the bitmaps of the words that occur there; the popcounts of what results are the counts of the
longer phrases. Phrases are extended depth-first, a group of first words after the other, so that memory is bounded by
the group. Shards are cut anywhere: a shard also sees the words that follow its own, and counts the phrases that begin in
its own.

Popcounts are summed over the shards by phrase. A phrase can be frequent only if all its parts are, so counting goes by
length: words, two words, three words, and then four and five depth-first in one pass; each pass extends only what the
bitmap of frequent phrases of the pass before lets through. That bitmap has about eight bits a phrase and 32 MB at most
whatever the corpus; what it lets through in error is counted and dropped.

Edge cases: a null text is empty; a null language counts as `und`; repeated rows count each; very long texts and pieces
are cut into shards without losing a phrase; an empty table gives an empty result; other columns are not read. Hashes have
64 bits: at 10^9 distinct phrases the chance of any mix-up is about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common as C

LEAST, LONGEST, FIRST, SHARE = 100, 5, 2000, 100
#: Words of a shard, and positions of a group of first words that are extended together.
SHARD, GROUP = 1 << 20, 1 << 18
#: Bytes of the marks that split pieces, and of what separates words within them.
MARKS = C.byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
WORD = ~(MARKS | C.byte_class((0x20, 0x20), (0x09, 0x09)))
#: Steps of the scores by whose counts the lists are cut before rows are sorted: per doubling.
STEPS = 64

_ONE = np.uint64(1)
# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of 8 bytes."""
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(8)
        h = _turned(h ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def joined(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase that is one word longer; what xxhash64(phrase, word) of two numbers is in SQL."""
    return _hash(word, _hash(phrase, np.uint64(42)))


class Filter:
    """A bitmap of hashes."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.bits - 1)
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def filter_of(hashes: DataFrame, count: int) -> Filter:
    """Of column g, with about eight bits each, 32 MB at most."""
    bits = min(max(1 << 20, 1 << (8 * count).bit_length()), C.MAX_BITS)
    slot = F.pmod(F.col("g"), F.lit(bits)) + 1  # these functions count from 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        own = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        at = (r["bucket"] - 1) * len(own)
        out[at : at + len(own)] = own[: max(0, len(out) - at)]
    return Filter(bits, out)


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the batches: the batch, lower-cased bytes, starts and ends of words, each text's first word, the words' hashes and which begin a piece."""
    for batch, raw, off in C.chunks(batches, "text"):
        raw = C.LOWER[raw]
        starts, ends, first = C.words(raw, off, WORD)
        own = np.array([xxh64_intdigest(x) for x in batch.column("lang").to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            h = _hash(C.word_hashes(raw, starts, ends), np.repeat(own, np.diff(first)))
        begins = np.zeros(len(starts), bool)
        marks = np.flatnonzero(MARKS[raw])
        after = np.searchsorted(marks, starts)  # marks before each word
        begins[1:] = after[1:] != after[:-1]
        begins[first[:-1][np.diff(first) > 0]] = True
        yield batch, raw, starts, ends, first, h, begins


def count_words(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, g, word and n: what a shard has."""
    held: list[pa.RecordBatch] = []
    have = 0

    def summed() -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        _, at, back = np.unique(own.column("g").to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(back, own.column("n").to_numpy()).astype(np.int64)
        return own.take(pa.array(at)).set_column(3, "n", pa.array(n)).combine_chunks().to_batches()[0]

    for batch, raw, starts, ends, first, h, _ in words_of(batches):
        text = np.repeat(np.arange(batch.num_rows), np.diff(first))
        g, at, n = np.unique(h, return_index=True, return_counts=True)
        data, s, e = raw.tobytes(), starts[at].tolist(), ends[at].tolist()
        own = pa.array([data[a:b].decode() for a, b in zip(s, e, strict=True)], pa.string())
        held.append(pa.RecordBatch.from_pydict({"lang": batch.column("lang").take(pa.array(text[at])), "g": pa.array(g.view(np.int64)), "word": own, "n": pa.array(n)}))
        have += len(h)
        if have >= size:
            yield summed()
            held, have = [], 0
    if have:
        yield summed()


def shards(batches: Iterator[pa.RecordBatch], longest: int, size: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes, marks of what begins a piece, and how many of the words are the shard's own; the others may only follow."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0

    def cut(last: bool):
        nonlocal held, have
        h, begins = (np.concatenate(x) for x in zip(*held, strict=True))
        at = 0
        while len(h) - at >= size + longest - 1 or last and at < len(h):
            own = min(size, len(h) - at)
            yield h[at : at + own + longest - 1], begins[at : at + own + longest - 1], own
            at += own
        held, have = [(h[at:], begins[at:])], len(h) - at

    for *_, h, begins in words_of(batches):
        held.append((h, begins))
        have += len(h)
        if have >= size + longest - 1:
            yield from cut(False)
    if have:
        yield from cut(True)


def packed(flags: np.ndarray) -> np.ndarray:
    """Flags as blocks of 64 bits, and one empty block."""
    out = np.packbits(flags, bitorder="little")
    return np.concatenate([out, np.zeros(8 + -len(out) % 8, np.uint8)]).view(np.uint64)


def extensions(h: np.ndarray, begins: np.ndarray, own: int, known: list[Filter], low: int, high: int, group: int = GROUP) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, parent, word, count of the phrases of low to high words that begin at one of the shard's own words.

    known: filters of frequent words, phrases of two words, and so on; all parts of a phrase must pass them.
    """
    place = np.flatnonzero(known[0](h))
    words, wid = np.unique(h[place], return_inverse=True)
    order = np.argsort(wid, kind="stable")
    place, wid = place[order], wid[order]
    # the vertical bitmaps: a row for each block of a word that has any bit
    key = np.stack([wid, place >> 6])
    head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(place) else np.zeros(0, int)
    if not len(head):
        return
    bitmap = np.bitwise_or.reduceat(_ONE << (place & 63).astype(np.uint64), head)
    of_word, of_block = wid[head], place[head] >> 6
    row_at = np.full((len(h) | 63) + 65, -1, np.int32)  # the row of the word at a position
    row_at[place] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(place)))).astype(np.int32)
    may_follow = packed(~begins) & packed(row_at[: len(h)] >= 0)
    mine = packed(np.arange(len(h)) < own)

    def deeper(n: int, g, tails, phrase, block, bits):
        """g: hashes of the phrases of n words; tails: hashes of them without their first words; their blocks and bits."""
        carried = bits >> np.uint64(63) == 1
        phrase, block = np.concatenate([phrase, phrase[carried]]), np.concatenate([block, block[carried] + 1])
        bits = np.concatenate([bits << _ONE, np.ones(carried.sum(), np.uint64)]) & may_follow[block]
        found = []
        while True:
            some = bits != 0
            phrase, block, bits = phrase[some], block[some], bits[some]
            if not len(bits):
                break
            lowest = np.bitwise_count((bits & (~bits + _ONE)) - _ONE).astype(np.int64)
            row = row_at[block * 64 + lowest]
            both = bits & bitmap[row]  # where the word of the lowest position follows
            found.append((phrase, of_word[row], block, both))
            bits = bits ^ both
        if not found:
            return
        phrase, word, block, both = (np.concatenate(x) for x in zip(*found, strict=True))
        longer, back = np.unique(phrase.astype(np.int64) * len(words) + word, return_inverse=True)
        count = np.bincount(back, np.bitwise_count(both)).astype(np.int64)
        parent, w = longer // len(words), words[longer % len(words)]
        new = [w, *(joined(t[parent], w) for t in tails)][: len(known)]
        ok = np.ones(len(longer), bool)
        for k, t in enumerate(new[1:], 1):
            ok &= known[k](t)
        if n + 1 >= low:
            yield n + 1, g[parent[ok]], w[ok], count[ok]
        if n + 1 < high:
            g = joined(g[parent], w)
            if n < len(known):
                ok &= known[n](g)
            keep = ok[back]
            again = np.cumsum(ok) - 1
            yield from deeper(n + 1, g[ok], [t[ok] for t in new], again[back[keep]], block[keep], both[keep])

    bits = bitmap & mine[of_block]
    bounds = np.searchsorted(of_word, np.arange(len(words) + 1))
    sizes = np.cumsum(np.diff(bounds))
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + group, "right")))
        rows = slice(bounds[first], bounds[last])
        yield from deeper(1, words[first:last], [], of_word[rows] - first, of_block[rows], bits[rows])
        first = last


def count_longer(known: list[Filter], low: int, high: int, size: int, group: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, begins, own in shards(batches, high, size):
        for length, parent, word, n in extensions(h, begins, own, known, low, high, group):
            yield pa.RecordBatch.from_pydict({"length": pa.array(np.full(len(n), length, np.int32)), "parent": pa.array(parent.view(np.int64)), "w": pa.array(word.view(np.int64)), "n": pa.array(n)})


def _looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join with a table of one row a key; keys that many rows share are dealt out."""
    fan = C.scratch(rows.groupBy(key).agg(F.count("*").alias("_fan")).join(table, key), "fan")
    return C.join_groups(rows, fan, [key], "_fan", spread, rows.count()).drop("_fan")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, size: int = SHARD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """lang, length, g, hashes (of the words), phrase and a of all phrases that occur often enough; and lang, n of all languages."""
    spark = docs.sparkSession
    C.tune(spark)
    own = docs.select(docs[text].alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))
    every = own.mapInArrow(lambda it: count_words(size, it), "lang string, g long, word string, n long").groupBy("lang", "g").agg(F.min("word").alias("phrase"), F.sum("n").alias("a"))
    every = C.scratch(every, "words")
    totals = C.scratch(every.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    words = C.scratch(every.filter(F.col("a") >= least).select("lang", F.lit(1).alias("length"), "g", F.array("g").alias("hashes"), "phrase", "a"), "frequent")
    C.discard(every)
    levels, known = [words], []
    for low, high in [(n, n) for n in range(2, min(3, longest) + 1)] + [(4, longest)] * (longest > 3):
        known.append(filter_of(levels[-1].select("g"), levels[-1].count()))
        shared = spark.sparkContext.broadcast(list(known))
        rows = own.mapInArrow(lambda it, s=shared, lo=low, hi=high: count_longer(s.value, lo, hi, size, group, it), "length int, parent long, w long, n long")
        rows = rows.groupBy("length", "parent", "w").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        rows = C.scratch(rows, "longer")
        C.release(spark)
        follow = words.select(F.col("g").alias("w"), F.col("phrase").alias("word"))
        for n in range(low, high + 1):
            before = levels[-1].select(F.col("g").alias("parent"), "lang", "hashes", "phrase")
            longer = _looked_up(_looked_up(rows.filter(F.col("length") == n), before, "parent", "w"), follow, "w", "parent")
            longer = longer.select("lang", "length", F.xxhash64("parent", "w").alias("g"), F.concat("hashes", F.array("w")).alias("hashes"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "a")
            levels.append(C.scratch(longer.filter("lang is not null"), "frequent"))
        C.discard(rows)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out, totals


def part_hash(hashes, at, n):
    """Of n word hashes from one place on, as SQL."""
    return F.aggregate(F.slice(hashes, at + 2, n - 1), F.get(hashes, at), lambda g, w: F.xxhash64(g, w))


def scored(phrases: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates with l, r, n and score of their lowest cut, without those that are as frequent inside of a longer one."""
    table = phrases.select("g", F.col("a").alias("f"))
    longer = phrases.filter("length > 1")
    h, size = F.col("hashes"), F.col("length")
    cuts = longer.select("g", "lang", "length", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), part_hash(h, F.lit(0), k).alias("left"), part_hash(h, k, size - k).alias("right")))).alias("c"))
    cuts = C.scratch(cuts.select("g", "lang", "a", "c.*"), "cuts")
    cuts = _looked_up(cuts, table.toDF("left", "l"), "left", "g")
    cuts = _looked_up(C.scratch(cuts, "cuts"), table.toDF("right", "r"), "right", "g")
    cuts = _looked_up(C.scratch(cuts, "cuts"), totals, "lang", "g")
    whole = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({whole(1000)} * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    best = cuts.withColumn("score", score).groupBy("g").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))
    # the parts of two words or more of each candidate
    spans = lambda n: F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda w: F.transform(F.sequence(F.lit(0), n - w), lambda at: part_hash(h, at, w))))
    inside = longer.filter("length > 2").select(F.explode(F.array_distinct(spans(size))).alias("g"), "a").groupBy("g").agg(F.max("a").alias("within"))
    out = longer.select("g", "lang", "phrase", "a").join(best, "g").join(inside, "g", "left")
    out = out.filter(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
    return out.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def ranked(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """The first of each language by score, a and phrase, with their rank.

    Counts of steps of the scores tell which steps the first can be in, so that only these are sorted; of larger steps
    (ties) the first of each of many parts are found before.
    """
    rows = C.scratch(rows.withColumn("step", F.floor(F.log2(F.col("score") + 1.0) * STEPS).cast("int")), "scored")
    total = rows.count()
    steps = rows.groupBy("lang", "step").agg(F.count("*").alias("size"))  # a language has 64 * STEPS at most
    before = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    steps = C.scratch(steps.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < first).drop("before"), "steps")
    rows = C.join_groups(rows, steps, ["lang", "step"], "size", "phrase", total).filter("size is not null").drop("size", "step")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, total // (16 * first))
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, size: int = SHARD, group: int = GROUP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return ranked(scored(*frequent_phrases(docs, text, lang, least, longest, size, group)), first)


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(C.load(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w" for k in range(1, LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, k, {c} AS c, array_to_string(t[1:{c}], ' ') AS x, array_to_string(t[{c + 1}:k], ' ') AS y FROM s WHERE k > {c}" for c in range(1, LONGEST))
    spans = " UNION ALL ".join(f"SELECT lang, array_to_string(t[{at}:{at + n - 1}], ' ') AS phrase, a FROM s WHERE k > {n} AND k >= {at + n - 1}" for n in range(2, LONGEST) for at in range(1, LONGEST - n + 2))
    return f"""
WITH w AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
  s AS (SELECT *, string_split(phrase, ' ') AS t FROM f WHERE k > 1),
  c AS (SELECT s.lang, s.phrase, s.a, n, l.a AS l, r.a AS r, c, (1000::HUGEINT * s.a * n) // (l.a::HUGEINT * r.a) AS score FROM ({cuts}) s
    JOIN totals USING (lang) JOIN f l ON l.lang = s.lang AND l.phrase = x JOIN f r ON r.lang = s.lang AND r.phrase = y),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
  i AS (SELECT lang, phrase, max(a) AS within FROM ({spans}) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN i USING (lang, phrase) WHERE within IS NULL OR 100 * within < {SHARE} * a QUALIFY rank <= {FIRST}
"""


SQL = _sql()
