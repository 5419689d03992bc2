"""A morphological analyser: the cheapest path through the lattice of a word, from a dictionary that is a table.

The dictionary has rows of surface, tag and cost; a second table may give costs for a tag that follows another one, where
the empty tag is the word's edge. All costs are whole numbers. Every occurrence of a surface in a word is an edge of its
lattice, found by an Aho-Corasick automaton over the dictionary's trie in one pass; every single character is one more,
of a tag for its class and a cost of its own, so each word has a path. Viterbi's recursion keeps for each place and tag
the best way there. At the end neighbouring unknown characters of one tag become one token.

Of equally cheap paths the one of fewer tokens is taken, then, from the last token to the first, the smaller tag and the
earlier begin: the result depends on nothing but the tables.

Words are what white space separates, so analyses don't depend on neighbours, and a Python worker analyses a word that it
meets again only once (CACHED words are kept). Texts go through Arrow in batches. The dictionary is broadcast; LARGEST
rows are allowed, which is checked. Texts are analysed in lower case unless told otherwise.

Edge cases: a null text has no tokens; empty surfaces and rows with nulls are left out; of rows that repeat a surface and
tag the cheapest counts; a word of more than LONGEST characters is cut into pieces of that length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Tokenizer

# The tags of unknown Hangul, other letters, digits and anything else.
UNKNOWN = {"hangul": "NNG", "letter": "SL", "digit": "SN", "other": "SY"}
#: The cost of an unknown character, the most rows of a dictionary, words that a worker remembers, and their length.
COST, LARGEST, CACHED, LONGEST = 10_000, 2_000_000, 200_000, 1_000

TOKENS = "array<struct<token: string, pos: string>>"


@lru_cache(4096)
def kind_of(character: str) -> str:
    if "가" <= character <= "힣":
        return "hangul"
    return "letter" if character.isalpha() else "digit" if character.isdigit() else "other"


@dataclass
class Analyser:
    """One word after the other. entries: (surface, tag, cost); follows: (tag, next tag) -> cost."""

    entries: Iterable[tuple[str, str, int]]
    follows: dict[tuple[str, str], int] = field(default_factory=dict)
    unknown: int = COST
    seen: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        by_surface: dict[str, dict[str, int]] = {}
        for surface, tag, cost in self.entries:
            own = by_surface.setdefault(surface, {})
            own[tag] = min(cost, own.get(tag, cost))
        self.automaton = ahocorasick.Automaton()
        for surface, own in by_surface.items():
            self.automaton.add_word(surface, (len(surface), tuple(own.items())))
        if by_surface:
            self.automaton.make_automaton()
        self.entries = ()

    def edges(self, word: str) -> list[list[tuple[int, str, int, bool]]]:
        """For each place the edges that end there: begin, tag, cost, whether it is in the dictionary."""
        out = [[] for _ in range(len(word) + 1)]
        if len(self.automaton):
            for last, (length, own) in self.automaton.iter(word):
                out[last + 1] += [(last + 1 - length, tag, cost, True) for tag, cost in own]
        for i, c in enumerate(word):
            out[i + 1].append((i, UNKNOWN[kind_of(c)], self.unknown, False))
        return out

    def path(self, word: str) -> list[tuple[str, str]]:
        """Tokens and tags of the cheapest path."""
        # for each place, by tag of the token that ends there: cost, tokens, begin, tag before, known
        best: list[dict[str, tuple]] = [{"": (0, 0, -1, "", True)}]
        for own in self.edges(word)[1:]:
            here: dict[str, tuple] = {}
            for begin, tag, cost, known in own:
                for before, way in best[begin].items():
                    new = (way[0] + cost + self.follows.get((before, tag), 0), way[1] + 1, begin, before, known)
                    if tag not in here or new[:4] < here[tag][:4] or new[:4] == here[tag][:4] and known:
                        here[tag] = new
            best.append(here)
        end = len(word)
        tag = min(best[end], key=lambda t: (best[end][t][0] + self.follows.get((t, ""), 0), best[end][t][1], t))
        out = []
        while end:
            _, _, begin, before, known = best[end][tag]
            out.append((begin, end, tag, known))
            end, tag = begin, before
        merged: list[list] = []
        for begin, end, tag, known in reversed(out):
            if merged and not known and not merged[-1][3] and merged[-1][2] == tag:
                merged[-1][1] = end
            else:
                merged.append([begin, end, tag, known])
        return [(word[b:e], t) for b, e, t, _ in merged]

    def plain_path(self, word: str) -> list[tuple[str, str]]:
        """The same without costs between tags: one best way to each place."""
        ends: dict[int, list] = {}
        if len(self.automaton):
            for last, (length, own) in self.automaton.iter(word):
                ends.setdefault(last + 1, []).append((last + 1 - length, own))
        # cost, tokens, tag, begin, unknown
        best: list[tuple] = [(0, 0, "", -1, False)]
        for i, c in enumerate(word):
            before = best[i]
            way = (before[0] + self.unknown, before[1] + 1, UNKNOWN[kind_of(c)], i, True)
            for begin, own in ends.get(i + 1, ()):
                before = best[begin]
                for tag, cost in own:
                    new = (before[0] + cost, before[1] + 1, tag, begin, False)
                    if new < way:
                        way = new
            best.append(way)
        out: list[tuple[str, str]] = []
        end, joins = len(word), False
        while end:
            _, _, tag, begin, unknown = best[end]
            if joins and unknown and out[-1][1] == tag:
                out[-1] = (word[begin:end] + out[-1][0], tag)
            else:
                out.append((word[begin:end], tag))
            end, joins = begin, unknown
        return out[::-1]

    def word(self, word: str) -> list[tuple[str, str]]:
        """Analyses a word, and remembers it."""
        path = self.path if self.follows else self.plain_path
        found = path(word) if len(word) <= LONGEST else [x for at in range(0, len(word), LONGEST) for x in path(word[at : at + LONGEST])]
        if len(self.seen) >= CACHED:
            self.seen.clear()
        self.seen[word] = found
        return found

    def text(self, text: str) -> list[tuple[str, str]]:
        seen = self.seen
        return [x for w in text.split() for x in (seen.get(w) or self.word(w))]


def _rows(table: DataFrame, names: list[str]) -> list[tuple]:
    """The rows of a table of checked size."""
    own = table.select(*[F.col(c) for c in names]).na.drop().distinct()
    rows = own.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a dictionary of more than {LARGEST:,} rows isn't broadcast")
    return [tuple(r) for r in rows]


#: The analyser that a worker has built last.
_built: dict[str, Analyser] = {}


def tokenizer(dictionary: DataFrame, follows: DataFrame | None = None, unknown: int = COST, lower: bool = True) -> Tokenizer:
    """A tokenizer of columns. dictionary: surface, tag, cost; follows: tag, next_tag, cost."""
    spark = dictionary.sparkSession
    # texts can be very long, and an analysis is several times as large as its text
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    own = dictionary.select(F.lower("surface").alias("surface") if lower else "surface", "tag", F.col("cost").cast("long").alias("cost")).filter("surface <> ''")
    entries = sorted(_rows(own, ["surface", "tag", "cost"]))
    pairs = {(a, b): c for a, b, c in sorted(_rows(follows.withColumn("cost", F.col("cost").cast("long")), ["tag", "next_tag", "cost"]), reverse=True)} if follows is not None else {}
    shared = spark.sparkContext.broadcast((entries, pairs, unknown))
    number = uuid.uuid4().hex

    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if number not in _built:
            _built.clear()
            _built[number] = Analyser(*shared.value)
        one = _built[number]
        for batch in batches:
            found = [one.text(t) if t else [] for t in batch.to_pylist()]
            flat = list(zip(*chain.from_iterable(found), strict=True)) or [(), ()]
            structs = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in flat], ["token", "pos"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)

    def apply(text: Column) -> Column:
        return run(F.lower(text) if lower else text)

    return apply
