"""Text structure: sentences, tokens, n-grams, sections, themes, similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleansing import collapse

# Limits, parts of speech, keyword lists and section patterns.
MIN_SENTENCE = 10
ENGLISH_SHARE = 0.7
POS = ("NNG", "VA", "MAG", "VV", "VCN")
FINANCE = "금리|인상|인하|긴축|완화|통화|정책|경제|성장|물가|인플레|채권|주식|달러|원화|수출|수입|무역"
THEMES = {
    "정책/금리": "정책|기준|금리|인상|인하|동결|긴축|완화|통화|위원|총재|회의",
    "물가/성장": "물가|인플레|성장|경제|GDP|수출|수입|소비|투자|고용|실업",
    "시장/자금": "시장|자금|유동성|채권|주식|환율|달러|원화|은행|대출|예금",
}
OTHER = "기타"
DISCUSSION = (r"위원\s*토의\s*내용(.*?)심의\s*결과", r"토의\s*내용(.*?)결정\s*사항", r"위원\s*토의(.*?)의결\s*사항")
DECISION = (r"심의\s*결과(.*?)$", r"결정\s*사항(.*?)$", r"의결\s*사항(.*?)$")
DISCUSSION_PAIRS = (r"위원\s*토의\s*내용(.*?)심의\s*결과", r"토의\s*내용(.*?)심의\s*결과", r"위원\s*토의(.*?)결정\s*사항")
DECISION_PAIRS = (r"심의\s*결과(.*)", r"심의\s*결과(.*)", r"결정\s*사항(.*)")
DISCUSSION_OLD, DECISION_OLD = (r"위원 토의내용(.*?)심의결과",), (r"심의결과(.*)",)
CONTENT_LIMIT, DISCUSSION_LIMIT, DECISION_LIMIT = 10_000, 5_000, 2_000


def sentences(text: Column) -> Column:
    """An array of sentences of MIN_SENTENCE characters or more; the whole text if none is so long.

    A text is cut at `.`, `!` or `?` before a Hangul syllable or a capital; the mark is consumed. A dot between two
    capitals is masked first, so `U.S` holds together.
    """
    flat = collapse(text)
    masked = F.regexp_replace(flat, r"([A-Z])\.([A-Z])", "\u0001$1\u0002$2")
    parts = F.split(masked, r"(?U)[.!?]\s*(?=[가-힣A-Z])", -1)
    parts = F.transform(parts, lambda s: F.trim(F.translate(s, "\u0002\u0001", ".")))
    parts = F.filter(parts, lambda s: F.length(s) >= MIN_SENTENCE)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(flat)).otherwise(parts)


def is_english(text: Column) -> Column:
    """Whether more than ENGLISH_SHARE of the characters are ASCII; false for an empty text."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.coalesce(F.when(F.length(text) > 0, ascii_ / F.length(text) > ENGLISH_SHARE), F.lit(False))


class Tokenizer(Protocol):
    """Turns a text column into ARRAY<STRUCT<token, pos>>."""

    def __call__(self, text: Column) -> Column: ...


def whitespace_tokens(text: Column) -> Column:
    """The default tokenizer: lower-cased words, each counted as a common noun. Pure expressions."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda t: t != "")
    return F.transform(words, lambda t: F.struct(t.alias("token"), F.lit("NNG").alias("pos")))


def rule_tokens(rules: list[tuple[str, str]], other: str = "NNG") -> Tokenizer:
    """A tokenizer without a morphological analyser: words get the part of speech of the first pattern that they match."""

    def run(text: Column) -> Column:
        def pos(word: Column) -> Column:
            out = None
            for pattern, name in rules:
                hit = F.regexp_like(word, F.lit(pattern))
                out = F.when(hit, name) if out is None else out.when(hit, name)
            return F.lit(other) if out is None else out.otherwise(other)

        return F.transform(whitespace_tokens(text), lambda t: F.struct(t["token"].alias("token"), pos(t["token"]).alias("pos")))

    return run


def morphs(text: Column, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """The tokens of all parts of speech."""
    return F.transform(tokenizer(text), lambda t: t["token"])


def morphs_joined(text: Column, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """The tokens joined by blanks, as they are given to a tagger a second time."""
    return F.array_join(morphs(text, tokenizer), " ")


def tagger(make: Callable[[], Callable[[str], list[tuple[str, str]]]], failures: Accumulator) -> Tokenizer:
    """A tokenizer from a morphological tagger; `make` runs once per Python worker.

    A text on which it fails has no tokens, and is counted in `failures`.
    """
    kind = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("pos", T.StringType())]))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tag = make()

        def one(text):
            try:
                return [{"token": t, "pos": p} for t, p in tag(text)] if text else []
            except Exception:
                failures.add(1)
                return []

        for batch in batches:
            yield batch.map(one)

    return run


def content_words(text: Column, tokenizer: Tokenizer = whitespace_tokens, pos=POS, skip_english: bool = False) -> Column:
    """The tokens of the given parts of speech."""
    kept = F.filter(tokenizer(text), lambda t: t["pos"].isin(*pos))
    words = F.transform(kept, lambda t: t["token"])
    return F.when(is_english(text), F.array().cast("array<string>")).otherwise(words) if skip_english else words


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once; inside lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def ngrams(tokens: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return _bound(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))).otherwise(none))


def _no_equal_neighbours(words: Column) -> Column:
    n = F.size(words)
    return ~F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get(words, i) == F.get(words, i - 1)))


def valid_ngram(ngram: Column) -> Column:
    """False for equal neighbours, and, beyond two words, where one word is more than half of them."""

    def check(words: Column) -> Column:
        n = F.size(words)
        most = F.array_max(F.transform(words, lambda w: F.size(F.filter(words, lambda v: v == w))))
        return _no_equal_neighbours(words) & ((n <= 2) | (most * 2 <= n))

    return _bound(F.split(ngram, " "), check)


def gram_list(words: list[Column], low: int = 1) -> list[Column]:
    """The valid n-grams that begin with the first of these words, null where there is none.

    Validity is decided on the words, with one comparison for each pair of places, before any string is built.
    """
    grams = []
    for n in range(low, len(words) + 1):
        w = words[:n]
        ok = w[n - 1].isNotNull()
        for k in range(n - 1):
            ok = ok & (w[k] != w[k + 1])
        if n > 2:
            counts = [sum(((w[k] == w[j]).cast("int") for j in range(n) if j != k), F.lit(1)) for k in range(n)]
            ok = ok & (F.greatest(*counts) * 2 <= n)
        grams.append(F.when(ok, F.concat_ws(" ", *w)))
    return grams


def all_ngrams(tokens: Column, low: int = 1, high: int = 5) -> Column:
    """The valid n-grams of all lengths, repeats included, in the order of their first words."""
    none = F.array().cast("array<string>")
    at = lambda t, i: F.array_compact(F.array(*gram_list([F.get(t, i + k) for k in range(high)], low)))
    return _bound(tokens, lambda t: F.when(F.size(t) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: at(t, i)))).otherwise(none))


def presentable_ngram(ngram: Column) -> Column:
    """For charts: more than one character and no equal neighbours."""
    return (F.length(ngram) > 1) & _bound(F.split(ngram, " "), _no_equal_neighbours)


def title_and_body(text: Column) -> tuple[Column, Column]:
    """The first line, and the rest."""
    lines = F.split(text, "\n", -1)
    return F.get(lines, 0), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")


def _section(text: Column, patterns, limit: int | None, spaces: str) -> Column:
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, "(?s)" + p.replace("(.*?)$", r"(.*?)\z"), 1), r"(?U)^\s+|\s+$", "")), F.lit("")) for p in patterns])
    if spaces == "collapse":
        found = F.regexp_replace(found, r"(?U)\s+", " ")
    elif spaces == "fuse":
        found = F.regexp_replace(found, "\n", "")
    return F.substring(found, 1, limit) if limit else found


def sections(text: Column, generation: str = "current") -> tuple[Column, Column, Column]:
    """Content, discussion and decision of minutes; null where no pattern fits.

    Three generations differ: `current` trims, `paired` collapses white space, `old` deletes line ends and has no cap.
    """
    if generation == "current":
        return F.substring(text, 1, CONTENT_LIMIT), _section(text, DISCUSSION, DISCUSSION_LIMIT, "trim"), _section(text, DECISION, DECISION_LIMIT, "trim")
    if generation == "paired":
        return text, _section(text, DISCUSSION_PAIRS, DISCUSSION_LIMIT, "collapse"), _section(text, DECISION_PAIRS, DECISION_LIMIT, "collapse")
    return text, _section(text, DISCUSSION_OLD, None, "fuse"), _section(text, DECISION_OLD, None, "fuse")


def themes(ngram: Column, keywords: dict[str, str] | None = None, other: str = OTHER) -> Column:
    """All themes of which a keyword occurs, else the other one."""
    found = F.array_compact(F.array(*[F.when(F.regexp_like(ngram, F.lit(k)), F.lit(name)) for name, k in (keywords or THEMES).items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)


def mentions(text: Column, keywords: str = FINANCE) -> Column:
    """Whether one of the alternatives occurs; false for null."""
    return F.coalesce(F.regexp_like(text, F.lit(keywords)), F.lit(False))


def contains_json(column: Column, path: str, value) -> Column:
    """Whether a JSON text has this value at the path; false for text that isn't JSON."""
    kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
    return F.coalesce(F.try_variant_get(F.try_parse_json(column), path, kind) == F.lit(value), F.lit(False))


def _item_holds(needle) -> Callable[[Column], Column]:
    return lambda item: _holds(item, needle, False)


def _named(key: str) -> Callable[[Column, Column], Column]:
    return lambda name, _: name == F.lit(key)


def _holds(value: Column, needle, top: bool) -> Column:
    """Containment of a needle in a VARIANT."""
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<variant>")
    if isinstance(needle, dict):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        out = fields.isNotNull()
        for key, part in needle.items():
            out = out & F.coalesce(_holds(F.get(F.map_values(F.map_filter(fields, _named(key))), 0), part, False), F.lit(False))
    elif isinstance(needle, list):
        out = items.isNotNull()
        for part in needle:
            out = out & F.coalesce(F.exists(items, _item_holds(part)), F.lit(False))
    else:
        as_kind = lambda k: F.try_variant_get(value, "$", k) == F.lit(needle)
        if needle is None:
            out = F.is_variant_null(value)
        elif isinstance(needle, bool):
            out = (kind == "BOOLEAN") & as_kind("boolean")
        elif isinstance(needle, str):
            out = (kind == "STRING") & as_kind("string")
        else:
            out = F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (F.try_variant_get(value, "$", "double") == F.lit(float(needle)))
            if isinstance(needle, int):  # doubles don't tell large whole numbers apart
                out = out & ((kind != "BIGINT") | as_kind("bigint"))
        if top:  # a list holds a lone value that is one of its items
            out = out | F.coalesce(F.exists(items, _item_holds(needle)), F.lit(False))
    return F.coalesce(out, F.lit(False))


def holds_json(column: Column, needle) -> Column:
    """Whether a JSON text contains a needle (objects, lists, strings, numbers, booleans, None) at any depth that it describes.

    An object contains another one if it has all its keys, and each value contains the other's. A list contains another
    one if each of the other's items is contained in some item, in any order and number; a list as a whole also contains
    a single value that is one of its items. Values are equal in kind and value, numbers by value. Null, and text that
    isn't JSON, contain nothing.
    """
    return _holds(F.try_parse_json(column), needle, True)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased words, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+", -1), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets; 0 where both are empty."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def paragraphs(html: Column) -> Column:
    """The texts of `<p>` elements without those that begin with a note mark, joined by line ends."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    texts = F.transform(found, lambda p: collapse(F.regexp_replace(p, r"<[^>]*>", "")))
    return F.array_join(F.filter(texts, lambda t: (t != "") & ~t.startswith("※")), "\n")


def jsonp(text: Column) -> Column:
    """The JSON inside a callback's parentheses; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)^[^({\[]*\((.*)\)\s*;?\s*$", 1), F.lit(""))


def js_object(text: Column) -> Column:
    """A script's object literal as JSON: keys and single-quoted strings get double quotes."""
    return F.regexp_replace(F.regexp_replace(text, r"'([^']*)'", '"$1"'), r'([{,]\s*)([A-Za-z_]\w*)\s*:', '$1"$2":')
