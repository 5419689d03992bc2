"""Text cleansing as ordered chains of regular-expression replacements, folded into one Column expression.

Java's `\\s`, `\\d` and `\\w` are ASCII-only by default, so every pattern is prefixed with `(?U)`; white space such as
U+3000 and U+00A0 then collapses too. The order within a chain is part of its meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleansing rules, in the order in which they apply.
EMAIL = r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
SPACES = r"\s+"
NEWS = (
    EMAIL,
    r"\([^\)]+=\s*연합뉴스\)\s*[^=]+ =",
    r"\[이데일리\s+[^\]]+\s+기자\]",
    r"\([^=]+=연합인포맥스\)\s*[^=]+ =",
    r"\[[^\[\]]*(연합뉴스|자료사진|AFP|재판매|DB금지|사진|표|그래프)[^\[\]]*\]",
    r"\(\d{6}\)|\[\s*\d{6}\s*\]",
    r"[▲△▶▼▽◆◇=ㆍ/·;:!?'\"~&]",
    r"function\([^)]*\)\s*\{[^}]*\}",
    r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+",
    r"\([^)]*제공[^)]*\)|\([^)]*사진[^)]*\)",
)
STOCK_CODE = r"\(\d{6}\)"
RELATED = r"▶\s*관련기사\s*◀"
RELATED_PLAIN = r"▶ 관련기사 ◀"
POINTER = r"☞[^☞]*"
LIST_ITEM = r"\d+\.\s[^<]*"
SUMMARY = r"<간추린 소식>[^-]*"
PHOTO = r"사진|표"
MARKS_NEWS = r"[▲△▶▼▽◆◇=ㆍ/·;:!?'\"‘’“”~&]"
MARKS_EDAILY = r"[▲△▶▼▽◆◇=ㆍ/·.,;:!?'\"‘’“”~&]"
MARKS_MINUTES = r"[▲△▶▼▽◆◇=ㆍ/·.,;:!?'\"~∼&()→%․\[\]\-–]"
MARKS_MINUTES_LEGACY = r"[▲△▶▼▽◆◇=ㆍ/·.,;:!?'\"‘’“”~∼&()→%․\[\]\-–]"
MARKS_COMBINED = r"[▲△▶▼▽◆◇=ㆍ/·.,;:!?'\"‘’“”~∼&()→%․\[\]\-–<>]"
JAMO = r"([ㄱ-ㅎㅏ-ㅣ]+)"

#: name -> (pattern, replacement) pairs, and whether white space is collapsed and trimmed at the end.
CHAINS: dict[str, tuple[tuple[tuple[str, str], ...], bool]] = {
    "news": (tuple((p, " ") for p in NEWS), True),
    "minutes": (((STOCK_CODE, " "), (RELATED, " "), (POINTER, " "), (r"(?m)^\d+\.\s+", ""), (SUMMARY, " "), (MARKS_MINUTES, " "), (PHOTO, " ")), True),
    "bond": (((r"<[^>]*>", " "), (EMAIL, " "), (JAMO, " "), (r"\d+\.\d+", " "), (r"\d+", " "), (r"[^a-zA-Z0-9ㄱ-ㅣ가-힣\s]", " ")), True),
    "legacy_edaily": (tuple((p, "") for p in (STOCK_CODE, RELATED_PLAIN, POINTER, LIST_ITEM, SUMMARY, MARKS_EDAILY, PHOTO)), True),
    "legacy_minutes": (tuple((p, "") for p in (STOCK_CODE, RELATED_PLAIN, POINTER, LIST_ITEM, SUMMARY, MARKS_MINUTES_LEGACY, PHOTO)), True),
    "legacy_yonhap": (tuple((p, "") for p in (EMAIL, NEWS[1], r"\[[^\[\]]*(연합뉴스|자료사진|AFP|재판매|DB금지)[^\[\]]*\]", r"\\(\\d{6}\\)", r"\[\s*\d{6}\s*\]", MARKS_NEWS)), False),
    "legacy_bond": (((r"<.*?>", ""), (EMAIL, ""), (JAMO, ""), (r"[^a-zA-Z0-9ㄱ-ㅣ가-힣]", " "), (SPACES, " "), (r"\d+\.\d+", ""), (r"\d+", "")), False),
    "combined_news": (tuple((p, "") for p in (STOCK_CODE, RELATED_PLAIN, POINTER, LIST_ITEM, SUMMARY, MARKS_COMBINED, PHOTO)), True),
}
BRACKETS = r"\[.*?\]"


def collapse(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def clean(text: Column, chain: str) -> Column:
    """Null and empty texts become the empty text."""
    rules, tidy = CHAINS[chain]
    out = reduce(lambda c, r: F.regexp_replace(c, "(?U)" + r[0], r[1]), rules, F.coalesce(text, F.lit("")))
    return collapse(out) if tidy else out


def drop_brackets(text: Column) -> Column:
    return F.regexp_replace(text, BRACKETS, "")


def blank_to_null(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"(?U)^\s*$")), F.lit(None).cast("string")).otherwise(text)


def keep_hangul(text: Column) -> Column:
    """The runs of Hangul syllables, joined by blanks."""
    return F.array_join(F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0)), " ")


def pdf_text(text: Column, limit: int = 50_000) -> Column:
    """Collapsed white space, cut to the limit."""
    return F.substring(collapse(text), 1, limit)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/*?:"<>|]', "")


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def absolute(url: Column, base: str) -> Column:
    """Links without a host get the base's."""
    root = base.rstrip("/")
    scheme = root.split("://")[0]
    return F.when(F.regexp_like(url, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*://")), url).when(url.startswith("//"), F.concat(F.lit(scheme + ":"), url)).otherwise(F.concat(F.lit(root + "/"), F.regexp_replace(url, "^/+", "")))
