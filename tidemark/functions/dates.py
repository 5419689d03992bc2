"""Dates from text. Nothing raises on bad input: what doesn't parse is null. No expression looks at the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The patterns of the forms in which the sources write dates.
ISO, DOTS = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})\.(\d{2})\.(\d{2})"
KOREAN, ANY_MARK, DIGITS = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일", r"(\d{4})[-.](\d{1,2})[-.](\d{1,2})", r"(\d{4})(\d{2})(\d{2})"
TWO_DIGITS, ENDED_DOTS, DAYS_AGO = r"(\d{2})\.(\d{2})\.(\d{2})", r"(\d{4})\.(\d{2})\.(\d{2})\.", r"(\d+)일 전"
TITLE, PATH, AGENCY = r"(\d{4})[년.\-/](\d{1,2})[월.\-/](\d{1,2})", r"/(\d{4})/(\d{1,2})/(\d{1,2})/", r"AKR(\d{4})(\d{2})(\d{2})"
MONTH_DAY = r"(\d{1,2})월\s*(\d{1,2})일"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _match(text: Column, pattern: str, prefix: str = "") -> Column:
    """The date of the first match of three groups."""
    year, month, day = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", _ymd(F.concat(F.lit(prefix), year), month, day))


def dotted(text: Column) -> Column:
    """`2024.8.29`, padded or not."""
    return F.try_to_date(text, "yyyy.M.d")


def dashed(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-M-d")


def lenient(text: Column) -> Column:
    """The first of the usual forms that parses."""
    day = F.regexp_extract(F.trim(text), r"^(\d{4}[-./]?\d{1,2}[-./]?\d{1,2})(?:[ T].*)?$", 1)
    day = F.when(day != "", day)
    return F.coalesce(*[F.try_to_date(day, f) for f in ("yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "yyyyMMdd")])


def any_form(text: Column) -> Column:
    """`Y-M-D` or `Y.M.D`, else `Y년 M월 D일`, else eight digits; the first form that occurs decides."""
    return F.coalesce(*[_match(text, p) for p in (ANY_MARK, KOREAN, DIGITS)])


def short_form(text: Column) -> Column:
    """Padded `Y-M-D`, `Y.M.D`, the Korean form, or a two-digit year of this century."""
    return F.coalesce(*[_match(text, p) for p in (ISO, DOTS, KOREAN)], _match(text, TWO_DIGITS, "20"))


def relative(text: Column, as_of: Column) -> Column:
    """Today, hours or minutes ago, yesterday, days ago, as seen on `as_of`; else a written date."""
    days = F.regexp_extract(text, DAYS_AGO, 1)
    today = text.contains("오늘") | text.contains("시간 전") | text.contains("분 전")
    written = F.coalesce(_match(text, ENDED_DOTS), _match(text, ISO))
    return F.when(today, as_of).when(text.contains("어제"), F.date_sub(as_of, 1)).when(days != "", F.date_sub(as_of, F.expr("0") + days.try_cast("int"))).otherwise(written)


def from_title(text: Column) -> Column:
    """One separator character only, so `2024년 8월 29일` gives null."""
    return _match(text, TITLE)


def from_url(url: Column) -> Column:
    """`/2024/8/29/` or an agency number of eight digits."""
    return F.coalesce(_match(url, PATH), _match(url, AGENCY))


def month_day(year: Column, text: Column) -> Column:
    """A year and `N월 N일`."""
    month, day = F.regexp_extract(text, MONTH_DAY, 1), F.regexp_extract(text, MONTH_DAY, 2)
    return F.when(month != "", _ymd(year.cast("string"), month, day))


def plus_months(day: Column, months: int) -> Column:
    """The end of a month is clipped: 2023-01-31 + 1 is 2023-02-28."""
    return F.add_months(day, months)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def compact(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def with_dots(day: Column) -> Column:
    return F.date_format(day, "yyyy.MM.dd")


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month").cast("date"), F.last_day(day)


def target(as_of: Column, days: int = 60) -> Column:
    """The day that a prediction is for."""
    return F.date_add(as_of, days)
