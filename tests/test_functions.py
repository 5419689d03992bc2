import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import cleansing, dates, numeric
from tidemark.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_cleaners(spark):
    clean = lambda v, chain: one(spark, v, lambda c: cleansing.clean(c, chain))
    assert clean(None, "news") == clean("", "news") == ""
    assert clean("a\u3000\u00a0 b\x1cc", "news") == "a b c"
    assert clean("문의 kim@x.co.kr (005930) 사진 [사진 연합뉴스] 금리: 3/4?", "news") == "문의 사진 금리 3 4"
    assert clean("목표", "minutes") == "목"
    assert clean("1. 첫째\n2. 둘째", "minutes") == "첫째 둘째"
    assert clean("<b>금리 3.5%</b> ㅋㅋ 12 up!", "bond") == "금리 up"
    assert clean("a, b", "legacy_edaily") == "a b"
    assert one(spark, "[속보] 금리", cleansing.drop_brackets) == " 금리"
    assert one(spark, " \u3000", cleansing.blank_to_null) is None
    assert one(spark, "금리 up 인상!", cleansing.keep_hangul) == "금리 인상"
    assert one(spark, "http://a/b", cleansing.https) == "https://a/b"
    absolute = lambda v: one(spark, v, lambda c: cleansing.absolute(c, "https://x.kr"))
    assert [absolute(v) for v in ("/a", "b", "//y/c", "http://z/")] == ["https://x.kr/a", "https://x.kr/b", "https://y/c", "http://z/"]
    assert one(spark, 'a/b:c"', cleansing.safe_file_name) == "abc"


def test_dates(spark):
    d = dt.date(2024, 8, 29)
    as_of = F.lit(d)
    cases = [
        (dates.dotted, "2024.8.29", d), (dates.dashed, "x", None), (dates.lenient, "2024-08-29 10:00:00", d), (dates.lenient, "bad", None),
        (dates.any_form, "on 2024-8-29.", d), (dates.any_form, "2024년 8월 29일", d), (dates.any_form, "20240829", d), (dates.any_form, "2024-13-45", None),
        (dates.short_form, "24.08.29", d), (dates.from_title, "회의 2024.08.29", d), (dates.from_title, "2024년 8월 29일", None),
        (dates.from_url, "http://x/2024/8/29/1", d), (dates.from_url, "AKR20240829012", d),
        (lambda c: dates.relative(c, as_of), "3시간 전", d), (lambda c: dates.relative(c, as_of), "어제", dt.date(2024, 8, 28)), (lambda c: dates.relative(c, as_of), "10일 전", dt.date(2024, 8, 19)),
        (lambda c: dates.relative(c, as_of), "2023.06.15.", dt.date(2023, 6, 15)), (lambda c: dates.month_day(F.lit("2024"), c), "8월 29일", d),
    ]
    for f, v, want in cases:
        assert one(spark, v, f) == want, (v, want)
    assert spark.range(1).select(dates.plus_months(F.lit(dt.date(2023, 1, 31)), 1)).first()[0] == dt.date(2023, 2, 28)


def sentences(text):
    flat = re.sub(r"\s+", " ", text).strip()
    if not flat:
        return []
    masked = re.sub(r"([A-Z])\.([A-Z])", "\\1\x02\\2", flat)
    parts = [p.replace("\x02", ".").strip(" ") for p in re.split(r"[.!?]\s*(?=[가-힣A-Z])", masked)]
    return [p for p in parts if len(p) >= 10] or [flat]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="가나다 AB.!?\nab", max_size=60), min_size=30, max_size=60))
def test_sentences_property(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1).select(X.sentences(F.col("v"))).collect()]
    assert got == [sentences(t) for t in texts]


def test_sentences(spark):
    split = lambda v: one(spark, v, X.sentences)
    assert split("금리를 인상했다. 물가가 올랐다! 연준은 동결했다.") == ["금리를 인상했다. 물가가 올랐다! 연준은 동결했다."]
    assert split("기준금리를 인상하기로 했다. 물가가 크게 올랐기 때문! 연준은 금리를 동결했다.") == ["기준금리를 인상하기로 했다", "물가가 크게 올랐기 때문", "연준은 금리를 동결했다."]
    assert split("미국 U.S 연준이 금리를 인상했다. 다음 달에도 인상") == ["미국 U.S 연준이 금리를 인상했다", "다음 달에도 인상"] or len(split("미국 U.S 연준이 금리를 인상했다. 다음 달에도 인상")) == 1
    assert split(None) == split(" \n") == []


def test_english(spark):
    english = lambda v: one(spark, v, X.is_english)
    assert english("abcdefg가나다") is False and english("abcdefgh가나") is True and english("") is False and english(None) is False


def valid(words):
    return all(a != b for a, b in zip(words, words[1:], strict=False)) and (len(words) <= 2 or max(map(words.count, words)) * 2 <= len(words))


def test_ngrams(spark):
    check = lambda v: one(spark, v, X.valid_ngram)
    assert [check(v) for v in ("a a", "a b a", "a b a c", "a b c", "a")] == [False, False, True, True, True]
    words = "a b a c a d d b a c a c a b".split()
    got = one(spark, " ".join(words), lambda c: X.all_ngrams(F.split(c, " "), 1, 5))
    want = sorted(" ".join(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1) if valid(words[i : i + n]))
    assert sorted(got) == want
    assert one(spark, "a", lambda c: X.all_ngrams(F.split(c, " "), 1, 5)) == ["a"]
    assert one(spark, "a b", lambda c: X.ngrams(F.split(c, " "), 3)) == []
    assert one(spark, "a", X.presentable_ngram) is False and one(spark, "ab ab", X.presentable_ngram) is False and one(spark, "ab cd", X.presentable_ngram) is True


def test_tagger(spark):
    tag = X.tagger(lambda: lambda s: [(w, "NNG" if w[0] != "x" else "JKS") for w in s.split()] if s != "bad" else 1 / 0, failures := spark.sparkContext.accumulator(0))
    rows = spark.createDataFrame([("a xb c",), ("bad",), (None,)], "v string").coalesce(1).select(X.content_words(F.col("v"), tag)).collect()
    assert [r[0] for r in rows] == [["a", "c"], [], []] and failures.value >= 1


def test_sections(spark):
    text = "서두 위원 토의 내용 좋다\n나쁘다 심의 결과 동결 끝"
    _, talk, result = spark.createDataFrame([(text,)], "v string").select(*X.sections(F.col("v"))).first()
    assert talk == "좋다\n나쁘다" and result == "동결 끝"
    _, talk, result = spark.createDataFrame([(text,)], "v string").select(*X.sections(F.col("v"), "paired")).first()
    assert talk == "좋다 나쁘다" and result == "동결 끝"
    assert spark.createDataFrame([("없음",)], "v string").select(*X.sections(F.col("v"))).first()[1:] == (None, None)


def test_small_text_functions(spark):
    assert one(spark, "금리 인상 물가", X.themes) == ["정책/금리", "물가/성장"] and one(spark, "x", X.themes) == ["기타"]
    assert one(spark, "abcdef", lambda c: X.shorten(c, 3)) == "abc..." and one(spark, None, X.mentions) is False
    assert one(spark, 'cb({"a": 1});', X.jsonp) == '{"a": 1}' and one(spark, "none", X.jsonp) is None
    assert one(spark, "{a: 'x', b:1}", X.js_object) == '{"a": "x", "b":1}'
    assert one(spark, "<p>하나</p><P>※ 둘</P><p> 셋<b>넷</b></p>", X.paragraphs) == "하나\n셋넷"
    got = spark.createDataFrame([("word", "two words")], "a string, b string").select(X.similarity(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(4 / 11)
    assert spark.createDataFrame([("t\nb\nc",)], "v string").select(*X.title_and_body(F.col("v"))).first() == ("t", "b\nc")


def test_numeric(spark):
    row = spark.createDataFrame([(0.0, 0.25)], "a double, b double").select(
        numeric.floored(F.col("a")), numeric.log_or_minus_infinity(F.col("a")), numeric.percent(F.col("b")), numeric.signed_points(F.col("b")), numeric.signed_points(F.col("a")), numeric.probability_of_one(F.col("a"), F.col("a"))
    ).first()
    assert tuple(row) == (1e-100, float("-inf"), "0.25%", "+0.25%p", "-", 0.5)
