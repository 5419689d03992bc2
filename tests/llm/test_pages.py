import base64
import gzip
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import html_extract, language, url_filter, warc

PAGES = "page_id long, url string, html string, text string, size long, digest string, host string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "x", "x", 7) for r in rows], PAGES)


def test_extraction_rules():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a> motto of the site</header>
    <div class="cookie-notice">We use cookies and the like for you and for us all.</div>
    <nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <article><header><h1>Head&amp;line</h1></header><p>Short.<p>Caf&eacute; <b>bold
    </b>text&nbsp;here<br>next &lt;p&gt;</p><div class="ad">Buy the best of the best in the shop of the town</div><ul><li>item</li></ul>
    <script>var x = "</p><p>no";</script><form><label>Name</label><input></form>
    <section class="comments"><p>I think that this is the best of all articles.</p></section></article>
    <aside><p>Other stories of the day</p></aside><footer>&copy; all</footer></body></html>"""
    assert html_extract.main_text(page) == "Head&line\nShort.\nCafé bold text here next <p>\nitem"
    plain = "<body><div class=menu><a href=x>a</a></div><p>Short start</p>" + "<p>The story of the day is that it was on and on.</p>" * 3 + "<p>end</p><div><a href=y>more</a> <a href=z>links</a></div></body>"
    assert html_extract.main_text(plain).split("\n") == ["Short start", *["The story of the day is that it was on and on."] * 3, "end"]
    for odd in ("", None, "<", "<p", "</p></div>", "<!-- x", "<script>x", "<p>a < b</p>", "<a href='>'>x", "\x00"):
        html_extract.main_text(odd)


PARAGRAPH = "It was in the spring of that year that the people of the town saw the first of the ships, and they were not at all sure what to make of it, for none of them had been told that it would come to this place. " * 2
ARTICLE = [f"{k} {PARAGRAPH}".strip() for k in range(3)]
BODY = "<h2>The ships</h2>" + "".join(f"<p>{t}</p>" for t in ARTICLE)
MENU = "<div class=menu><ul>" + "".join(f"<li><a href=/{k}>Part {k}</a>" for k in range(9)) + "</ul></div>"


@pytest.mark.parametrize(
    "around",
    ['<div class="main with-sidebar">@</div>', '<div class="no-sidebar">@</div>', '<div class="post share-enabled">@</div>', '<div class="content comments-open">@</div>', "<form action=/x><input type=hidden>@</form>", '<div class="sidebar-page">@</div>', "<article>@</article>", "<main>@</main>", '<div id=widget><main class="x">@</main></div>', "<table><tr><td>@</td></tr></table>"],
)
@pytest.mark.parametrize(
    "more",
    ["", '<div class="ad">The best of all shops in the town is the one that you will find in the street</div>', '<div class=comments><p>' + "I think that this is the best of all that I have read in the days of my life and that it is so. " * 9 + "</p></div>", "<div hidden><p>" + PARAGRAPH + "</p></div>", '<p class="advert">Buy the best of the best in the shop of the town and be the one that has it</p>', '<footer><p>' + PARAGRAPH + "</p></footer>", "<form><label>Your name</label><input><p>Write to us and we will answer</p><button>Send</button></form>"],
)
def test_extraction_of_pages_without_marks(around, more):
    """What goes is listed in the pages themselves: the text must be the heading and the paragraphs."""
    page = "<html><head><title>t</title></head><body><header><h1>Site</h1></header>" + MENU + around.replace("@", BODY + "\0").replace("\0", more) + "<p>© 2020 The people of the town</p></body></html>"
    assert html_extract.main_text(page).split("\n") == ["The ships", *[t.strip() for t in ARTICLE]]


def test_extraction_second_pass():
    """Short blocks take the label of their neighbours, also inside an article."""
    links = "".join(f"<li><a href=/{k}>Story {k} of the day</a></li>" for k in range(5))
    page = f"<article><h1>Title</h1><p>Short.</p><p>{PARAGRAPH}</p><p>Also short.</p><p>{PARAGRAPH}</p><h3>More stories</h3><ul>{links}</ul><p>see all</p><ul>{links}</ul></article>"
    assert html_extract.main_text(page).split("\n") == ["Title", "Short.", PARAGRAPH.strip(), "Also short.", PARAGRAPH.strip()]
    wide = "<div>" + "".join(f"<p>{'本文は長い文章です' * 30}{k}</p>" for k in range(3)) + "<p>短い</p></div>"
    assert html_extract.main_text(wide).count("\n") == 3
    assert html_extract.main_text(f"<div><p>Well <span class=ad>Buy!</span><span hidden>secret</span> then</p><p>{PARAGRAPH}</p></div>").split("\n")[0] == "Well then"


@pytest.mark.parametrize("piece", ["<a ", "<option>", "<a href='", '<p class="', "<!-", "</", "<script", "<textarea>", "<b x='>\"", "<div><p>x"])
def test_extraction_is_linear(piece):
    import time

    start = time.time()
    html_extract.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 10


def test_extraction_query(spark, sf):
    """The brute form: everything inside the article element of these pages, cut at paragraphs and headings."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.query(spark, sf).collect():
        article = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_extraction_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>x y</p>"), (3, "u", "<article>" + "<p>word</p>" * 200_000 + "</article>")]
    got = html_extract.extract(frame(spark, rows)).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id in (1, 2)} == {0}
    assert max(r.n_chars for r in got) == 200_000 * 5 - 1
    assert html_extract.extract(frame(spark, [])).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "https://a.example.net/de/81", "x://b.net/de/", "y://notnet/de/", "z://é.org/es/ü?x", "http://a.org?b/es/", "q://h#f://g/en/"]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, None, None), (5, URLS[5], None), (5, URLS[5], None), (None, URLS[6], None)]
    got = url_filter.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == verdict if verdict else by[i].verdict in ("allow", "block")
    assert url_filter.judge(frame(spark, [])).count() == 0
    assert {r.verdict for r in url_filter.judge(frame(spark, [(1, "a://b/c", None)])).collect()} == {"allow"}


def test_url_model(spark):
    """The smoothed log ratio, by the formula; and addresses like the rejected ones are rejected."""
    r = random.Random(1)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    rules = (("good", "/", "allow"), ("bad", "/", "block"))
    rows = [(i, f"http://{word('abc')}.good/{word('abc')}" if i % 2 else f"http://{word('xyz')}.bad/{word('xyz')}", None) for i in range(200)]
    rows += [(1000 + i, f"http://{word('abc')}.new/", None) for i in range(20)] + [(2000 + i, f"http://{word('xyz')}.new/", None) for i in range(20)]
    got = {x.page_id: x for x in url_filter.judge(frame(spark, rows), rules).collect()}
    assert all(got[1000 + i].verdict == "allow" and got[2000 + i].verdict == "block" for i in range(20))

    def half(u):
        return int(hashlib.md5(u.removeprefix("http://").encode()).hexdigest()[0] >= "8")

    def mean_ratio(u, train):
        """By the formula: every context against the shorter one, by its occurrences and different followers."""
        counts = [{}, {}]
        for i, v, _ in train:
            s = "^^" + v.removeprefix("http://") + "$"
            for k in range(len(s) - 2):
                counts[1 - i % 2][s[k : k + 3]] = counts[1 - i % 2].get(s[k : k + 3], 0) + 1

        def p(w, c):
            n = lambda f: sum(v for g, v in c.items() if f(g))
            q = (n(lambda g: g[2] == w[2]) + 1) / (sum(c.values()) + url_filter.SYMBOLS)
            for context, cut in ((w[1], slice(1, 2)), (w[:2], slice(0, 2))):
                seen = n(lambda g: g[cut] == context)
                kinds = len({g[2] for g in c if g[cut] == context})
                if seen:
                    q = (n(lambda g: g[cut] == context and g[2] == w[2]) + kinds * q) / (seen + kinds)
            return q

        s = "^^" + u.removeprefix("http://") + "$"
        return np.mean([np.log(p(s[k : k + 3], counts[0]) / p(s[k : k + 3], counts[1])) for k in range(len(s) - 2)])

    for i in (200, 230):
        assert got[rows[i][0]].score == pytest.approx(mean_ratio(rows[i][1], rows[:200]))
    for i in (0, 7):
        others = [r for r in rows[:200] if half(r[1]) != half(rows[i][1])]
        assert got[i].other_score == pytest.approx(mean_ratio(rows[i][1], others))


def test_url_oracle(spark, sf):
    import duckdb

    from tidemark.llm import queries

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(c.sql(queries.oracle_sql()["op3_url_filter"]).fetchall(), key=key)
    assert sorted((tuple(r) for r in url_filter.query(spark, sf).collect()), key=key) == want


def test_url_query(spark, sf):
    got = url_filter.query(spark, sf).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = language.query(spark, sf).collect()
    pages = {r.page_id: re.search('lang="(..)"', r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    assert np.mean([r.text_lang == pages[r.page_id] for r in got]) > 0.95
    assert np.mean([r.lang == pages[r.page_id] for r in got]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the and of in to", "en"), (2, "der die das und", "de"), (3, None, "de"), (None, "x", "en"), (4, "y", None), (5, "the", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    rows = [(1, None, None), (2, "x://h.de/", "<html lang=de><p>the and of"), (3, "x://h.de/", "<p>und die das der und die</p>"), (3, "x://h.de/", "<p>und die das der und die</p>"), (None, "", "")]
    got = language.identify(frame(spark, rows), model).collect()
    assert len(got) == 5 and {r.lang for r in got if r.page_id == 3} == {"de"} and all(0 < r.confidence <= 1 for r in got)
    assert {r.text_lang for r in got if r.page_id in (1, None)} == {None}
    none = language.fit(docs.limit(0))
    assert {r.lang for r in language.identify(frame(spark, rows), none).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


WORDS = {"en": "the and of in to this that", "de": "der die das und ist ein"}


def brute_languages(rows, model):
    """Every page's posterior by the formulas, in plain loops."""
    names = model.languages
    facts = []
    for i, url, page in rows:
        text = html_extract.main_text(page)
        logs = model.log_likelihoods(*C.utf8(pa.array([text])))[0].astype(float)
        host = url.split("://", 1)[1].split("/")[0].lower()
        said = re.search(r'<html[^>]*\slang="([a-z]+)', page or "")
        e = np.exp(logs - logs.max())
        facts.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said[1] if said else "", logs, e / e.sum()))
    total, n = len(facts), len(names)
    prior = (sum(f[6] for f in facts) + 1) / (total + n)

    def likelihood(column, value):
        if value == "":
            return np.zeros(n)
        own = [f[6] for f in facts if f[column] == value]
        share = (len(own) + 1) / (total + 2)
        return np.log((sum(own) + language.SMOOTH * share) / (total * prior + language.SMOOTH))

    out = {}
    for f in facts:
        above = prior
        for column in (2, 1):
            others = [g[6] for g in facts if g[column] == f[column] and g is not f]
            above = (sum(others, np.zeros(n)) + language.SMOOTH * above) / (len(others) + language.SMOOTH)
        x = f[5] + np.log(above) + likelihood(4, f[4]) + likelihood(3, f[3])
        e = np.exp(x - x.max())
        out[f[0]] = (names[int(x.argmax())], e.max() / e.sum())
    return out


def language_pages():
    r = random.Random(3)
    rows = []
    for i in range(90):
        own = r.choice(["en", "de"])
        text = " ".join(r.choice(WORDS[own].split()) for _ in range(r.choice([0, 2, 30])))
        said = r.choice(["", ' lang="en"', ' lang="de"', ' data-lang="en" lang="de"'])
        rows.append((i, f"x://{r.choice('ab')}{r.randrange(3)}.{r.choice(['site', 'page'])}.{r.choice(['com', 'de'])}/", f"<html{said}><article><p>{text}</p></article>"))
    return rows


def test_language_brute(spark):
    docs = spark.createDataFrame([(1, WORDS["en"], "en"), (2, WORDS["de"], "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.page_id: (r.lang, r.confidence) for r in language.identify(frame(spark, language_pages()), model).collect()}
    want = brute_languages(language_pages(), model)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in want) < 1e-6


def test_language_model_brute(spark):
    """The text model's counts are those of the hashed trigrams of each language's documents."""
    docs = [(i, f"{WORDS[k]} {i}", k) for i in range(40) for k in ("en", "de")]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    for k, name in enumerate(model.languages):
        table = np.full(1 << language.BITS, 0.05)
        for _, t, lang in docs:
            if lang == name:
                t = re.sub("[^a-z]", " ", t.lower())
                for j in range(len(t) - 2):
                    if t[j : j + 2] != "  ":
                        v = sum(ord(c) << s for c, s in zip(t[j : j + 3], (16, 8, 0), strict=True)) * 0x9E3779B1 % (1 << 32)
                        table[v >> (32 - language.BITS)] += 1
        assert np.allclose(model.log[k], np.log(table / table.sum()), atol=1e-4)


def test_rare_languages_have_a_model(spark):
    docs = spark.createDataFrame([(i, "x y z", "en") for i in range(300)] + [(1000, "qq ww", "fil")], "doc_id long, text string, lang string")
    assert language.fit(docs, sample=10).languages == ["en", "fil"]
    assert language.declared('<!doctype html><html data-lang="xx" lang=\'fil-PH\'>') == "fil" and language.declared("<p><html lang=en>") == ""


def test_language_host_prior(spark):
    """A page without text takes its host's language."""
    docs = spark.createDataFrame([(1, WORDS["en"], "en"), (2, WORDS["de"], "de")], "doc_id long, text string, lang string")
    rows = [(i, f"x://a{i % 3}.site.com/", "<article><p>" + "der die das und ist ein " * 5 + "</p></article>") for i in range(30)]
    rows += [(100 + i, f"x://b{i % 3}.page.com/", "<article><p>" + "the and of in to this that " * 5 + "</p></article>") for i in range(30)]
    rows += [(200, "x://a1.site.com/", ""), (201, "x://new.page.com/", "")]
    got = {r.page_id: r for r in language.identify(frame(spark, rows), language.fit(docs)).collect()}
    assert got[200].lang == "de" and got[201].lang == "en" and got[200].confidence > got[201].confidence > 0.5


def brute_warc(rows, min_bytes):
    payload = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    out = []
    for i, _, _ in rows:
        p = payload[i]
        revisit = len(p) >= min_bytes and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None))
    return out


NASTY = ["WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "\r\n\r\n", "WARC/1.", "é日🙂" * 1000, "x" * 3_000_000, "HTTP/1.1 200\r\n\r\nWARC/1.0\r\ncontent-length:5\r\n\r\n"]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_warc(spark, min_bytes):
    rows = [(1, "http://a\r\nb", None), (2, None, "")] + [(10 + i, f"http://u/{i}", NASTY[i % len(NASTY)]) for i in range(40)]
    key = lambda x: (x[0], str(x))
    got = sorted((tuple(r) for r in warc.round_trip(frame(spark, rows), min_bytes=min_bytes).collect()), key=key)
    assert got == sorted(brute_warc(rows, min_bytes), key=key)


def test_warc_payloads(spark):
    rows = [(i, f"http://u/{i}", h) for i, h in enumerate(NASTY)]
    path = C.scratch_path(spark, "test")
    warc.write(frame(spark, rows), path)
    got = {r.page_id: r for r in warc.read(spark, path, payloads=True).collect()}
    assert {i: bytes(r.payload).decode() for i, r in got.items()} == dict(enumerate(NASTY)) and got[1].url == "http://u/1"


def test_warc_edges(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0
    rows = [(5, "u", "same"), (5, "u", "same"), (None, "u", "same"), (7, "u", "same"), (None, None, None)]
    got = warc.round_trip(frame(spark, rows)).collect()
    assert len(got) == 5 and [r.refers_to for r in got if r.page_id == 7] == [5]
    assert {r.record_type for r in got if r.page_id == 5} == {"response"}


def test_warc_string_ids(spark):
    pages = spark.createDataFrame([("b", "u", "same"), ("a", "u", "same"), ("é", "u", "other"), (None, None, "same")], "page_id string, url string, html string")
    got = sorted(((r.page_id or "", r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()))
    assert got == [("", "response", None), ("a", "response", None), ("b", "revisit", "a"), ("é", "response", None)]


def test_warc_archives_are_bounded(spark, tmp_path):
    rows = [(i, "u", f"{i}" + "x" * (200_000 if i == 7 else 1000)) for i in range(200)]
    warc.write(frame(spark, rows).coalesce(1), f"file://{tmp_path}/w", file_bytes=20_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) > 10 and sorted(sizes)[-2] < 22_000
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 200


def test_warc_candidates_are_linear():
    import time

    start = time.time()
    assert len(warc.candidates(b"WARC/1." * 1_000_000 + b"\r\n\r\n")[0]) == 0
    assert len(warc.candidates(b"WARC/1.0\r\nContent-Length: 5\r\n" * 100_000 + b"\r\n")[0]) == 100_000
    assert time.time() - start < 10


def test_pointer_jumping():
    r = random.Random(4)
    for _ in range(200):
        at = sorted(r.sample(range(1, 60), r.randrange(0, 25)))
        at = np.array([0, *at] if r.random() < 0.8 else at, np.int64)
        after = np.array([int(x) + r.randrange(1, 9) for x in at], np.int64)
        want, now = set(), 0
        chain = dict(zip(at.tolist(), after.tolist(), strict=True))
        while now in chain:
            want.add(now)
            now = chain[now]
        assert set(at[warc.reachable(at, after)].tolist()) == want


def test_warc_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in warc.query(spark, sf).collect()) == sorted(brute_warc(rows, 0))
    digest = spark.range(1).select(warc.base32_sha1(F.lit("abc"))).first()[0]
    assert digest == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


LONG_TEXT = "This is the text of a page that we have read, and it was written by one who is at home in the matter of which it is about."


@pytest.mark.parametrize("page,want", [
    (f"<body>{f'<p class=legal>{LONG_TEXT}</p>' * 4}</body>", [LONG_TEXT] * 4),
    (f"<article><h1>Head</h1>{f'<p class=\"related-text\">{LONG_TEXT}</p>' * 4}</article>", ["Head", *[LONG_TEXT] * 4]),
    (f"<body><p>{LONG_TEXT}</p><p class=notice>{LONG_TEXT}</p><p>{LONG_TEXT}</p></body>", [LONG_TEXT] * 2),
    ("<div><a>Home</a> <a>News</a></div><h1>Title</h1><p>Short text.</p><div class=footer>Foot</div>", ["Title", "Short text."]),
    ("<h1>Title</h1><p>Short text.</p>", ["Title", "Short text."]),
    (f"<article><p>{LONG_TEXT}</p></article><article class='comment'><p>{LONG_TEXT} Nice.</p></article>", [LONG_TEXT]),
    (f"<article class='comments-open post'><p>{LONG_TEXT}</p></article>", [LONG_TEXT]),
    (f"<div class='nav-open'><p>{LONG_TEXT} Menu.</p></div><p>{LONG_TEXT}</p>", [LONG_TEXT]),
    (f"<div class='cookie-banner-open'><p>{LONG_TEXT} Cookies.</p></div><div class='has-sidebar'><p>{LONG_TEXT}</p></div>", [LONG_TEXT]),
    (f"<p>{LONG_TEXT} <math><mi>x</mi></math> is it.</p>", [f"{LONG_TEXT} x is it."]),
    (f"<p>{LONG_TEXT} <span class=ad>Buy</span>now</p>", [f"{LONG_TEXT} now"]),
    (f"<p><span class=legal>{LONG_TEXT}</span></p>", [LONG_TEXT]),
    (f"<p>{LONG_TEXT}</p><p hidden>{LONG_TEXT} Hidden.</p>", [LONG_TEXT]),
    (f"<p hidden>{LONG_TEXT}</p>", []),
])
def test_suspects(page, want):
    assert html_extract.main_text(page).split("\n") == (want or [""])


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "</td>" * 200_000, "<div>" * 150_000 + "</div>" * 150_000, "<td></div>" * 100_000, "<p class=nav-open>x" * 50_000, "<span class=ad>" * 60_000])
def test_nesting_is_linear(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 20


def test_long_address(spark):
    """The cost of an address follows its length."""
    rows = [(k, f"http://a.com/x/{'ab-' * n}", None) for k, n in enumerate((3, 350_000))] + [(9, "http://x.com/en/1", None), (10, "http://x.net/de/1", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(frame(spark, rows)).collect()}
    assert set(got) == {0, 1, 9, 10} and got[9] == "block" and got[10] == "allow"
