"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, asides, page headers and footers, buttons, dialogs and hidden
elements go by their element, role or attribute. Elements whose class or id names such a thing, paragraphs, headings and
inline elements among them, and forms, are suspects: they go unless the page has no content without them. A word of a
state counts only before the word that it is about: `has-sidebar` names an element beside a sidebar, `nav-open` a menu.

The first pass decides the clear blocks of what is left: mostly links, or a short copyright line, is boilerplate; long
ones, and shorter ones with enough stop words, are content. On pages in a language without known stop words length
decides alone. The second pass gives each open block the label of its nearest decided neighbours, a heading that of
the next one. Where nothing on a page is decided as content, open blocks without links are. Where a page marks its article, neighbours are those of the same article, equally near ones count as
content, and open blocks outside of it only become content between two content blocks.

Edge cases: null or empty HTML gives an empty text; unclosed and stray tags are tolerated, and cost no more than others
(every scan moves forward); an article without any decided block keeps its open blocks; rows that repeat a page_id each
get a row; other columns than those named are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

# HTML element names and common class words.
RAW = frozenset("script style textarea title noscript template svg iframe object select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figure footer form header li main menu nav ol search section table td th tr ul".split())
BOILERPLATE = frozenset("aside button dialog footer menu nav search option".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt caption legend summary".split())
INLINE = frozenset("span small em i b strong ins label font sup sub".split())
ROLES = frozenset("banner navigation search complementary contentinfo dialog alertdialog alert menu menubar toolbar".split())
CLASSES = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond login search copyright legal disclaimer widget pagination pager toolbar masthead skip topbar".split()
)
#: Words that make a class the state of an element, and those that name content.
STATES = frozenset("with without no has is not open opened enabled closed disabled on off active allow allowed layout".split())
#: Those that also count on an article element.
ARTICLE_CLASSES = frozenset("comment comments disqus reply replies respond related recommended recommendations sponsored advert advertisement promo".split())
CONTENT_CLASSES = frozenset("main content article post entry story body text page".split())
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she so that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht noch nur oder sein sich sie sind so und von war wie wir zu zum zur "
    "al como con de del el ella en entre era es esta este fue la las lo los más me mi muy no o para pero por que se sin sobre su sus también un una y ya".split()
)

LONG, MEDIUM = 25, 8
STOP_DENSITY, LINK_DENSITY, KNOWN_LANGUAGE = 0.2, 0.5, 0.08
#: Characters that count as a word where a text has fewer words, as in scripts without spaces.
WIDE_WORD = 10

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    hard: bool = False  # boilerplate
    soft: bool = False  # boilerplate unless it holds the content
    article: int = -1  # the outermost article or main around it


@dataclass(slots=True)
class Block:
    text: str
    size: int
    linked: int
    node: int
    bad: bool
    soft: bool  # a suspect by its own class
    heading: bool
    stop: float

    def is_content(self, known: bool) -> bool:
        enough = self.stop >= STOP_DENSITY if known else self.size >= LONG
        return self.linked <= LINK_DENSITY * self.size and (self.size >= MEDIUM and enough or self.size >= 2 * LONG)

    def is_boilerplate(self) -> bool:
        return self.linked > LINK_DENSITY * self.size or self.size < LONG and ("©" in self.text or self.text[:9].lower() == "copyright")


def _names_boilerplate(value: str, names: frozenset = CLASSES) -> bool:
    """Whether one of the classes, not that of a state, names boilerplate and none names content."""
    bad = False
    for token in value.split():
        words = [w.lower() for w in _CLASS_WORD.findall(token)]
        first = next((k for k, w in enumerate(words) if w in names), None)
        if first is not None:
            bad |= not STATES.intersection(words[:first])
        elif CONTENT_CLASSES.intersection(words) and not STATES.intersection(words):
            return names is not CLASSES and bad
    return bad


def _hints(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it may be."""
    hard = tag in BOILERPLATE or tag == "header" and not in_article
    soft = tag in FORMS
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() not in ("false", "until-found") or name == "aria-hidden" and value.lower() == "true":
            hard = True
        elif name == "role" and value.lower() in ROLES:
            hard = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hard = True
        elif name in ("class", "id") and tag != "main" and _names_boilerplate(value, ARTICLE_CLASSES if tag == "article" else CLASSES):
            soft = True
    return hard, soft


def tags(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Name, whether it opens, attributes, begin and end of each tag; comments and declarations have no name."""
    at, last = 0, page.rfind(">")
    quotes = {q: page.rfind(q) for q in "\"'"}
    no_end: set[str] = set()
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield "", False, "", begin, at
            continue
        if begin > last:
            return
        m = _NAME.match(page, begin + 1)
        if not m:
            if page.startswith(("<!", "<?", "</"), begin):
                at = page.find(">", begin) + 1
                yield "", False, "", begin, at
            else:
                at = begin + 1
            continue
        end = m.end()
        while (stop := _STOP.search(page, end)) and stop[0] != ">":
            end = page.find(stop[0], stop.end()) + 1 if stop.end() <= quotes[stop[0]] else stop.end()
        at = stop.end() if stop else page.find(">", m.end()) + 1
        tag, opens, attributes = m[1].lower(), page[begin + 1] != "/", page[m.end() : at - 1]
        yield tag, opens, attributes, begin, at
        if opens and tag in RAW and tag not in no_end and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if close:
                at = close.start()
            elif tag in ("script", "style"):
                return
            else:
                no_end.add(tag)
            if close:
                yield "", False, "", begin, at


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    out: list[Block] = []
    nodes = [Node(-1, "")]
    now = 0
    open_tags: dict[str, int] = {}  # how many elements of a name are open, so that no stray end tag looks for one
    parts: list[tuple[str, bool, bool]] = []  # text, whether it is in a link, whether it is in a suspect
    link = heading = hidden = suspect = False
    skipped, depth, gone = "", 0, False  # an inline element that is a suspect, or whose text is left out
    before = 0

    def close() -> None:
        nonlocal parts
        # suspects within a block go, unless they are all of it
        whole = all(s for p, _, s in parts if p.strip())
        own = parts if whole else [x for x in parts if not x[2]]
        parts = []
        words = html.unescape("".join(p for p, _, _ in own)).split()
        if words:
            text = " ".join(words)
            linked = " ".join(html.unescape(p) for p, link_, _ in own if link_)
            stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words)
            size = max(len(words), len(text) // WIDE_WORD)
            out.append(Block(text, size, max(len(linked.split()), len(linked) // WIDE_WORD), now, hidden, suspect or whole and own[0][2], heading, stops / len(words)))

    for tag, opens, attributes, begin, end in tags(page):
        if begin > before and not (depth and gone):
            parts.append((page[before:begin], link, depth > 0))
        before = end
        if not tag:
            continue
        if tag in BLOCK:
            depth = 0
            close()
            hidden, suspect, heading = False, False, opens and tag in HEADINGS
            if tag in CONTAINER:
                link = False
                if opens:
                    article = nodes[now].article
                    hard, soft = _hints(tag, attributes, article >= 0)
                    nodes.append(Node(now, tag, hard, soft, len(nodes) if article < 0 and tag in ("article", "main") else article))
                    now = len(nodes) - 1
                    open_tags[tag] = open_tags.get(tag, 0) + 1
                elif open_tags.get(tag):
                    closed = ""
                    while closed != tag:
                        closed, now = nodes[now].tag, nodes[now].parent
                        open_tags[closed] -= 1
            elif opens and tag not in ("body", "html", "head"):
                hidden, suspect = _hints(tag, attributes, True)
        elif tag in RAW:
            if tag != "svg":
                close()
        elif tag == "a":
            link = opens
        elif tag == "br":
            parts.append((" ", link, depth > 0))
        elif depth:
            depth += (tag == skipped) * (1 if opens else -1)
        elif opens and tag in INLINE and attributes and any(hints := _hints(tag, attributes, True)):
            skipped, depth, gone = tag, 1, hints[0]
    if before < len(page) and not (depth and gone):
        parts.append((page[before:], link, depth > 0))
    close()
    return out, nodes


def _condemned(nodes: list[Node], spared: set[int]) -> list[bool]:
    out: list[bool] = []
    for k, n in enumerate(nodes):
        out.append(n.hard or n.soft and k not in spared or n.parent >= 0 and out[n.parent])
    return out


def main_blocks(found: list[Block], nodes: list[Node]) -> list[Block]:
    """The content blocks, in page order."""
    words = sum(b.size for b in found)
    known = sum(b.stop * b.size for b in found) >= KNOWN_LANGUAGE * words
    hard = _condemned(nodes, set(range(len(nodes))))
    rich = [not (b.bad or hard[b.node]) and b.is_content(known) for b in found]

    # suspects that hold the content: a main element, or, for forms, a long block; else, if nothing is left, long blocks
    # and most of what there is
    held, inside, has_main, has_long = sum(b.size for b, r in zip(found, rich, strict=True) if r), [0] * len(nodes), set(), set()
    for b, r in zip(found, rich, strict=True):
        if r:
            inside[b.node] += b.size
            if b.size >= LONG:
                has_long.add(b.node)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        inside[up] += inside[k]
        if nodes[k].tag == "main" or k in has_main:
            has_main.add(up)
        if k in has_long:
            has_long.add(up)
    spared = {k for k, n in enumerate(nodes) if n.soft and (k in has_main or n.tag in FORMS and k in has_long)}
    gone = _condemned(nodes, spared)
    if not any((r or nodes[b.node].article >= 0 and not b.bad) and not gone[b.node] for b, r in zip(found, rich, strict=True)):
        spared |= {k for k, n in enumerate(nodes) if n.soft and k in has_long and 2 * inside[k] > held}
        gone = _condemned(nodes, spared)

    # suspects by their own class count only where nothing else does
    alone = not any(r and not b.soft and not gone[b.node] for b, r in zip(found, rich, strict=True))
    left = [b for b, r in zip(found, rich, strict=True) if not b.bad and not gone[b.node] and (not b.soft or alone and r)]
    article = [nodes[b.node].article for b in left]
    content = [b.is_content(known) for b in left]
    share = lambda inner: sum(b.size for b, c, a in zip(left, content, article, strict=True) if c and (a >= 0) == inner and (inner or b.size >= LONG))
    marked = any(a >= 0 for a in article) and share(True) >= share(False)
    if not marked:
        article = [-1] * len(left)

    labels: list[bool | None] = []
    for b, c, a in zip(left, content, article, strict=True):
        # what a marked article leaves outside is open at best
        labels.append(False if b.is_boilerplate() else True if c and (a >= 0 or not marked) else None)
    if not any(labels):
        return [b for b, x in zip(left, labels, strict=True) if x is None and not b.linked]
    before: list[int] = []
    seen: dict[int, int] = {}
    last = -1
    for k, x in enumerate(labels):
        before.append(seen.get(article[k], -1) if article[k] >= 0 else last)
        if x is not None:
            seen[article[k]] = last = k
    seen, last, out = {}, -1, []
    for k in range(len(left) - 1, -1, -1):
        b, a = before[k], seen.get(article[k], -1) if article[k] >= 0 else last
        if labels[k] is not None:
            good = labels[k]
            seen[article[k]] = last = k
        elif a < 0 and b < 0:
            good = article[k] >= 0 or not marked
        elif marked and article[k] < 0:
            good = a >= 0 and b >= 0 and labels[a] and labels[b]
        elif left[k].heading and a >= 0:
            good = labels[a]
        elif a >= 0 and b >= 0 and labels[a] != labels[b]:
            near, far = a - k, k - b
            good = (article[k] >= 0 or not left[k].linked) if near == far else labels[a if near < far else b]
        else:
            good = labels[a if a >= 0 else b]
        if good:
            out.append(left[k])
    return out[::-1]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(*blocks(page))) if page else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in C.chunks(batches, "html"):
            blob = raw.tobytes()
            texts = [main_text(blob[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    C.tune(pages.sparkSession)
    kind = dict(pages.dtypes)[page_id]
    own = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[page].alias("html"))
    return own.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(C.load(spark, sf_dir, "pages"))
