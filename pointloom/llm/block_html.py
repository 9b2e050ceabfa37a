"""Main text of web pages by two passes over their blocks.

Pass one judges each block by itself from its length, its link density and its share of stop words; blocks inside
elements that by their tag, role or class hold menus, notices, adverts, forms or comments are decided as boilerplate, and
blocks of an ``article`` or ``main`` element need fewer stop words and may have more links. Pass two gives each block that
isn't decided the label of its nearest decided neighbour in the smallest element around it that has one; in an ``article``
or ``main`` element that is a block of its own if some are good.

Names may mislead: an element that only its name, or being a form, makes boilerplate is judged like any other if it holds
the page's only top heading or main element, or if the page had no text without it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .textbuf import lean, small_batches

# Common words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their
    if will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now did my
    le la les de des du un une et est en que qui dans pour pas par sur au aux ce il elle ne se son sa ses avec plus mais ou nous vous ils je on cette sont tout être
    der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem er hat aus bei sie nach wie im um am sind noch einen wird über so zum war
    el los las y del se por con para una su al lo como más pero sus le ya o fue este ha sí porque esta son entre está cuando muy sin sobre ser también me hasta hay""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head
    header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
RAW = frozenset("script style template noscript textarea svg math iframe object audio video canvas title head".split())
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog fieldset search optgroup option".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split())
BOILER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising advertorial sponsor sponsored sponsors promo promos promotion promotions banner banners nav
    navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav rail footer foot masthead topbar cookie cookies consent gdpr notice notices
    notification alert popup modal overlay lightbox newsletter subscribe subscription signup signin login register share sharing social follow comment comments
    commentlist reply replies respond discussion disqus review reviews related recommended recommendation recommendations trending popular widget widgets toolbar
    pager pagination paging copyright legal disclaimer hidden skip paywall""".split()
)
#: Of these, and of names of comments, a page's main text is never a part.
SURE_TAGS = frozenset("nav footer button select menu optgroup option".split())
SURE_NAMES = frozenset("ad ads nav menu footer cookie cookies consent comment comments commentlist reply replies respond discussion disqus sidebar".split())
#: Words that say of a name's other words that a part or a place of it is meant.
PART_NAMES = frozenset(
    """area bar bg block body bottom box button buttons center col column container content desktop form group header heading icon icons inner item items label left
    link links list main media mobile module outer panel part right row section slot small text title top unit wrap wrapper zone 1 2 3""".split()
)
MAIN_NAMES = frozenset("article articlebody content contents main maincontent post entry story page wrapper container layout text body".split())

#: Characters below which a block is too short to judge, links' share of characters and stop words' share of words.
SHORT, LINKS, STOP_LOW, STOP_HIGH = 70, 0.33, 0.10, 0.22

SENTENCE_ENDS = ".!?…:\"”»"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in RAW}

# Words that join a layout's parts in a name, and names of an article's own header.
JOINS, ARTICLE_NAMES = frozenset("with has no without not".split()), frozenset("article content entry post story".split())

GOOD, BAD, UNSURE = 1, -1, 0
#: Kinds of elements; by-name boilerplate is ``_NAMED`` until the page says otherwise.
_NONE, _MAIN, _BOILER, _NAMED = 0, 1, 2, 3


def _boiler_name(value: str, inside: int) -> str:
    """The word by which a class or id names boilerplate, empty if it doesn't.

    Of a name with words of both kinds the last word decides, or others if the rest only says that it is a part, as in
    ``sidebar-content``. Beside a name that is wholly an article's, only names that are wholly boilerplate's count.
    """
    found, wholly, article = "", "", False
    for name in value.split():
        w = [x.lower() for x in _NAME.findall(name)]
        if not w or JOINS & set(w):
            continue
        own = [x in BOILER_NAMES or (x == "header" and inside != _MAIN and not ARTICLE_NAMES & set(w)) for x in w]
        article |= all(x in MAIN_NAMES for x in w)
        said = [x for x, o in zip(w, own, strict=True) if o]
        if own[-1] or said and all(o or x in PART_NAMES for x, o in zip(w, own, strict=True)):
            found = found or said[-1]
        if all(own):
            wholly = wholly or said[-1]
    return wholly if article else found


def _kind(tag: str, attributes: str, inside: int) -> int:
    """What an element's start says of its content."""
    if inside == _BOILER or tag in SURE_TAGS:
        return _BOILER
    found = _MAIN if tag in ("article", "main") and inside != _NAMED else inside
    if tag == "header" and inside != _MAIN or tag in BOILER_TAGS:
        found = _NAMED
    if not attributes:
        return found
    for m in _ATTR.finditer(attributes):
        if m[5]:
            return _BOILER
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if value.lower() in BOILER_ROLES:
                found = _BOILER if value.lower() in ("navigation", "banner", "contentinfo") else _NAMED
            elif value.lower() in ("main", "article") and found != _NAMED:
                found = _MAIN
        elif name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            word = _boiler_name(value, found)
            if word:
                found = _BOILER if word in SURE_NAMES else _NAMED
        elif name == "itemprop" and value.lower() == "articlebody" and found != _NAMED:
            found = _MAIN
        elif (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return _BOILER
        if found == _BOILER:
            return found
    return found


class Block(NamedTuple):
    """A block's text, characters in links, kind of the element around it, whether it is a heading, number of the main
    element, of the smallest element, and of the outermost by-name boilerplate that it is in."""

    text: str
    links: int
    kind: int
    heading: bool
    main: int
    element: int
    named: int


class Page:
    """The blocks of a page in order, and its elements: the one around each, and the blocks that each holds."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.around, self.first, self.last = [-1], [0], [0]
        #: Of by-name boilerplate: main elements and top headings in it. At 0: those of the rest of the page.
        self.mains: Counter[int] = Counter()
        self.tops: Counter[int] = Counter()
        self.main = self.element = self.named = 0
        self.parts: list[str] = []
        self.links: list[str] = []

    def end(self, kind: int, heading: bool) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(Block(text, sum(len(" ".join(x.split())) for x in self.links), kind, heading, self.main if kind == _MAIN else 0, self.element, self.named))
            self.parts, self.links = [], []

    def opened(self) -> None:
        self.around.append(self.element)
        self.first.append(len(self.blocks))
        self.last.append(-1)
        self.element = len(self.around) - 1

    def closed(self) -> None:
        self.last[self.element] = len(self.blocks)
        self.element = self.around[self.element]


def blocks(html: str, spared: frozenset[int] = frozenset()) -> Page:
    """The text blocks of a page, in order; ends of elements that never began are ignored, open elements end with the page.

    ``spared`` has numbers of elements that are no boilerplate whatever their names say.
    """
    out = Page()
    stack: list[tuple[str, int, int]] = []
    open_tags: Counter[str] = Counter()
    kind, link, heading, breaks, number = _NONE, False, False, 0, 0
    at, n = 0, len(html)

    def pop() -> tuple[str, int]:
        tag, before, out.named = stack.pop()
        open_tags[tag] -= 1
        out.closed()
        return tag, before

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            part = html[at:lt]
            if not part.isspace():
                breaks = 0
            out.parts.append(part)
            if link:
                out.links.append(part)
        if lt == n:
            break
        two = html[lt + 1 : lt + 2]
        if two == "!" or two == "?":
            mark = "-->" if html.startswith("<!--", lt) else "]]>" if html.startswith("<![CDATA[", lt) else ">"
            to = html.find(mark, lt + 2)
            at = n if to < 0 else to + len(mark)
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if two.isalpha() or two == "/":  # a tag that the page ends in
                to = html.find(">", lt)
                at = n if to < 0 else to + 1
            else:
                out.parts.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            if tag in BLOCKS:
                out.end(kind, heading)
                heading = False
                link = False
            if open_tags[tag]:
                if any(before != kind for _, before, _ in stack[-1:]):
                    out.end(kind, heading)
                while True:
                    t, before = pop()
                    if t == tag:
                        break
                if tag in BLOCKS or before != kind:
                    out.end(kind, heading)
                kind = before
            continue
        number += 1
        if tag in RAW:
            if tag in BLOCKS:
                out.end(kind, heading)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                if tag == "head":
                    stop = re.compile(r"</head\b[^>]*+>|<body\b", re.I).search(html, at)
                    at = at if not stop else stop.end() if stop[0][1] == "/" else stop.start()
                else:
                    stop = _CLOSE[tag].search(html, at)
                    at = n if not stop and tag in ("script", "style", "textarea", "title") else stop.end() if stop else at
            continue
        if tag == "br":
            out.parts.append(" ")
            breaks += 1
            if breaks > 1:
                out.end(kind, heading)
            continue
        if tag in BLOCKS:
            out.end(kind, heading)
            link, heading = False, tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if stack and stack[-1][0] == "p":
                kind = pop()[1]
        elif tag == "a":
            link = True
        new = _kind(tag, m[3], kind)
        if new == _NAMED != kind and number in spared:
            new = kind
        if kind not in (_BOILER, _NAMED) and new == _NAMED:
            own = number
        else:
            own = 0 if new not in (_BOILER, _NAMED) else out.named
        if new != _BOILER:
            out.mains[own] += tag in ("article", "main")
            out.tops[own] += tag == "h1"
        if tag not in VOID and (tag in BLOCKS and tag not in ("p", "tr", "td", "th", "li") or new != kind):
            if new != kind and tag not in BLOCKS:
                out.end(kind, heading)
            stack.append((tag, kind, out.named))
            open_tags[tag] += 1
            out.opened()
            out.named = own
            out.main += new == _MAIN != kind
            kind = new
    out.end(kind, heading)
    while stack:
        pop()
    out.last[0] = len(out.blocks)
    return out


def _alone(text: str, links: int, kind: int) -> int:
    """Pass one; in a main element a block is judged one step milder."""
    if kind in (_BOILER, _NAMED):
        return BAD
    density = links / len(text)
    if kind == _MAIN:
        if len(text) < SHORT or density > 2 * LINKS:
            return BAD if density > 2 * LINKS and len(text) < SHORT else UNSURE
    elif density > LINKS or "©" in text and len(text) < 2 * SHORT:
        return BAD
    elif len(text) < SHORT:
        return BAD if links and density > LINKS / 2 else UNSURE
    words = _WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if kind == _MAIN:
        return GOOD if share >= STOP_LOW else UNSURE
    return GOOD if share >= STOP_HIGH else UNSURE if share >= STOP_LOW or not links and text[-1] in SENTENCE_ENDS else BAD


def _inherit(found: list[Block], label: list[int], end: int, page: Page | None = None) -> list[int]:
    """Pass two; ``end`` is the label of what is before and after all blocks.

    With ``page``, a neighbour in the smallest element that holds one comes before nearer ones outside of it.
    """
    n = len(label)
    before, after = [-1] * n, [n] * n
    last = -1
    for i in range(n):
        before[i] = last
        if label[i] != UNSURE:
            last = i
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        if label[i] != UNSURE:
            last = i
    of = lambda k: label[k] if 0 <= k < n else end
    out = []
    for i, b in enumerate(found):
        if label[i] != UNSURE:
            out.append(label[i])
            continue
        p, q = before[i], after[i]
        element = b.element if page else 0
        while element > 0 and p < page.first[element] and q >= page.last[element]:
            element = page.around[element]
        if element > 0:
            p, q = (p if p >= page.first[element] else None), (q if q < page.last[element] else None)
        if b.heading and q is not None:
            out.append(of(q))
        elif p is None or q is None:
            out.append(of(q if p is None else p))
        elif of(p) == of(q) or i - p != q - i:
            out.append(of(p) if i - p <= q - i else of(q))
        else:  # as near to either: a main element's block or a sentence goes on with the article
            out.append(GOOD if b.kind == _MAIN or b.text[-1] in SENTENCE_ENDS else BAD)
    return out


def classify(page: Page) -> list[bool]:
    """Which blocks are main text."""
    found = page.blocks
    label = [_alone(b.text, b.links, b.kind) for b in found]
    if GOOD not in label:  # only the main elements say where the text is, or where there are none, long blocks without links
        main = any(b.kind == _MAIN for b in found)
        label = [GOOD if x == UNSURE and (b.kind == _MAIN if main else len(b.text) >= SHORT and not b.links) else x for x, b in zip(label, found, strict=True)]
    for main in {b.main for b, x in zip(found, label, strict=True) if b.main and x == GOOD}:
        own = [i for i, b in enumerate(found) if b.main == main]
        for i, x in zip(own, _inherit([found[i] for i in own], [label[i] for i in own], GOOD), strict=True):
            label[i] = x
    return [x == GOOD for x in _inherit(found, label, BAD, page)]


def _misled(page: Page, good: list[bool]) -> int:
    """The number of an element that names have wrongly made boilerplate; 0 for none."""
    for held in (page.mains, page.tops):
        inside = [k for k, m in held.items() if k and m]
        if not held[0] and len(inside) == 1:
            return inside[0]
    if any(good):
        return 0
    size: Counter[int] = Counter()
    for b in page.blocks:
        if b.named and b.kind == _NAMED and _alone(b.text, b.links, _NONE) == GOOD:
            size[b.named] += len(b.text)
    return max(size, key=lambda k: (size[k], -k), default=0)


def main_text(html: str | None) -> str:
    """The blocks of main text, joined by blank lines; empty for a null or empty page or one without main text."""
    if not html:
        return ""
    spared: frozenset[int] = frozenset()
    while True:
        page = blocks(html, spared)
        good = classify(page)
        more = _misled(page, good)
        if not more or more in spared:
            return "\n\n".join(b.text for b, x in zip(page.blocks, good, strict=True) if x)
        spared |= {more}


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html, …)``; repeated rows come back repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").transform(small_batches).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
