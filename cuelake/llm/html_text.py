"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks in one linear pass.  Features of a block:
word count and link density of itself and of the blocks before and after it, whether
it lies in an article or main container, and how much its containers speak against
it: 1 for a name or element of boilerplate, 2 for teasers, comments, hidden parts or
the like.  An article opens a main container unless it lies in, or is, such a teaser
or comment.  Names of the whole page and names of its layout ("has-sidebar") count
for nothing, nor do marks on more than half of the page's words - the strong ones
only where next to no unmarked text is left beside them - so that word count and
link density carry a page whose names mislead.  The tree is trained when first used,
on the hand-labelled blocks of ``LABELLED``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style noscript template textarea select iframe svg object title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SPACED = frozenset(["br"])
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table menu figure dialog details fieldset".split()
)
NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset button head".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar\w*|menu\w*|nav\w*|footer|header|masthead|comments?|"
    r"commentlist|disqus|reply|replies|cookie\w*|cc-(?:window|banner|dialog)|consent\w*|\w*notices?|notification\w*|alerts?|gdpr|popup\w*|modal|"
    r"newsletter|subscri\w*|social|shar(?:e|ing)|related|recommend\w*|widget\w*|breadcrumbs?|pagination|tags|login|signup|search|"
    r"disclaimers?|discussions?|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Names that say what a container has beside it or how it is laid out, not what it is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|without|no|is|layout)[_-]\S+|\S+[_-](?:layout|open|closed|on|off|enabled|disabled|free))(?=\s|$)", re.I)
#: Containers that an article in them does not turn into the page's article: teasers and readers' comments.
FIRM_TAGS = frozenset("aside nav footer".split())
FIRM_NAMES = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bar|comments?|commentlist|disqus|discussions?|reply|replies|related|recommend\w*|"
    r"cookie\w*|cc-window|\w*notices?|alerts?|(?:\w+[_-])?disclaimers?)(?=$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|body-?text|content)(?:$|[\s_-])", re.I)
#: A mark of boilerplate counts for nothing when the container holds more than this share of the page's words;
#: a strong one also needs a page without a main container, whose other text has no more than the other share.
MOST_OF_PAGE, LITTLE_OF_PAGE = 0.5, 0.1
#: Words from which a block is simply long.
LONG_BLOCK = 24
#: Attributes of parts that nobody sees.
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """A run of text without a block-level tag in it."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool = False
    noise: bool = False
    firm: bool = False
    within: bool = False

    def close(self) -> None:
        self.words = "".join(self.parts).split()
        self.parts = []

    @property
    def density(self) -> float:
        return min(1.0, self.linked / max(1, len(self.words)))


def _tag_end(html: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """(position after a tag, attributes, closed by a slash) from the position after the tag's name.

    Attributes follow the rules of HTML: a quote inside an unquoted value is part of
    it, a sign of a tag inside a quoted one is not its end.  A quote that nothing
    closes ends with the tag at the next ``>``.  A tag that never ends is -1.
    """
    found: list[tuple[str, str]] = []
    while m := ATTRIBUTE.match(html, at):
        if html.startswith(("'", '"'), m.end()) and html[m.start() : m.end()].rstrip().endswith("="):
            at = html.find(">", m.end())  # an open quote
            return (at + 1 if at >= 0 else -1), found, False
        found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()
    end = html.find(">", at)
    return (end + 1 if end >= 0 else -1), found, html[at:end].endswith("/") if end >= 0 else False


def tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """('text', text, []), ('open', element, attributes) and ('close', element, []) in page order.

    One pass; every character is looked at a bounded number of times.  Comments,
    declarations and the content of ``RAW`` elements are left out, an open one up
    to the end of the page; such an element comes as a space.
    """
    at, size = 0, len(html)
    while at < size:
        sign = html.find("<", at)
        if sign < 0:
            yield "text", html[at:], []
            return
        after = html[sign + 1 : sign + 2]
        name = TAG_NAME.match(html, sign + 1 + (after == "/"))
        if not name and after not in ("!", "?", "/"):
            yield "text", html[at : sign + 1], []
            at = sign + 1
            continue
        if sign > at:
            yield "text", html[at:sign], []
        if html.startswith("<!--", sign):
            at = html.find("-->", sign + 4)
            at = at + 3 if at >= 0 else size
        elif not name:
            at = html.find(">", sign)
            at = at + 1 if at >= 0 else size
        else:
            tag = name[0].lower()
            at, attributes, slash = _tag_end(html, name.end())
            if at < 0:  # the tag never ends: nothing of it is text
                return
            if after == "/":
                yield "close", tag, []
            elif tag in RAW:
                if not (slash and tag == "svg"):
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    at = html.find(">", end.end()) + 1 if end else size
                    at = at or size
                yield "text", " ", []
            else:
                yield "open", tag, attributes
                if slash and tag in CONTAINERS:
                    yield "close", tag, []


@dataclass
class Container:
    """An open element: in main; boilerplate by name or element; strongly so; in main but for that; own marks; the blocks inside."""

    tag: str
    main: bool
    noise: bool
    firm: bool
    within: bool = False
    marked: int = 0
    first: int = 0
    words: int = 0


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, in page order; never raises on broken markup."""
    out: list[Block] = []
    stack: list[Container] = []
    marks: list[tuple[int, int, int, int]] = []  # marked containers: blocks from, to, their words, how strong
    opened: Counter[str] = Counter()
    now, links, total = Block(), 0, 0

    def cut() -> None:
        nonlocal now, total
        now.close()
        if now.words:
            total += len(now.words)
            out.append(now)
        top = stack[-1] if stack else None
        now = inside(top)

    def inside(top: Container | None) -> Block:
        return Block(main=top.main, noise=top.noise, firm=top.firm, within=top.within) if top else Block()

    def leave(depth: int) -> None:
        for c in stack[depth:]:
            opened[c.tag] -= 1
            if c.marked:
                marks.append((c.first, len(out), total - c.words, c.marked))
        del stack[depth:]

    for kind, value, attributes in tokens(html):
        if kind == "text":
            plain = unescape(value) if "&" in value else value
            now.parts.append(plain)
            if links:
                now.linked += len(plain.split())
            continue
        if value == "a":
            links = int(kind == "open")
        if value in INLINE:
            continue
        if value in SPACED:
            now.parts.append(" ")
            continue
        links = 0
        cut()
        if value not in CONTAINERS and value not in NOISE_TAGS:
            continue
        if kind == "close":
            if opened[value]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == value))
        else:
            opened[value] += 1
            stack.append(_container(value, attributes, stack[-1] if stack else None))
            stack[-1].first, stack[-1].words = len(out), total
        now = inside(stack[-1] if stack else None)
    cut()
    leave(0)
    _void(out, marks, total)
    return out


def _void(found: list[Block], marks: list[tuple[int, int, int, int]], total: int) -> None:
    """Take back the marks of containers that hold most of a page; one pass over blocks and one over marks."""
    plain = sum(len(b.words) for b in found if not b.firm and b.density < 0.5)
    if any(b.main and not b.noise for b in found):
        plain = total  # there is a main container: strong marks stay
    # By place and strength (1, 2): containers that begin there minus those that end there, void and valid.
    void, valid = ([[0] * (len(found) + 1) for _ in range(3)] for _ in range(2))
    for first, last, words, mark in marks:
        taken = words > MOST_OF_PAGE * total and (mark < 2 or plain <= LITTLE_OF_PAGE * total)
        steps = (void if taken else valid)[mark]
        steps[first] += 1
        steps[last] -= 1
    now = [0, 0, 0, 0]
    for k, b in enumerate(found):
        now = [n + s[k] for n, s in zip(now, (void[1], void[2], valid[1], valid[2]), strict=True)]
        if now[1]:  # a container that holds the page's text is its main one, whatever it is called
            b.firm, b.noise = now[3] > 0, now[2] > 0
            b.main = b.main or b.within or not (b.firm or b.noise)
        b.noise = b.noise and not now[0] and not b.firm


@lru_cache(1 << 12)
def _said(names: str) -> tuple[bool, bool, bool]:
    """Whether names speak of an article, of boilerplate, and strongly so."""
    names = LAYOUT.sub(" ", names)
    return bool(MAIN_NAMES.search(names)), bool(NOISE_NAMES.search(names)), bool(FIRM_NAMES.search(names))


def _container(tag: str, attributes: list[tuple[str, str]], outer: Container | None) -> Container:
    main, noise, firm = (outer.main, outer.noise, outer.firm) if outer else (False, False, False)
    # the names of the whole page say what is on it, not what it is
    names = "" if tag in ("html", "body") else " ".join(v for k, v in attributes if k in ("class", "id", "role"))
    says_main, says_noise, says_firm = _said(names)
    article = tag in ("article", "main")
    hidden = any(k == "hidden" or (k == "aria-hidden" and v.strip().lower() == "true") or (k == "style" and HIDDEN_STYLE.search(v)) for k, v in attributes)
    own = tag != "main" and (tag in FIRM_TAGS or says_firm) or hidden
    marked = tag in NOISE_TAGS or (tag == "header" and not main) or (not article and says_noise)
    good = article or (not marked and says_main)
    within = (outer.within if outer else False) or good
    firm = own or (firm and tag != "main")
    good = good and not firm
    mark = 2 if own else int(marked and not firm)
    return Container(tag, main or good, (noise or marked or firm) and not (good and not main), firm, within, mark)


def features(found: list[Block]) -> np.ndarray:
    """One row per block: words (``LONG_BLOCK`` at most) and link density before, here, after; in main; how strongly it is marked as boilerplate."""
    n = len(found)
    x = np.zeros((n, 8))
    if n:
        words = np.minimum(np.array([0, *(len(b.words) for b in found), 0], float), LONG_BLOCK)
        dense = np.array([0, *(b.density for b in found), 0], float)
        for k in range(3):
            x[:, 2 * k], x[:, 2 * k + 1] = words[k : n + k], dense[k : n + k]
        x[:, 6], x[:, 7] = [b.main for b in found], [2 if b.firm else int(b.noise) for b in found]
    return x


def _page(*parts: tuple[int, str]) -> tuple[str, list[int]]:
    return "".join(p for _, p in parts), [k for k, p in parts if p and re.search(r">[^<]*\w", p)]


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 2


def _said_in(n: int) -> str:
    """So many words."""
    return " ".join(["word"] * n)


#: Hand-labelled pages: 1 for a block of the article, 0 for anything else.
LABELLED = [
    _page(
        (0, "<nav><ul><li><a href=x>home</a></li>"), (0, "<li><a href=x>world news</a></li></ul></nav>"),
        (0, "<div class=ad>buy this now and save a lot today</div>"), (1, "<article><h1>a title of the story</h1>"),
        (1, f"<p>{LONG}</p>"), (1, "<p>short.</p>"), (1, f"<p>{LONG} <a href=x>link</a></p>"), (1, "<p>two words</p></article>"),
        (0, "<footer>copyright of the site and a few words more</footer>"),
    ),
    _page(
        (0, "<header><div>the site's name</div></header>"), (0, "<div class=menu><a href=x>a</a> <a href=x>b</a></div>"),
        (1, f"<div><p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}</p>"), (1, "<p>five words stand in here</p>"), (1, f"<p>{LONG}</p></div>"),
        (0, "<div><a href=x>more of this</a></div>"), (0, "<div><a href=x>privacy</a></div>"),
    ),
    _page(
        (0, "<div id=cookie-notice><p>we use cookies to make this better for all of you who read it here</p></div>"),
        (1, "<main><h2>heading</h2>"), (1, f"<p>{LONG}</p>"), (1, "<ul><li>an item of a list</li>"), (1, "<li>another item</li></ul>"),
        (1, "<p>the end</p></main>"), (0, f"<div class=comments><p>{LONG}</p>"), (0, "<p>i agree with that</p></div>"),
        (0, "<aside><p>other stories you may like to read some day</p></aside>"), (0, "<form><p>your mail address</p></form>"),
    ),
    _page(
        (0, "<p><a href=x>one</a></p>"), (0, "<p><a href=x>two links here</a></p>"), (0, "<p>sign in</p>"),
        (1, f"<p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}</p>"), (1, "<h3>part two of it</h3>"), (1, f"<p>{LONG}{LONG}</p>"),
        (0, "<p><a href=x>next</a> <a href=x>page</a></p>"), (0, "<p><a href=x>terms of use</a></p>"), (0, "<p>all rights reserved</p>"),
    ),
    _page(
        (1, "<article><p>one line only</p>"), (0, f"<div class=share><p>{LONG}</p></div>"), (1, f"<p>{LONG}</p>"),
        (0, "<section class='related'><p>read on</p></section>"), (1, "<p><a href=x>a source</a></p>"), (1, "<p>fin</p></article>"),
        (0, f"<aside class=sidebar><p>{LONG}{LONG}</p></aside>"), (0, f"<footer><p>{LONG}</p></footer>"),
    ),
    _page(
        (1, "<body class='has-sidebar single-post'><article class=post><h1>a title</h1>"), (1, f"<p>{LONG}</p>"), (1, "<p>fin</p></article>"),
        (0, f"<section class=comments><article class=comment><p>{LONG}{LONG}</p>"), (0, "<p>i agree</p></article>"),
        (0, f"<article class=comment><p>{LONG}</p></article></section>"), (0, "<aside><article class=teaser><h3>other</h3>"),
        (0, f"<p>{LONG}</p></article></aside></body>"),
    ),
    _page(
        (0, "<body class=has-sidebar><p><a href=x>one</a></p>"), (0, "<p><a href=x>two links here</a></p>"),
        (1, f"<div><p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}</p>"), (1, "<p>some words in the middle</p>"), (1, f"<p>{LONG}</p></div>"),
        (0, "<p><a href=x>next</a> <a href=x>page</a></p>"), (0, "<p><a href=x>terms of use</a></p></body>"),
    ),
    *(_page(
        *((0, f"<div><a href=x>{w}</a></div>") for w in bar.split()), (0, f"<div><a href=x>more</a> from {bar}</div>"),
        (1, f"<div><div>{LONG}{LONG}</div>"), (1, "<div>part of it</div>"), (1, f"<div>{LONG}</div>"), (1, f"<div>{LONG}<a href=x>see this</a></div>"),
        (1, f"<div>{LONG}</div></div>"), *((0, f"<div><a href=x>{w} {w}</a></div>") for w in bar.split()), (0, "<div>made with care</div>"),
    ) for bar in ("home world sport money", "start blog about us help", "a b c d e f")),
    _page(
        (0, "<div>the name of the site</div>"), *((0, f"<td><a href=x>{w}</a></td>") for w in "one two three four five".split()),
        (1, f"<p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}</p>"), (1, "<h2>why it is so</h2>"), (1, f"<p>{LONG}</p>"), (1, f"<p>{LONG}</p>"),
        *((0, f"<p><a href=x>{w} of them</a></p>") for w in "six seven eight nine ten".split()),
    ),
    _page(
        (1, f"<article><p>{LONG}{LONG}</p>"), (0, f"<div class='alert alert-info'><p>{LONG}</p></div>"), (1, f"<p>{LONG}</p></article>"),
        (0, f"<div class=cookiebar><p>{LONG}</p></div>"), (0, f"<div class=sidebar-left><p>{LONG}</p></div>"), (0, f"<div hidden><p>{LONG}</p></div>"),
        (0, f"<section id=discussion><p>{LONG}{LONG}</p></section>"), (0, f"<div class=legal-disclaimer><p>{LONG}</p></div>"),
        (0, f"<div class=menu><p>{LONG}</p></div>"),
    ),
    _page(
        (0, "<nav><a href=x>home</a></nav>"), (0, "<div class=ad>buy this</div>"), (1, "<article><h1>a table</h1>"), (1, f"<p>{LONG}</p>"),
        (1, "<table><tr><td>a</td>"), *((1, f"<td>{w}</td>") for w in "b c d e f g h".split()), (1, "<td>i</td></table>"),
        (1, "<ul><li>one</li>"), (1, "<li>two</li>"), (1, "<li><a href=x>three</a></li></ul>"), (1, f"<p>{LONG}</p></article>"),
        (0, "<footer>the site's name</footer>"),
    ),
    *(_page(
        (0, "<div><a href=x>home</a></div>"), (0, f"<div class={name}><p>{_said_in(sizes[-1])}</p>"), (0, f"<p>{_said_in(sizes[0])}</p></div>"),
        (1, f"<{tag}><p>{_said_in(sizes[0])}</p>"), *((1, f"<p>{_said_in(n)}</p>") for n in sizes[1:]),
        *((0, f"<div class={n}>{_said_in(k)}</div>") for n, k in zip((name, "comments", "share", "related"), sizes, strict=False)), (1, f"<p>{_said_in(sizes[2])}</p>"),
        (1, f"<p>{_said_in(sizes[1])} <a href=x>{_said_in(3)}</a></p></{tag}>"), *((0, f"<div class={name}>{_said_in(n)}</div>") for n in sizes),
        (0, "<p><a href=x>more</a></p>"),
    ) for tag, name, sizes in (
        ("article", "widget", (12, 3, 90, 1, 7)), ("main", "sidebar", (150, 2, 2, 14, 60)), ("article", "notice", (5, 5, 4, 5, 45)),
        ("article", "newsletter", (70, 9, 110, 200, 20)), ("main", "sharing", (1, 1, 2, 100, 1)), ("article", "login", (5, 28, 18, 6, 36)),
    )),
    *(_page(
        (0, "<div><a href=x>home</a></div>"), (0, "<div><a href=x>all of them</a></div>"), (1, f"<div class='{name}'><h1>{_said_in(5)}</h1>"), (1, f"<p>{_said_in(70)}</p>"),
        (1, f"<p>{_said_in(48)}</p>"), (1, f"<p>{_said_in(90)}</p>"), (1, f"<p>{_said_in(33)}</p>"), (1, f"<p>{_said_in(64)}</p></div>"),
        (0, f"<div class=comments><p>{_said_in(150)}</p>"), (0, f"<p>{_said_in(180)}</p></div>"), (0, f"<div class=newsletter>{_said_in(14)}</div>"),
    ) for name in ("search-page", "login-wall", "social-text", "widget-area")),
    *(_page((1, f"<h1>{_said_in(n)}</h1>"), (1, f"<p>{_said_in(40 + n)}</p>"), (1, f"<p>{_said_in(50)}</p>")) for n in (3, 6, 9)),
    *(_page(
        (0, f"<nav><a href=x>{_said_in(k)}</a></nav>"), (1, f"<div class='{name}'><article><h1>{_said_in(n)}</h1>"), (1, f"<p>{_said_in(40 + n)}</p>"),
        (1, f"<p>{_said_in(50)}</p></article></div>"), (0, "<footer>the name of the site</footer>"),
    ) for k, n, name in ((1, 3, "promo"), (2, 7, "ads-x"), (1, 4, "related-x"))),
    *(_page(
        *((0, f"<div><a href=x>{_said_in(n)}</a></div>") for n in sizes[:3]), *((1, f"<p>{_said_in(n + 12)}</p>") for n in sizes),
        (0, f"<p>{_said_in(4)}</p>"), *((0, f"<div><a href=x>{_said_in(n)}</a></div>") for n in sizes[:3]),
    ) for sizes in ((2, 9, 4, 60, 14), (1, 3, 1, 120, 40), (5, 2, 3, 28, 90))),
    _page((1, "<main><p>a</p>"), *((1, f"<p>{w}</p>") for w in "b c d e f g".split()), (1, "<p><a href=x>h</a></p></main>")),
    _page((1, "<article><h1>a title</h1>"), (1, f"<p>{LONG}</p>"), (1, "<p>the end</p></article>")),
    _page((0, "<nav><a href=x>home</a></nav>"), (1, f"<main><p>{LONG}</p>"), (1, f"<p>{LONG}{LONG}</p></main>")),
    _page((1, f"<p>{LONG}</p>")),
    _page((1, "<article><p>a few words only</p></article>")),
    _page((1, f"<div><p>{LONG}</p>"), (1, f"<p>{LONG}{LONG}</p></div>")),
    _page((0, "<p><a href=x>one</a> <a href=x>two</a></p>"), (1, "<div><h2>a heading here</h2>"), (1, f"<p>{LONG}</p>"), (1, "<p>the end of it</p></div>")),
    _page(
        (0, "<div class=notice><p>we use cookies to make this better for all of you who read it here</p></div>"),
        (1, f"<div class='widget-box'><p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}{LONG}</p>"), (1, f"<p>{LONG}{LONG}{LONG}</p></div>"),
        (0, f"<div class=comments><p>{LONG}{LONG}</p>"), (0, f"<p>{LONG}{LONG}{LONG}{LONG}</p>"), (0, f"<p>{LONG}{LONG}{LONG}{LONG}</p></div>"),
        (0, "<div class=newsletter><p>sign up for our letter and get the best of it each week by mail</p>"), (0, "<p>no thanks</p></div>"),
    ),
]


LEAST_LEAF = 1


@dataclass(frozen=True)
class Node:
    """A leaf (``feature`` -1) or a split: ``value`` and below go left."""

    feature: int = -1
    value: float = 0.0
    yes: bool = False
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.yes)
        low = x[:, self.feature] <= self.value
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A decision tree by Gini impurity, cuts halfway between neighbouring values, ``LEAST_LEAF`` blocks on either side."""
    if depth == 0 or y.all() or not y.any():
        return Node(yes=bool(y.mean() >= 0.5))
    best = (2.0, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= v
            if min(low.sum(), (~low).sum()) < LEAST_LEAF:
                continue
            cost = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low)) * 2 / len(y)
            best = min(best, (cost, f, float(v)))
    if best[1] < 0:
        return Node(yes=bool(y.mean() >= 0.5))
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], False, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@cache
def tree() -> Node:
    """The tree, trained on the labelled pages."""
    xs, ys = [], []
    for html, labels in LABELLED:
        found = blocks(html)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {html[:60]}")
        xs.append(features(found))
        ys += labels
    return grow(np.concatenate(xs), np.array(ys, bool))


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by one space; empty if there is none."""
    found = blocks(html or "")
    if not found:
        return ""
    keep = tree().predict(features(found))
    return " ".join(w for b, k in zip(found, keep, strict=True) if k for w in b.words)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] | None = None) -> DataFrame:
    """(r, text, n_chars): every row with its main text and the text's code points.

    Null and empty pages give the empty text.  Nothing is dropped or cut:
    repeated rows and null keys come out as they came.  ``r`` has the columns
    ``carry``, whatever their names.
    """
    carry = tuple(pages.columns) if carry is None else carry

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py()) for h in html], pa.string())

    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("r"), text(F.col(f"`{html_col}`")).alias("text"))
    return rows.select("r", "text", F.length("text").cast("long").alias("n_chars"))
