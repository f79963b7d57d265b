"""HTML extraction by two-pass block rules.

A page is cut into text blocks at block-level tags.  Markup names some of
them as no main text at once (menus, footers, forms, adverts, comments ...,
by tag, class, id or role).  The first pass decides the others by length,
stop-word density and link density; short blocks that it cannot decide
inherit, in the second pass, the label of the nearest decided neighbours.
If the page marks an article, only its blocks count, and its short blocks
look at neighbours inside the article alone.

Character references are decoded, white space inside a block becomes one
space, and the kept blocks are joined by a line break in page order.
Null or empty html and pages without main text give the empty string.
Pages of any length are read whole, in time that follows their length; broken or cut markup is read as far as
it goes, and an element that is never closed hides nothing after it (script, style, title and textarea apart).
Repeated rows are extracted alike, equal neighbours stay, an empty table stays empty, and other columns are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_or_empty, texts_of

#: Names of HTML elements and of common classes.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    option p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
HIDDEN_TAGS = frozenset("""aside button datalist dialog fieldset footer form head label legend menu nav option search
    select title""".split())
SKIPPED_TAGS = frozenset("""audio canvas iframe math noembed noframes noscript object script style svg template
    textarea title video xmp""".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 title".split())
HIDDEN_NAMES = frozenset("""ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs
    comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar
    navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related
    replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser
    toolbar widget""".split())
HIDDEN_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation
    search status toolbar""".split())
CONTENT_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
#: Elements that a new element of the given kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset("""a about all an and are as at be but by can for from had has have he her his i in is it its
    not of on or she that the their they this to was we were which will with you
    aber als am auch auf aus bei das dass dem den der des die du ein eine einen einer er es für hat ich im ist man mit
    nach nicht noch nur oder sich sie sind so über um und uns von war was wenn werden wie wir zu zum zur
    au aux avec ce ces cette dans de elle en est et eu il ils je la le les leur mais même ne nous on ou où par pas pour
    plus qu que qui sa se ses son sont sur un une vous y
    al como con del e el ella ellos entre era esta este fue ha hay la las lo los más me mi muy no o para pero por que se
    ser si sin sobre su sus también un una uno unos""".split())

#: Words of a block that is long, of one that is short, and the densities of the first pass.
LONG, SHORT, STOP_DENSITY, LINK_DENSITY = 20, 8, 0.12, 0.5

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """Text between two block boundaries and where it stands."""

    text: str
    hidden: bool
    article: int  # number of the outermost article around it, or 0
    content: bool  # within an element whose name says content
    heading: bool
    linked: int  # characters inside links


@dataclass
class _Open:
    name: str
    hidden: bool
    article: int
    content: bool
    heading: bool = False  # itself or an element around it


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _named(attrs: dict[str, str]) -> set[str]:
    """Parts of the element's class and id, in lower case."""
    words = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return {p.lower() for p in _NAME_PARTS.findall(words)} | {w.lower() for w in words.split()}


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order, blanks normalised, empty ones left out."""
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    opened: Counter[str] = Counter()  # names on the stack
    unclosed: set[str] = set()  # names that no end tag closes from here on
    ends: dict[str, dict[int, int]] = {}
    parts: list[tuple[str, bool]] = []
    articles, link_depth, at = 0, 0, 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join(unescape("".join(p for p, _ in parts)).split())
        if text:
            top = stack[-1]
            linked = sum(len("".join(unescape(p).split())) for p, in_link in parts if in_link)
            out.append(Block(text, top.hidden, top.article, top.content, top.heading, linked))
        parts.clear()

    def cut(depth: int) -> None:
        for gone in stack[depth:]:
            opened[gone.name] -= 1
        del stack[depth:]

    while True:
        found = _MARKUP.search(html, at)
        end = found.start() if found else len(html)
        if end > at:
            parts.append((html[at:end], link_depth > 0))
        if not found:
            break
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            if found["cdata"]:
                parts.append((found["cdata"], link_depth > 0))
            continue
        if found["close"]:
            if name == "a":
                link_depth = 0
            elif name in BLOCK_TAGS:
                flush()
                if opened[name]:
                    cut(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name))
                link_depth = min(link_depth, len(stack))
            continue
        if name in SKIPPED_TAGS:
            if name == "title":
                flush()
            raw = name in ("script", "style", "title", "textarea")
            if (raw or not found["attrs"].rstrip().endswith("/")) and name not in unclosed:
                over = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
                if over:
                    at = over.end()
                elif raw:
                    at = len(html)
                else:
                    unclosed.add(name)
            continue
        if name == "a":
            link_depth = len(stack)
            continue
        if name in EMPTY_TAGS:
            if name in ("br", "wbr"):
                parts.append((" " if name == "br" else "", False))
            elif name == "hr":
                flush()
            continue
        attrs = found["attrs"]
        marked = bool(attrs) and re.search(r"class|id|role|hidden|style", attrs, re.IGNORECASE) is not None
        if name not in BLOCK_TAGS and not marked:
            continue
        own = _attributes(attrs) if marked else {}
        names = _named(own) if own else set()
        hides = (name in HIDDEN_TAGS or not names.isdisjoint(HIDDEN_NAMES)
                 or own.get("role", "").lower() in HIDDEN_ROLES or "hidden" in own
                 or own.get("aria-hidden", "").lower() == "true"
                 or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I) is not None)
        if name not in BLOCK_TAGS:
            if hides and not attrs.rstrip().endswith("/"):  # an inline element that markup hides
                if name not in ends:
                    ends[name] = _matching_ends(html, name)
                at = ends[name].get(at, at)
            continue
        flush()
        if any(opened[other] for other in CLOSES.get(name, ())):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in CLOSES[name]:
                    cut(depth)
                    break
                if stack[depth].name in ("ul", "ol", "dl", "table", "select"):
                    break
        while stack[-1].name == "p" or (stack[-1].name in HEADINGS and name in HEADINGS):
            cut(len(stack) - 1)  # a paragraph ends where the next block starts
        top = stack[-1]
        if name == "header" and not top.article and not top.content:
            hides = True
        if name == "body" and not opened["body"]:
            stack[1:] = [o for o in stack[1:] if o.name == "html"]
            opened = Counter(o.name for o in stack[1:])
            top = stack[-1]
            hides = False
        article = top.article
        if name in ("article", "main") and not hides and not top.hidden and not article:
            articles += 1
            article = articles
        stack.append(_Open(name, top.hidden or hides, article,
                           top.content or (not hides and not names.isdisjoint(CONTENT_NAMES)),
                           top.heading or name in HEADINGS))
        opened[name] += 1
    flush()
    return out


def _matching_ends(html: str, name: str) -> dict[int, int]:
    """For each start tag of an element, by the place behind it, the place behind the end tag that matches it."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    for tag in re.compile(rf"<(/?){re.escape(name)}\b[^>]*+>", re.IGNORECASE).finditer(html):
        if not tag[1]:
            waiting.append(tag.end())
        elif waiting:
            out[waiting.pop()] = tag.end()
    return out


def _decide(block: Block, inside: bool) -> bool | None:
    """First pass: main text (True), not (False), or too short to tell (None)."""
    if block.hidden:
        return False
    words = [w.strip(".,;:!?\"'()[]|*$%&#").lower() for w in block.text.split()]
    stop = sum(w in STOP_WORDS for w in words) / len(words)
    link = block.linked / max(1, len(block.text.replace(" ", "")))
    if link > LINK_DENSITY:
        return None if inside and len(words) < LONG else False
    if len(words) < SHORT or block.heading:
        return None
    if stop >= STOP_DENSITY or (len(words) >= LONG and (inside or link < 0.2)):
        return True
    return None


def main_text(html: str) -> str:
    """The kept blocks, joined by line breaks."""
    found = blocks(html)
    shown = [b for b in found if not b.hidden]
    if any(b.article for b in shown):
        chosen, inside = [b for b in shown if b.article], True
    elif any(b.content for b in shown):
        chosen, inside = [b for b in shown if b.content], True
    else:
        chosen, inside = found, False
    labels = [_decide(b, inside) for b in chosen]
    return "\n".join(b.text for b, keep in zip(chosen, _inherit(chosen, labels, inside), strict=True) if keep)


def _inherit(found: list[Block], labels: list[bool | None], inside: bool) -> list[bool]:
    """Second pass: undecided blocks take the label of the nearest decided ones before and behind.

    Where the two differ the nearer one counts, and at equal distance the text is
    kept; a heading looks ahead first.  With no decided block at all, the
    blocks of an article are its text and others are not.
    """
    n = len(labels)
    before: list[tuple[int, bool] | None] = [None] * n
    behind: list[tuple[int, bool] | None] = [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if labels[i] is not None:
            last = (i, labels[i])
    last = None
    for i in range(n - 1, -1, -1):
        behind[i] = last
        if labels[i] is not None:
            last = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label is None:
            a, b = before[i], behind[i]
            if a is None and b is None:
                label = inside
            elif a is None or b is None:
                label = (a or b)[1] or inside
            elif a[1] == b[1]:
                label = a[1]
            elif found[i].heading:
                label = b[1]
            else:
                label = a[1] if i - a[0] < b[0] - i else b[1] if b[0] - i < i - a[0] else True
        out.append(bool(label))
    return out


def main_text_column(html: str | Column) -> Column:
    """:func:`main_text` of a column (string)."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p) for p in texts_of(pages)], pa.string())

    return extract(text_or_empty(html))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns of these names are replaced."""
    return (pages.withColumn("text", main_text_column(html))
            .withColumn("n_chars", F.length("text").cast("long")))
