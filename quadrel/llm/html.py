"""Main text of HTML pages by two-pass block rules.

Blocks are the texts between block-level tags. Containers go first: menus, headers, footers, sidebars, forms, adverts,
notices and comments are out, and with an article or main element all that is outside it. The first pass judges every
other block by link density, length and stop-word density: link-dense ones are out, long ones with the stop words of
running text are in, long ones without any are out unless they stand in an article; headings and short or middling blocks
stay undecided. In the second pass these take the label of the nearest decided block, in or out, before or after them
among the judged blocks of the same article (of equals, in wins); the ends of an article count as decided text, and a page on which nothing is decided is kept. Both
passes are single sweeps, and tags are scanned in linear time.

References are decoded, white space inside a block becomes one space, blocks are joined by two line feeds in page order.
Defined cases: null and empty html give ''; unclosed elements end with the one around them; an element whose text is
skipped (button, select, svg, ...) and that has no end tag before the next of its kind skips only its own tag, and an
unclosed script, style or comment reaches to the end; a tag that never ends is cut at the next '>' whatever its quotes, and
without one it is text, as is a '<' that opens no tag; equal pages give equal texts and repeated rows are rows of
their own; pages of any length and depth are scanned whole; of blocks at equal distance the one that is in counts; an
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import lean
from .common import table

LINKS, SHORT, STOPS_HIGH, STOPS_LOW = 0.4, 70, 0.25, 0.1
#: Link density from which a block of an article is out at once.
LINKED = 0.9
#: Function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its no not of on or she so that the their there they this to was we were what when which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "aber als am an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nicht noch nur sich sie sind über um und uns von vor war wie wird zu zum zur "
    "al como con del el entre era es esta fue ha hay las lo los más mi muy no o para pero por porque se sin sobre su sus también todo y ya".split()
)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name: quotes are strings only after '='.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mrow ms mspace msqrt mroot mstyle msub msup "
    "msubsup mtext munder munderover nobr q s samp semantics small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is skipped to their end tag; the second kind to the end of the page where there is none.
_SKIPPED = frozenset("title textarea noscript template iframe object svg select datalist button canvas audio video annotation annotation-xml".split())
_ENDLESS = frozenset(("script", "style"))
_OUT = frozenset("nav footer aside form dialog menu".split())
#: An open one at the top ends when the next begins.
_ITEMS = frozenset("li dt dd tr td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Parts of class names and ids of what is no main text.
_HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations widget pagination pager toolbar search skip hidden copyright legal disclaimer topbar".split()
)
_PARTS = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_NEXT = {tag: re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*+>?+", re.I) for tag in _SKIPPED | _ENDLESS}
IN, OUT, OPEN = 1, 0, 2


class Block:
    """parts: raw texts; linked: characters within links; out: in a container that is out; main: number of its article, 0 outside."""

    __slots__ = ("parts", "linked", "out", "main", "heading")

    def __init__(self, out: bool, main: int, heading: bool):
        self.parts, self.linked, self.out, self.main, self.heading = [], 0, out, main, heading


def _outside(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in _OUT or tag == "header" and not in_main:
        return True
    if not attrs.strip():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            parts = _PARTS.split(value)
            if not _HINTS.isdisjoint(parts) or "header" in parts and not in_main:
                return True
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def tokens(html: str):
    """(text, closing, tag, attributes) in page order: each tag with the text before it; a last one with tag ''."""
    said, at, end, blind = 0, html.find("<"), len(html), False
    while 0 <= at:
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            yield html[said:at], "", "!", ""
            said = end if stop < 0 else stop + 3
        elif html[at + 1 : at + 2] in ("!", "?"):
            stop = html.find(">", at)
            if stop < 0:
                break
            yield html[said:at], "", "!", ""
            said = stop + 1
        elif m := _NAME.match(html, at + 1):
            rest = None if blind else _REST.match(html, m.end())
            stop = rest.end() if rest else html.find(">", m.end()) + 1
            blind |= rest is None  # an open quote runs to the end of the page: from here on it counts for nothing
            if not stop:
                break
            tag = m[2].lower()
            yield html[said:at], m[1], tag, html[m.end() : stop - 1]
            said = stop
            if not m[1] and tag in _NEXT:
                close = _NEXT[tag].search(html, stop)
                if close and close[1]:
                    said = close.end()
                elif tag in _ENDLESS:
                    said = _NEXT_CLOSE[tag](html, stop, end)
        else:
            at = html.find("<", at + 1)
            continue
        at = html.find("<", said)
    yield html[said:], "", "", ""


def _close_of(tag: str):
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?+", re.I)

    def found(html: str, at: int, end: int) -> int:
        m = close.search(html, at)
        return m.end() if m else end

    return found


_NEXT_CLOSE = {tag: _close_of(tag) for tag in _ENDLESS}


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, out, number of the main element, in the header of an article
    opened: Counter[str] = Counter()
    out, main, header, mains, heading = False, 0, False, 0, False
    linked = -1  # depth of the stack at the open link
    hushed: list[str] = []  # open inline elements from one that is out
    block = Block(False, 0, False)

    def pop(k: int) -> None:
        nonlocal out, main, header, linked
        _, out, main, header = stack[k]
        for t, *_ in stack[k:]:
            opened[t] -= 1
        del stack[k:]
        if linked > k:
            linked = -1

    for text, closing, tag, attrs in tokens(html):
        if text and not hushed:
            block.parts.append(text)
            if linked >= 0:
                block.linked += len(text.strip())
        if tag == "!":
            continue
        if tag in _INLINE:
            if hushed:
                if closing and tag == hushed[-1]:
                    hushed.pop()
                elif not closing and tag == hushed[0]:
                    hushed.append(tag)
            elif tag == "a":
                linked = -1 if closing else len(stack)
            elif tag == "br":
                block.parts.append(" ")
            elif not closing and attrs and tag not in _VOID and not attrs.endswith("/") and _outside(tag, attrs, bool(main)):
                hushed.append(tag)
            continue
        if tag in _SKIPPED and tag not in ("title", "template", "noscript"):
            continue
        hushed.clear()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
        elif tag not in _VOID and tag not in ("p", "html", "body", "head", "script", "style", "title", "template", "noscript", ""):
            if tag in _ITEMS and stack and stack[-1][0] == tag:
                pop(len(stack) - 1)
            stack.append((tag, out, main, header))
            opened[tag] += 1
            if tag in ("article", "main") and not out and not _outside(tag, attrs, True):
                if not main:
                    mains += 1
                    main = mains
            elif _outside(tag, attrs, bool(main)):
                out = True
            elif tag == "header":
                header = True
        if block.parts:
            found.append(block)
        block = Block(out or header and not heading, main, heading)
    return found


def judged(n: int, link: float, stops: float, words: int, heading: bool, in_main: bool) -> int:
    """The first pass: IN, OUT or OPEN for a block of n characters."""
    if link > LINKS:
        return OPEN if in_main and link < LINKED else OUT
    if heading or n < SHORT:
        return OPEN
    if stops >= STOPS_HIGH:
        return IN
    return OUT if words and stops < STOPS_LOW and not in_main else OPEN


def inherited(labels: list[int], edge: int | None) -> list[int]:
    """The second pass over the judged blocks of one article (edge: the label of its ends) or page (None): every OPEN
    one takes the label of the nearest decided one. Without any decided one, and no edge, nothing speaks against it."""
    n = len(labels)
    if edge is None and IN not in labels and OUT not in labels:
        return [IN] * n
    far = n + 2
    before: list[tuple[int, int]] = []
    at, label = (-1, edge) if edge is not None else (-far, OUT)
    for i, x in enumerate(labels):
        if x != OPEN:
            at, label = i, x
        before.append((i - at, label))
    out = [OUT] * n
    at, label = (n, edge) if edge is not None else (n + far, OUT)
    for i in range(n - 1, -1, -1):
        if labels[i] != OPEN:
            at, label = i, labels[i]
        gap, other = before[i]
        out[i] = other if gap < at - i else label if at - i < gap else IN if IN in (other, label) else OUT
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    has_main = any(b.main for b in found)
    texts: list[str] = []
    groups: dict[int, tuple[list[int], list[int]]] = {}  # by article: places and labels of the judged blocks
    for b in found:
        text = " ".join(unescape("".join(b.parts)).split())
        if not text or b.out or has_main and not b.main:
            continue
        words = _WORD.findall(text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        places, labels = groups.setdefault(b.main, ([], []))
        places.append(len(texts))
        labels.append(judged(len(text), b.linked / len(text), stops, len(words), b.heading, bool(b.main)))
        texts.append(text)
    kept = sorted(p for main, (places, labels) in groups.items() for p, x in zip(places, inherited(labels, IN if main else None), strict=True) if x == IN)
    return "\n\n".join(texts[p] for p in kept)


@lean
def _texts(batches):
    for batch in batches:
        text = [main_text(h) for h in batch.column("html").to_pylist()]
        cols = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    return pages.selectExpr("cast(page_id as bigint) AS page_id", "url", "html").mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
