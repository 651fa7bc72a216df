"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count and link density, those of
the blocks before and after it, where it stands, and whether it is a heading or list item. A decision tree, grown once from
the labelled table below, tells article text from the rest: where a block stands is one feature among these, so link-dense blocks
in an article's container go, and long running text outside of it stays.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content isn't page text.
SILENT = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button datalist noframes noembed xmp".split())
#: Tags without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is beside the article.
BESIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts of class, id and role names that say the same.
BESIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar sidenav aside footer foot header masthead topbar "
    "cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer hidden complementary contentinfo "
    "breaking trending popular teaser byline".split()
)
MAIN_NAMES = frozenset("article post entry story content main".split())

#: Where a block stands: in something beside the article; outside any container of the article, on a page that has one; on a page without one; in one.
BESIDE_IT, OUTSIDE, NOWHERE, WITHIN = range(4)

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading", "items")

#: The labelled table: blocks of invented pages, by features in that order, and whether they are article text.
TABLE = (
    # inside an article, main or content-named container
    (60, 0.0, 8, 0.0, 45, 0.0, 3, 0, 0, 1), (45, 0.02, 60, 0.0, 30, 0.0, 3, 0, 0, 1), (8, 0.0, 12, 0.0, 60, 0.0, 3, 1, 0, 1), (2, 0.0, 30, 0.0, 25, 0.0, 3, 0, 0, 1),
    (1, 0.0, 5, 0.0, 3, 0.0, 3, 0, 0, 1), (5, 0.0, 1, 0.0, 2, 0.0, 3, 0, 0, 1), (25, 0.5, 40, 0.0, 20, 0.0, 3, 0, 0, 1), (3, 1.0, 30, 0.0, 50, 0.0, 3, 0, 0, 0),
    (12, 0.0, 1, 1.0, 1, 0.0, 3, 1, 0, 1), (7, 0.0, 20, 0.0, 9, 0.0, 3, 0, 1, 1), (9, 0.0, 7, 0.0, 40, 0.0, 3, 0, 1, 1), (120, 0.01, 2, 0.0, 12, 0.3, 3, 0, 0, 1),
    (30, 0.0, 25, 0.0, 14, 0.1, 3, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 3, 0, 0, 1), (15, 0.0, 9, 0.0, 0, 0.0, 3, 0, 0, 1), (3, 0.0, 10, 0.0, 5, 1.0, 3, 0, 0, 1),
    (1, 0.0, 2, 0.0, 2, 1.0, 3, 0, 0, 1), (10, 0.0, 3, 0.0, 1, 1.0, 3, 0, 0, 1), (14, 0.0, 20, 0.0, 3, 0.9, 3, 0, 0, 1), (2, 1.0, 4, 0.0, 2, 1.0, 3, 0, 1, 0),
    (5, 1.0, 1, 1.0, 1, 1.0, 3, 0, 1, 0), (40, 0.9, 6, 0.0, 80, 0.0, 3, 0, 0, 1), (6, 0.0, 2, 1.0, 4, 1.0, 3, 1, 0, 1), (1, 1.0, 0, 0.0, 0, 0.0, 3, 0, 0, 0),
    (22, 0.0, 1, 1.0, 9, 0.8, 3, 0, 0, 1), (70, 0.0, 3, 1.0, 2, 1.0, 3, 0, 0, 1), (4, 0.6, 15, 0.0, 6, 0.7, 3, 0, 0, 0), (9, 0.0, 40, 0.5, 40, 0.5, 3, 0, 0, 1),
    (55, 0.7, 5, 1.0, 3, 1.0, 3, 0, 0, 1), (3, 0.0, 7, 0.9, 60, 0.0, 3, 1, 0, 1), (4, 1.0, 60, 0.0, 55, 0.0, 3, 0, 0, 0), (2, 1.0, 40, 0.0, 12, 0.0, 3, 0, 0, 0),
    (9, 0.9, 20, 0.0, 70, 0.0, 3, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 3, 0, 1, 0), (12, 0.7, 35, 0.1, 30, 0.0, 3, 0, 0, 0), (16, 0.65, 9, 0.0, 4, 0.0, 3, 0, 0, 0),
    (6, 1.0, 0, 0.0, 80, 0.0, 3, 0, 0, 0), (3, 0.67, 3, 0.0, 2, 0.0, 3, 0, 1, 0), (30, 0.8, 50, 0.0, 40, 0.0, 3, 0, 0, 1), (20, 0.65, 25, 0.0, 3, 0.0, 3, 0, 0, 1),
    (6, 0.5, 30, 0.0, 25, 0.0, 3, 0, 0, 1), (14, 0.55, 8, 1.0, 40, 0.0, 3, 0, 0, 1), (7, 1.0, 40, 0.0, 60, 0.0, 3, 1, 0, 1), (3, 1.0, 5, 1.0, 2, 1.0, 3, 1, 0, 1),
    (2, 0.5, 6, 0.0, 9, 0.0, 3, 0, 1, 1), (10, 0.45, 2, 1.0, 1, 1.0, 3, 0, 0, 1), (19, 1.0, 30, 0.0, 22, 0.0, 3, 0, 0, 1),
    # marked as beside the article
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 14, 0.0, 0, 0, 1, 0), (11, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0),
    (40, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0), (14, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0), (30, 0.0, 12, 0.0, 45, 0.0, 0, 0, 0, 0), (6, 0.0, 80, 0.0, 20, 0.0, 0, 1, 0, 0),
    (55, 0.0, 30, 0.0, 60, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 1, 0, 0), (18, 0.1, 22, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 1, 0),
    (90, 0.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0), (12, 1.0, 30, 0.0, 5, 0.5, 0, 0, 1, 0), (25, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (40, 0.0, 60, 0.0, 10, 0.0, 0, 0, 0, 0),
    (12, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0),
    # outside on a page that has such a container
    (10, 0.0, 0, 0.0, 50, 0.0, 1, 0, 0, 0), (35, 0.0, 60, 0.0, 8, 0.9, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 70, 0.0, 1, 0, 0, 0), (6, 0.0, 10, 0.0, 50, 0.0, 1, 1, 0, 0),
    (80, 0.0, 55, 0.0, 9, 0.0, 1, 0, 0, 1), (50, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0), (16, 0.0, 30, 0.0, 30, 0.0, 1, 1, 0, 0), (1, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0),
    (120, 0.0, 1, 0.0, 0, 0.0, 1, 0, 0, 1), (110, 0.02, 9, 0.0, 95, 0.0, 1, 0, 0, 1), (90, 0.05, 100, 0.0, 8, 0.0, 1, 0, 0, 1), (75, 0.0, 3, 1.0, 60, 0.0, 1, 0, 0, 1),
    (20, 0.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0), (28, 0.0, 3, 1.0, 1, 1.0, 1, 0, 0, 0), (15, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0, 0), (32, 0.0, 8, 0.0, 12, 0.9, 1, 0, 0, 0), (24, 0.1, 90, 0.0, 5, 0.7, 1, 0, 0, 0),
    (55, 0.0, 10, 0.0, 12, 0.0, 1, 0, 0, 0), (60, 0.0, 20, 0.0, 30, 0.0, 1, 0, 0, 0), (48, 0.0, 2, 1.0, 70, 0.0, 1, 0, 0, 0), (62, 0.0, 60, 0.0, 2, 1.0, 1, 0, 0, 0), (18, 0.0, 15, 0.0, 20, 0.0, 1, 0, 0, 0),
    (140, 0.1, 2, 1.0, 3, 1.0, 1, 0, 0, 1), (80, 0.6, 4, 1.0, 6, 0.8, 1, 0, 0, 0), (95, 0.5, 40, 0.0, 3, 1.0, 1, 0, 0, 0),
    # pages without one: long text, and what stands between
    (60, 0.0, 8, 0.0, 45, 0.0, 2, 0, 0, 1), (45, 0.05, 60, 0.0, 30, 0.0, 2, 0, 0, 1), (30, 0.1, 45, 0.0, 25, 0.0, 2, 0, 0, 1), (22, 0.0, 35, 0.0, 12, 0.0, 2, 0, 0, 1),
    (16, 0.0, 60, 0.0, 3, 1.0, 2, 0, 0, 1), (7, 0.0, 2, 1.0, 60, 0.0, 2, 1, 0, 1), (5, 0.0, 50, 0.0, 48, 0.0, 2, 0, 0, 1), (3, 0.0, 40, 0.0, 30, 0.0, 2, 0, 0, 1),
    (6, 0.0, 38, 0.0, 44, 0.0, 2, 1, 0, 1), (9, 0.0, 30, 0.0, 10, 0.0, 2, 0, 1, 1), (28, 0.0, 4, 1.0, 5, 1.0, 2, 0, 0, 1), (100, 0.02, 0, 0.0, 0, 0.0, 2, 0, 0, 1),
    (2, 0.0, 1, 1.0, 60, 0.0, 2, 1, 0, 1), (4, 0.0, 0, 0.0, 90, 0.0, 2, 1, 0, 1), (3, 0.0, 1, 1.0, 45, 0.0, 2, 1, 0, 1), (2, 0.0, 2, 1.0, 60, 0.0, 2, 1, 0, 1),
    (5, 0.0, 6, 1.0, 70, 0.0, 2, 1, 0, 1), (3, 0.0, 3, 1.0, 2, 1.0, 2, 1, 0, 0), (2, 0.0, 5, 0.0, 3, 1.0, 2, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 1, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 2, 0, 0, 0), (4, 0.75, 3, 1.0, 50, 0.0, 2, 0, 0, 0), (6, 0.0, 2, 1.0, 3, 1.0, 2, 0, 0, 0), (3, 0.0, 1, 1.0, 4, 0.5, 2, 1, 0, 0),
    (12, 0.9, 4, 0.0, 12, 0.9, 2, 0, 0, 0), (20, 0.7, 5, 0.5, 18, 0.8, 2, 0, 1, 0), (30, 0.6, 60, 0.0, 25, 0.7, 2, 0, 0, 0),
    # there, short text has text beside it on both sides; what stands among links or has nothing after them is no article
    (1, 0.0, 60, 0.0, 1, 0.0, 2, 0, 0, 1), (2, 0.0, 11, 0.0, 2, 0.0, 2, 1, 0, 1), (5, 0.0, 70, 0.0, 4, 0.0, 2, 0, 0, 1), (4, 0.0, 7, 0.0, 4, 0.0, 2, 1, 0, 1), (1, 0.0, 9, 0.0, 1, 0.0, 2, 1, 0, 1),
    (9, 0.0, 26, 0.0, 2, 0.0, 2, 0, 0, 1), (2, 0.0, 95, 0.0, 3, 0.0, 2, 0, 0, 1), (8, 0.0, 2, 0.0, 4, 0.0, 2, 0, 0, 1), (3, 0.0, 4, 0.0, 9, 0.0, 2, 0, 0, 1), (10, 0.1, 8, 0.0, 3, 0.1, 2, 0, 0, 1),
    (2, 0.0, 42, 0.05, 0, 0.0, 3, 0, 0, 1), (6, 0.0, 60, 0.0, 0, 0.0, 3, 0, 0, 1), (9, 0.0, 50, 0.0, 0, 0.0, 2, 0, 0, 1), (5, 0.0, 30, 0.0, 0, 0.0, 2, 0, 0, 1), (3, 0.0, 8, 0.0, 0, 0.0, 3, 0, 0, 1),
    (35, 0.0, 3, 1.0, 0, 0.0, 2, 0, 0, 1), (70, 0.0, 2, 1.0, 0, 0.0, 2, 0, 0, 1), (14, 0.0, 2, 1.0, 0, 0.0, 2, 0, 0, 0), (4, 0.0, 3, 0.9, 0, 0.0, 2, 0, 0, 0), (5, 0.0, 1, 1.0, 1, 1.0, 2, 0, 0, 0), (8, 0.0, 1, 1.0, 2, 1.0, 2, 0, 0, 0), (10, 0.0, 2, 1.0, 1, 1.0, 2, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 2, 1, 0, 0),
    (7, 0.0, 3, 0.8, 2, 0.7, 2, 0, 0, 0), (3, 0.1, 4, 1.0, 2, 1.0, 2, 0, 1, 0), (30, 0.0, 1, 1.0, 2, 1.0, 2, 0, 0, 1), (40, 0.1, 2, 1.0, 40, 0.0, 2, 0, 0, 1), (6, 0.0, 40, 0.0, 2, 1.0, 2, 0, 0, 1),
)


def grow(rows: list[tuple[float, ...]], depth: int = 8):
    """A decision tree by Gini impurity: (feature, threshold, low, high), or the share of label 1 in a leaf."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return ones / len(rows)
    gini = lambda part: len(part) - (sum(r[-1] for r in part) ** 2 + (len(part) - sum(r[-1] for r in part)) ** 2) / len(part)
    best = None
    for k in range(len(rows[0]) - 1):
        values = sorted({r[k] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            cost = gini(low) + gini(high)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, k, cut, low, high)
    if best is None:
        return ones / len(rows)
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@lru_cache(maxsize=1)
def default_tree():
    return grow(list(TABLE))


def decide(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


_PIECE = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<more>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _names(more: str) -> set[str]:
    found: set[str] = set()
    for m in _NAMED.finditer(more):
        value = m[2] or m[3] or m[4] or ""
        found.update(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
    return found


class _Block:
    __slots__ = ("pieces", "links", "beside", "inside", "heading", "items", "words", "linked", "text")

    def __init__(self, beside: bool, inside: bool, heading: bool, items: bool):
        self.pieces, self.links = [], []
        self.beside, self.inside, self.heading, self.items = beside, inside, heading, items


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page, in order."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, beside, inside
    link, heading, items, now, at = 0, False, False, None, 0
    lower = None
    size = len(page)
    while at < size:
        m = _PIECE.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if now is None:
                if text.isspace():
                    continue
                beside, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                now = _Block(beside, inside, heading, items)
                out.append(now)
            decoded = html.unescape(text) if "&" in text else text
            now.pieces.append(decoded)
            if link:
                now.links.append(decoded)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                link = 0
            elif tag in BLOCK:
                now = None
                if tag[0] == "h" and tag[1:].isdigit():
                    heading = False
                elif tag == "li":
                    items = False
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            link = 0
                            break
            continue
        if tag in SILENT and not m["more"].rstrip().endswith("/"):
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a letter that grows when lower-cased
                lower = re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            at = size if end < 0 else end
            if tag in BLOCK:
                now = None
            continue
        if tag == "br":
            if now is not None:
                now.pieces.append(" ")
            continue
        if tag == "a":
            link = 1
        if tag in BLOCK:
            now = None
            if tag[0] == "h" and tag[1:].isdigit():
                heading = True
            elif tag == "li":
                items, heading = True, False
            elif tag not in VOID and tag != "p":
                heading = False
                beside, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                more = m["more"]
                names = _names(more) if "=" in more else set()
                if tag in ("article", "main"):
                    inside = True
                    # an article that is itself a comment or a teaser is still beside
                    beside = beside or bool(names & BESIDE_NAMES and not names & MAIN_NAMES)
                elif tag not in ("html", "body"):
                    beside = beside or tag in BESIDE or (tag == "header" and not inside) or bool(names & BESIDE_NAMES)
                    if not beside and tag in ("div", "section") and names & MAIN_NAMES and not names & BESIDE_NAMES:
                        inside = True
                beside = beside or bool(more and _HIDDEN.search(more))
                stack.append((tag, beside, inside))
            else:
                heading = False if tag == "p" else heading
    kept = []
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
        if b.text:
            b.words = b.text.count(" ") + 1
            b.linked = len(" ".join(b.links).split()) / b.words
            kept.append(b)
    return kept


def rows_of(page: str) -> list[tuple[str, tuple[float, ...]]]:
    """Each block's text and features."""
    found = blocks(page)
    # where everything is marked as beside, or nothing else than links isn't, marks tell nothing
    marked = any(not b.beside and b.linked < 0.5 for b in found)
    for b in found:
        b.beside = b.beside and marked
    other = OUTSIDE if any(b.inside for b in found) else NOWHERE
    around = [(0, 0.0), *((b.words, min(1.0, b.linked)) for b in found), (0, 0.0)]
    place = [BESIDE_IT if b.beside else WITHIN if b.inside else other for b in found]
    return [(b.text, (*around[k + 1], *around[k], *around[k + 2], place[k], int(b.heading), int(b.items))) for k, b in enumerate(found)]


def extract(page: str | None, tree=None) -> str:
    """The article's blocks, joined by line breaks; empty for null and for pages without one."""
    tree = default_tree() if tree is None else tree
    return "\n".join(text for text, row in rows_of(page or "") if decide(tree, row))


def main_text(pages: DataFrame, html_col: str = "html", tree=None) -> DataFrame:
    """The rows of `pages` with text and n_chars (code points) in place of the html.

    Null and empty pages give an empty text; unclosed tags and comments end with the page. Repeated rows repeat; an
    empty table gives an empty result. Columns of `pages` named text or n_chars are replaced; others stay.
    """
    tree = default_tree() if tree is None else tree
    run = F.pandas_udf(lambda found: pd.Series([extract(x, tree) for x in found], dtype=object), "string")
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*kept, run(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
