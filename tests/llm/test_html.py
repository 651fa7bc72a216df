"""Main text of pages written for the test."""

import random
from html.parser import HTMLParser

import pytest

from lectern.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now</div><article><h1>Head &amp; line</h1><p><b>Bold lead.<br><p>First  para&nbsp;graph with a <a href="l">link</a>.</p><p>Two<br>lines &#x41; &lt;tag&gt;</p>
<aside>Aside text</aside><form><label>Mail</label><input></form><ul><li>one<li>two</ul></article><div class="sidebar">Side</div>
<section id="comments"><p>I liked it very much, a long comment with many words in it, really.</p></section><footer>&copy; me</footer>"""


TEXT = "Head & line\nBold lead.\nFirst para graph with a link.\nTwo lines A <tag>\none\ntwo"


def test_article():
    assert H.extract(PAGE) == TEXT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("<article>x", "x"), ("<article><p>a<script>b", "a"), ("<article>a<!-- b", "a"), ("<article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"), ("<article><p a='>'>q</p>", "q")])
def test_odd_pages(page, text):
    assert H.extract(page) == text


def test_pages_without_article_element():
    long = "word " * 60
    page = f"<div><a href=1>a</a> <a href=2>b</a></div><h2>Head line</h2><p>{long}</p><p>short.</p><p>{long}</p><ul><li><a href=3>x</a></li><li><a href=4>y</a></li></ul>"
    assert H.extract(page) == f"Head line\n{long.strip()}\nshort.\n{long.strip()}"


def test_tree_fits_its_table():
    tree = H.default_tree()
    assert all(H.decide(tree, r[:-1]) == bool(r[-1]) for r in H.TABLE)


def test_links_decide_inside_an_article():
    long = ("word " * 40).strip()
    page = f"<article><h2><a href=t>Linked title</a></h2><p>{long}</p><p><a href=1>Buy now</a> <a href=2>Click here</a></p><ul><li><a href=3>Home</a></li><li><a href=4>News</a></li></ul><p>{long} <a href=5>a link</a></p><p>Short.</p></article>"
    assert H.extract(page) == f"Linked title\n{long}\n{long} a link\nShort."


def test_long_text_outside_a_container_stays():
    long = ("word " * 120).strip()
    page = f"<div class=story>Teaser</div><p>{long}</p><p>Cookies are used here.</p><div class=sidebar><p>{long}</p></div>"
    assert H.extract(page) == f"Teaser\n{long}"


def test_neighbours_decide():
    text, link = "word " * 40, "<p><a href=x>some link text</a></p>"
    paragraphs = lambda *parts: "".join(p if p.startswith("<") else f"<p>{p}</p>" for p in parts)
    # the same short block among text, among links and at the end of links
    assert H.extract(paragraphs(text, "Six words stand here among text.", text)).count("\n") == 2
    assert H.extract(paragraphs(text, link, "Six words stand here among links.", link, text)) == f"{text.strip()}\n{text.strip()}"
    assert H.extract(paragraphs(text, text, link, "Six words stand at the end.")) == f"{text.strip()}\n{text.strip()}"
    # the same text outside of an article: a notice, unless it is as long as text of its own
    notice = "notice " * 25
    assert H.extract(f"<article><p>{text}</p></article><p>{notice}</p>{link}") == text.strip()
    used = {f for f in _features(H.default_tree())}
    assert {"words_before", "density_before", "words_after", "density_after"} <= used


def _features(tree):
    if isinstance(tree, tuple):
        yield H.FEATURES[tree[0]]
        yield from _features(tree[2])
        yield from _features(tree[3])


def test_marks_that_tell_nothing():
    text = ("word " * 40).strip()
    assert H.extract(f"<div class=widget><h1>Head</h1><p>{text}</p><p><a href=x>link</a></p></div>") == f"Head\n{text}"
    assert H.extract(f"<div class=widget><p>{text}</p></div><p>{text} x</p>") == f"{text} x"


def test_supplied_pages_without_article_element(spark):
    from conftest import DATA

    lost = kept = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        own = H.extract(r["html"]).split("\n")
        there = H.extract(r["html"].replace("<article", "<div").replace("</article>", "</div>")).split("\n")
        lost += len(own) - sum(a in there for a in own) + sum(b not in own for b in there)
        kept += len(own)
    assert kept > 200 and 1000 * lost <= kept


class Plain(HTMLParser):
    """Blocks of a page of paragraphs, headings, lists and divs by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.blocks, self.open, self.fresh = [], [], True

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.fresh = True
        self.open.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag != "a":
            self.fresh = True
        while self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if self.fresh:
            self.blocks.append(["", "", list(self.open)])
            self.fresh = False
        self.blocks[-1][0] += data
        if any(t == "a" for t, _ in self.open):
            self.blocks[-1][1] += data + " "


def plain_rows(page):
    parser = Plain()
    parser.feed(page)
    found = [(" ".join(t.split()), len(links.split()), stack) for t, links, stack in parser.blocks if t.strip()]
    inside = [any(t == "article" for t, _ in stack) for _, _, stack in found]
    own = [(len(t.split()), min(1.0, n / len(t.split()))) for t, n, _ in found]
    out = []
    for k, (text, _, stack) in enumerate(found):
        beside = any(t in ("nav", "footer") or c == "sidebar" for t, c in stack)
        place = H.BESIDE_IT if beside else H.WITHIN if inside[k] else H.OUTSIDE if any(inside) else H.NOWHERE
        before, after = own[k - 1] if k else (0, 0.0), own[k + 1] if k + 1 < len(found) else (0, 0.0)
        out.append((text, (*own[k], *before, *after, place, int(any(t == "h2" for t, _ in stack)), int(any(t == "li" for t, _ in stack)))))
    return out


@pytest.mark.parametrize("with_article", [True, False])
def test_features_against_a_plain_version(with_article):
    rng = random.Random(4)
    link = lambda: f"<a href='x'>{' '.join(['l'] * rng.randint(1, 3))}</a>"
    text = lambda: " ".join(rng.choice(["w", "w&amp;v", link()]) if rng.random() < 0.2 else "w" for _ in range(rng.randint(1, 60)))
    part = lambda: rng.choice([lambda: f"<p>{text()}</p>", lambda: f"<h2>{text()}</h2>", lambda: f"<ul><li>{link()}</li><li>{text()}</li></ul>", lambda: f"<div>{text()}</div>"])()
    kept = 0
    for _ in range(150):
        body = "".join(part() for _ in range(rng.randint(1, 9)))
        body = f"<article>{body}</article>" if with_article else body
        page = f"<nav>{part()}</nav>{part()}{body}<div class='sidebar'>{part()}</div>{part()}<footer>{text()}</footer>"
        assert H.rows_of(page) == plain_rows(page)
        kept += len(H.extract(page).split("\n"))
    assert kept > 200


def test_a_very_long_page():
    words = "word " * 300_000
    assert H.extract(f"<article><p>{words}</p></article><p><a href=x>more</a></p>") == words.strip()


def test_rows(spark):
    rows = [(1, "u", PAGE, "t", 5), (2, None, None, "t", 5), (1, "u", PAGE, "t", 5), (None, "v", "<article>é</article>", "t", 5)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got.collect()) == [("1", len(TEXT)), ("1", len(TEXT)), ("2", 0), ("None", 1)]
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_supplied_pages(spark):
    import html
    import re

    from conftest import DATA

    for r in spark.read.parquet(f"{DATA}/pages.parquet").join(H.main_text(spark.read.parquet(f"{DATA}/pages.parquet")).select("page_id", "text"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1|div)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)
