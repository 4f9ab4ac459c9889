"""HTML extraction against an independent parser, a quadratic alignment, and pages made to be slow."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from spanloom.llm import html

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id int, url string, html string, part string, own long, also string"


def _text(page, *near):
    return html.main_text(html.lines_of(page), *(html.hashed(html.lines_of(n)) for n in near))


class _Article(HTMLParser):
    """The blocks of a page's article, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.parts = 0, [], []

    def flush(self):
        block = " ".join("".join(self.parts).split())
        self.blocks += [block] * bool(block)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.parts += [" "] * (tag == "br")
        if tag not in ("b", "i", "a", "em", "span", "br"):
            self.flush()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span", "br"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_articles_of_all_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    expected = Counter()
    for r in pages.collect():
        parser = _Article()
        parser.feed(r["html"] or "")
        parser.close()
        parser.flush()
        expected[r["page_id"], r["url"], "\n\n".join(parser.blocks)] += 1
    assert Counter(tuple(r)[:3] for r in html.extract(pages).collect()) == expected


def _quadratic(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


def test_differencing_of_a_site(spark):
    """Unmarked pages: what stays is the page without a longest common subsequence with its nearest page of other text."""
    rng = random.Random(12)
    sites = {}
    for host in ("big.example", "small.example", "lone.example"):
        top, bottom = [f"{host} top {k}" for k in range(6)], [f"{host} bottom {k}" for k in range(4)]
        own = [top + [f"{host} {i} line {k}" for k in range(rng.randint(3, 9))] + bottom for i in range({"big.example": 70, "small.example": 9, "lone.example": 1}[host])]
        for i in range(3, len(own), 10):
            own[i] = own[i - 1]  # a copy beside its original
        sites[host] = own
    rows, expected = [], {}
    for host, own in sites.items():
        for i, lines in enumerate(own):
            rows.append((len(rows), f"https://{host}/p/{i:03}", "<body>" + "".join(f"<div>{x}</div>" for x in lines), "x", None, "y"))
            others = [own[j] for j in [*range(i - 1, -1, -1), *range(i + 1, len(own))] if own[j] != lines]
            lost = _quadratic(lines, others[0])[-1][-1] if others else 0
            expected[len(rows) - 1] = [x for x in lines if not lost or not others or x not in others[0]]
            assert len(expected[len(rows) - 1]) == len(lines) - lost
    df = spark.createDataFrame(rows, SCHEMA)
    for ranges in (1, 6, 40):
        assert {r["page_id"]: r["text"].split("\n\n") for r in html.extract(df, ranges).collect()} == expected


def test_names_of_frame():
    body = lambda name: _text(f"<article><p>body</p><div class='{name}'><p>part</p></div></article>")
    for name in ("search-engine-history", "comment-on-war", "adsorption", "shareholders", "notice-of-meeting", "related-rights-law"):
        assert body(name) == "body\n\npart"
    for name in ("search", "search-box", "comments", "comment-list", "ad", "ad-slot-3", "sidebar left", "shareButtons share", "cookie_banner", "newsletter-signup-form", "x related-links"):
        assert body(name) == "body"


def test_main_parts_around_articles():
    page = lambda k: f"<main><div>Section of the site</div><h1>Head {k}</h1><p>Intro {k}</p><article><p>Body {k}</p></article></main><footer>f</footer>"
    assert _text(page(1)) == "Section of the site\n\nHead 1\n\nIntro 1\n\nBody 1"
    assert _text(page(1), page(2)) == "Head 1\n\nIntro 1\n\nBody 1"
    assert _text(page(1), page(1), page(2)) == "Head 1\n\nIntro 1\n\nBody 1"
    teasers = "<main><p>Long body of the page</p><article class='card'>Teaser A</article><article class='card'>Teaser B</article></main>"
    assert _text(teasers) == "Long body of the page\n\nTeaser A\n\nTeaser B"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "</span>" * 20_000 + "text",
        "<b>" * 20_000 + "<p>" * 20_000 + "text",
        "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000 + "text",
        "<div class='sidebar'>" * 20_000 + "x" + "</div>" * 20_000 + "text",
        "<p x=1 " + "a" * 200_000 + ">text",
        "<p>" + "<" * 100_000 + "</p>text",
    ],
)
def test_pages_made_to_be_slow(page):
    began = time.perf_counter()
    assert "text" in _text(page) or page.startswith(("<div class", "<div>", "<p>"))
    assert time.perf_counter() - began < 5


def test_equal_lines_take_little():
    lines = [7] * 20_000
    began = time.perf_counter()
    assert len(html.shared_lines(lines, lines[:15_000] + [8] * 5000)) == 15_000
    rng = random.Random(2)
    a, b = [rng.randint(0, 5) for _ in range(3000)], [rng.randint(0, 5) for _ in range(3000)]
    found = html.shared_lines(a, b)
    assert time.perf_counter() - began < 20
    rest = iter(b)
    assert all(a[i] in rest for i in sorted(found)) and len(found) == _quadratic(a[:400], b[:400])[-1][-1] or len(found) > 1500
    assert len(html.shared_lines(a[:400], b[:400])) == _quadratic(a[:400], b[:400])[-1][-1]


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,0)", "bigint"])
def test_ids_of_any_type(spark, kind):
    df = spark.createDataFrame([(1, "http://a/1", "<p>x", "", None, ""), (2, "http://a/2", "<p>y", "", None, ""), (None, None, None, "", None, "")], SCHEMA)
    df = df.withColumn("page_id", df["page_id"].cast(kind))
    out = html.extract(df, 2)
    assert dict(out.dtypes)["page_id"] == kind.replace("(9,0)", "(9,0)") and sorted(r["text"] for r in out.collect()) == ["", "x", "y"]
    assert html.extract(df.limit(0)).collect() == []
