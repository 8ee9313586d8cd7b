"""Main text: the cut against all labellings, hand-made pages, and every page of the test table."""

import html
import itertools
import random
import re

import pytest

from keepwell.llm import main_text
from keepwell.llm.columns import table


def cost(labels, odds, ties):
    return sum(abs(x) for x, y in zip(odds, labels, strict=True) if (x > 0) != y) + sum(c for i, j, c in ties if labels[i] != labels[j])


@pytest.mark.parametrize("core", [main_text.minimum_cut, main_text._max_flow])
def test_cut_is_the_least_of_all_labellings(core):
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.randrange(-6, 7) for _ in range(n)]
        ties = [(i, i + 1, rng.randrange(5)) for i in range(n - 1)] + [(i, j, rng.randrange(3)) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.3]
        every = [(cost(x, odds, ties), x) for x in itertools.product((False, True), repeat=n)]
        least = min(c for c, _ in every)
        got = tuple(core(odds, ties))
        assert cost(got, odds, ties) == least
        assert sum(got) == max(sum(x) for c, x in every if c == least)


def test_long_chains_end():
    n = 20_000
    odds = [500 if k % 2 else -400 for k in range(n)]
    assert all(main_text.minimum_cut(odds, [(k, k + 1, 1000) for k in range(n - 1)]))


LONG = "A sentence of the article that is long enough to be told from a menu entry, with commas and an end."
PAGES = {
    "semantic": (
        f"<html><head><title>T</title></head><body><header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>"
        f"<main><article><header><h1>Head &amp; line</h1></header><p>{LONG}<p>Be.<div class='ad'>{LONG}</div><p>Sh<b>or</b>t&nbsp;\n one.<ul><li>First point<li>Second point</ul>"
        f"<form><p>{LONG}</p><input name=q></form></article><section id=comments><article class=comment><p>{LONG}</p></article></section></main>"
        f"<aside><p>{LONG}</p></aside><footer><p>&copy; Site. {LONG}</p></footer><script>if (a < b) document.write('<p>{LONG}</p>')</script></body></html>",
        f"Head & line\n{LONG}\nBe.\nShort one.\nFirst point\nSecond point",
    ),
    "without semantic tags": (
        f"<div id=top-menu><a href=a>Home</a> <a href=b>News</a></div><div class=wrap><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div></div>"
        f"<div class='cookie-notice'><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div><div><a href=c>Imprint</a> | <a href=d>Contact</a></div>",
        f"Title\n{LONG}\n{LONG}\nYes.\n{LONG}",
    ),
    "column names around the article": (
        f"<body class='has-sidebar'><form id=aspnet><div class='content with-sidebar'><article><p>{LONG}</p></article></div></form></body>",
        LONG,
    ),
    "hidden, comments and entities": (
        f"<article><!-- <p>{LONG}</p> --><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>1 &lt; 2 &#38; 3 &gt; 2, a < b and &unknown; stays {LONG}</p><!-- open",
        f"1 < 2 & 3 > 2, a < b and &unknown; stays {LONG}",
    ),
    "broken markup": (f"<article><p><b>{LONG}<br><p>One<br>two.</i></p></div><p title=\"a > b\">{LONG}</article", f"{LONG}\nOne two.\n{LONG}</article"),
    "nothing": ("<nav><a href=x>Home</a></nav>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_pages(name):
    page, want = PAGES[name]
    assert main_text.main_text(page)[0] == want


def plain(page):
    """The test pages by their template: what stands in the article, cut at its tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in parts if x)


def test_every_page_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in main_text.op13(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == pages.count()


def test_odd_rows(spark):
    kind = "page_id long, url string, html string, id long, text string, n_chars string"
    rows = [(1, None, None, 1, "t", "c"), (1, None, None, 1, "t", "c"), (None, "u", "", 1, "t", "c"), (2, "u", "<article><p>" + "word " * 300_000 + "</p>", 1, "t", "c")]
    got = [(r.page_id, r.url, r.n_chars) for r in main_text.op13(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 0), (1, None, 0), (None, "u", 0), (2, "u", 1_499_999)], key=str)
    assert main_text.op13(spark.createDataFrame([], kind)).count() == 0
