import itertools
import random
import time

import pytest

from blotter.llm import pages


def test_cut_is_minimal():
    chance = random.Random(11)
    for _ in range(150):
        n = chance.randrange(1, 8)
        scores = [chance.uniform(-2, 2) for _ in range(n)]
        s, t = [max(0, x) for x in scores], [max(0, -x) for x in scores]
        edges = [
            (a, b, chance.uniform(0, 2))
            for a, b in itertools.combinations(range(n), 2) if chance.random() < 0.5
        ]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(
                c for a, b, c in edges if side[a] != side[b]
            )

        least = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(pages.minimum_cut(s, t, edges)) - least) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div>
<nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="wrap"><div class="sidebar"><p>Long sidebar text that goes on and on for many words.</p></div>
<main><article><header><h1>Title&nbsp;here</h1></header><p>Short.</p>
<p>Long <b>para</b>graph with   many words &amp; a <a href=x>link</a> inside.<br>Yes<!-- no --></p>
<div class="ad">Buy now</div><script>var x = "<p>";</script><p>End<aside>Aside text.</aside></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>A great article, thanks for it.
</p></article></section></main></div><form><label>Name</label><input></form><footer>&copy; c</footer>"""


def test_article_without_the_rest():
    assert pages.main_text(PAGE) == (
        "Title here Short. Long paragraph with many words & a link inside. Yes End"
    )


def test_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain < text"), (4, "u", "<p>a <b"), (None, "u", "<"),
            (5, "u", "<article>" + "<p>words and words.</p>" * 3000), (5, "u", "</div></p><script>x")]
    data = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = pages.extract_pages(data)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == 7 and all(r.n_chars == len(r.text) for r in found)
    assert next(r.text for r in found if r.n_chars > 1000).count("words and words.") == 3000
    assert {r.text for r in found if r.page_id in (1, 2)} == {""}
    assert pages.extract_pages(data.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract_pages(table).collect()}
    for row in table.collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", row.html)[1]
        bare = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert got[row.page_id] == " ".join(html.unescape(bare).split())


_PROSE = "This is the first sentence of the text, and it goes on for quite some words to be prose."
_MORE = "And here is the second paragraph, which must not be lost whatever stands before it, as it is prose."


@pytest.mark.parametrize("before", [
    "<a title=it's>x</a>", "<button>Share", "<object data=x/>", "<object data=x>", "<p class=\"x>", "<select><option>a",
    "<video src=a>", "<button>a<p>b</p><button>c</button>", "<p class='a' title='b>", "<svg/>", "<i a=\"1\"b=\"2\">z</i>",
])
def test_broken_markup_loses_no_paragraph(before):
    body = f"<article>{{0}}<p>{_PROSE}</p><p>{_MORE}</p></article>"
    text = pages.main_text(f"<html><body>{body.format(before)}</body></html>")
    assert _PROSE in text and _MORE in text
    assert "<" not in text and "class=" not in text


def test_raw_text_never_leaks():
    inside = "<script>if (a < b) { x = '</p>'; }</script><style>p > a { }</style><noscript><p>no</p></noscript>"
    text = pages.main_text(f"<body><article><p>{_PROSE}</p>{inside}<p>{_MORE}</p><script>var z = 1;</article></body>")
    assert text == f"{_PROSE} {_MORE}"


def test_nested_graphics_are_skipped_whole():
    page = f"<article><p>{_PROSE}</p><svg><svg><text>a</text></svg><text>b</text></svg><p>{_MORE}</p></article>"
    assert pages.main_text(page) == f"{_PROSE} {_MORE}"


def test_hostile_pages_take_time_in_proportion():
    for part in ('<p class="', "<a ", "<a b='", "<", "<button>", "<x y=\"1\" "):
        times = []
        for n in (2_000, 8_000):
            begin = time.perf_counter()
            pages.blocks_of(part * n)
            times.append(time.perf_counter() - begin)
        assert times[1] < 16 * times[0] + 0.5, part
