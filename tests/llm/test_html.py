"""Extraction of main text, the tokeniser's rules, and the chain's decoding."""

import itertools

import numpy as np
import pytest

from conceptspark.llm import html_crf as crf


@pytest.fixture(scope="module")
def chain(spark, sf):
    return crf.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def _page(before, article, after):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{article}{after}</body></html>"


ARTICLE = "<article><h1>A heading of it</h1><p>First sentence of the text, &amp; more of it. Second sentence.<p>Another   paragraph\nwith <a href='/x'>a link</a> in it.<br>And a line.</article>"
WANT = "A heading of it First sentence of the text, & more of it. Second sentence. Another paragraph with a link in it. And a line."
OTHERS = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>',
    "<header><h2>Site name</h2><p>Slogan of the site.</p></header>",
    '<aside><h3>Related</h3><p>Some other story to read.</p></aside>',
    '<div class="sidebar"><p>Some other story to read here.</p></div>',
    '<div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>',
    '<div class="ad">Buy now and save a lot of money.</div>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    '<section class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a good text.</p></div></section>',
    "<footer><p>&copy; 2024 the site. All rights reserved.</p></footer>",
]


@pytest.mark.parametrize("other", OTHERS)
def test_leaves_out(chain, other):
    assert crf.main_text(_page(other, ARTICLE, ""), chain) == WANT
    assert crf.main_text(_page("", ARTICLE, other), chain) == WANT


INSIDE = [
    '<section class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a good text.</p></div></section>',
    '<div class="ad-slot">Buy now and save a lot of money.</div>',
    '<div hidden>Text that is not shown to anybody.</div>',
    '<div class="sidebar"><p>Some other story to read here.</p></div>',
    '<aside><h3>Related</h3><p>Some other story to read.</p></aside>',
    '<div class="newsletter signup"><p>Get our stories by mail every day.</p></div>',
    '<div id="respond"><h3>3 replies</h3><p>I think this is a good text.</p></div>',
    "<footer><p>Filed under news by the editor.</p></footer>",
]


@pytest.mark.parametrize("other", INSIDE)
def test_leaves_out_inside_the_article(chain, other):
    assert crf.main_text(_page("", ARTICLE.replace("</article>", other + "</article>"), ""), chain) == WANT


BODY = ["The harbour was built in the last century.", "Ships of many countries came to it, and traders lived in the town.", "Today it is a quiet place with a museum. Few ships come."]
MENU = '<div class="menu"><a href="/">Home</a> <a href="/n">News</a></div>'
FOOT = '<div class="footer">Copyright 2024. All rights reserved.</div>'
# Layouts that no template has: (page, text of the article).
HELD_OUT = [
    (MENU + "".join(f'<div class="a{i}">{t}</div>' for i, t in enumerate(BODY)) + FOOT, BODY),
    (MENU + "<br>".join(BODY) + FOOT, BODY),
    ("<table><tr><td>" + MENU + "</td></tr><tr><td>" + "".join(f"<p>{t}</p>" for t in BODY) + '</td></tr><tr><td><a href="/c">Contact us</a> | <a href="/i">Imprint</a></td></tr></table>', BODY),
    ('<div class="wrap"><div role="navigation"><ul><li><a href="/">Home</a></li></ul></div><div class="col-8">' + "".join(f"<p>{t}</p>" for t in BODY) + "</div></div>" + FOOT, BODY),
    ("<main>" + "".join(f"<p>{t}</p>" for t in BODY) + '</main><div id="respond"><p>3 replies to this text</p><p>I think this is good.</p></div>', BODY),
    ("<main><section>" + "".join(f"<p>{t}</p>" for t in BODY) + '</section><div class="related-links"><p>More stories to read.</p></div></main>', BODY),
    ('<article><div class="share-buttons"><a href="/f">Post</a></div>' + "".join(f"<p>{t}</p>" for t in BODY) + '<div class="comments-area"><p>Nice text.</p></div></article>', BODY),
    ('<section class="post-body">' + "".join(f"<p>{t}</p>" for t in BODY) + '</section><div class="cookie-bar">We use cookies.</div>', BODY),
]


def test_held_out_layouts(chain):
    """F1 of words over layouts that differ from the templates; no page may come out empty."""
    from collections import Counter

    hit = found = wanted = 0
    for page, body in HELD_OUT:
        got, want = Counter(crf.main_text(f"<html><body>{page}</body></html>", chain).split()), Counter(" ".join(body).split())
        assert got, page
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
    assert 2 * hit / (found + wanted) > 0.97


def test_an_ancestor_counts_at_any_depth(chain):
    page = "<nav>" + "<div>" * 300 + "Some other story to read here." + "</div>" * 300 + "</nav>"
    assert crf.main_text(_page(page, ARTICLE, ""), chain) == WANT
    marks = crf.leaf_blocks(page)[0].node.marks
    assert marks >> crf._slot("in:nav") & 1
    wide = crf.leaf_blocks("".join(f'<div class="c{chr(97 + i % 26) * (1 + i // 26)}">x' for i in range(2000)))
    assert len(wide) == 2000 and max(b.node.marks.bit_length() for b in wide) <= crf.SLOTS


def test_given_pages(spark, sf, chain):
    """The tables' own layout: all of the article element and nothing else."""
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?)(h1|p|br)>", " ", body)))).strip()
        assert crf.main_text(r["html"], chain) == want, r["page_id"]


def test_awkward_pages(spark, chain):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "<html><body></body></html>", None, 1), (4, _page("", ARTICLE, ""), "u", None), (4, _page("", ARTICLE, ""), "u", None), (5, "<p>" + "word " * 100000, "u", 1), (6, "<div" * 1000, "u", 1), (7, "a < b & c > d", "u", 1)]
    got = crf.extract(spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int"), chain).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[3]["text"] == "" and by[4]["text"] == WANT and by[4]["n_chars"] == len(WANT)
    assert crf.extract(spark.createDataFrame([], "page_id long, html string, url string"), chain).count() == 0


def test_blocks():
    texts = lambda page: [b.text for b in crf.leaf_blocks(page)]
    assert texts("<p>a<b>b</b>c<p>d&#233;&nbsp;e") == ["abc", "dé e"]
    assert texts("<ul><li>a<li>b</ul><!-- <p>no</p> -->c") == ["a", "b", "c"]
    assert texts('<div title="a > b">x</div><script>"<p>y</p>"</script>z') == ["x", "z"]
    assert texts("<p>cut <") == ["cut <"] and texts("<style>a") == []


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p class=a"b>Hello</p>', ["Hello"]),
        ("<p title=it's>Hello</p><p>Don't</p><p>more</p>", ["Hello", "Don't", "more"]),
        ('<a href="x"">L</a>', ["L"]),
        ("<p title='a > b' x=\"c'>d\">e</p>", ["e"]),
        ("<p a = 'x>y' b=/c>d</p>", ["d"]),
        ("<p class=>d</p><p =x>e</p>", ["d", "e"]),
        ('<p title="never closed>Hello</p><p>more</p>', ["Hello", "more"]),
        ("<!-->a<!--->b<!-- x --!>c</>d</ 1>e", ["abcde"]),
        ("<b><p>x</b>y</p>z", ["xy", "z"]),
        ("<i><div>a</i>b</div>c", ["ab", "c"]),
    ],
)
def test_tags_end_where_a_browser_ends_them(page, want):
    assert [b.text for b in crf.leaf_blocks(page)] == want


def test_work_is_linear_in_the_page():
    import time

    def seconds(page):
        at = time.process_time()
        crf.main_text(page, crf.Chain(np.zeros((crf.SLOTS, 2)), np.zeros((2, 2))))
        return time.process_time() - at

    for unit in ('<div class="a b">x', "<i><b>x", "</i></div>x", "<i>x</b>", "<p title='", '<p a="', "<!--", "<li><b>x"):
        small, large = seconds(unit * 4000), seconds(unit * 32000)
        assert large < 24 * max(small, 0.05), unit


def test_deep_and_hidden_attributes():
    deep = crf.leaf_blocks("<article>" + "<div>" * 200 + "x")
    assert deep[0].node.inside and len(next(crf.features(deep))) < 20
    assert crf._attribute_words(' data-class="no" CLASS="Foo-bar" hidden') == ("foo", "bar", "hidden")


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    chain = crf.Chain(rng.standard_normal((crf.SLOTS, 2)), rng.standard_normal((2, 2)))
    for n in range(1, 8):
        page = [list(rng.integers(0, crf.SLOTS, rng.integers(1, 5))) for _ in range(n)]
        s = chain.scores(page)

        def total(y, s=s):
            return sum(s[i, a] for i, a in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))

        assert total(chain.viterbi(page)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=n))))
