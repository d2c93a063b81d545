"""Blocks of pages, the recurrent network, and the text it leaves."""

import html
import re

import numpy as np
import pytest

from foldwise.llm import block_labeller as b
from foldwise.llm.queries import QUERIES


def texts(page):
    return [x.text for x in b.leaves(page)]


def test_blocks_follow_the_markup():
    page = ("<!DOCTYPE html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- <p>no</p> -->"
            "<p>a &amp; b<p>c <b>d<br>e<p>f</p><ul><li>g<li>h <ul><li>i</ul><li>j</ul>k<table><tr><td>l<td>m</table><svg><text>no</text></svg>&lt;n&gt; &copy;")
    assert texts(page) == ["a & b", "c d e", "f", "g", "h", "i", "j", "k", "l", "m", "<n> ©"]
    paths = {x.text: x.path for x in b.leaves('<article class="post mainText"><div id="comments"><p>x</p></div></article><p>y')}
    assert paths == {"x": ("article", "post", "main", "text", "div", "comments", "p"), "y": ("p",)}


@pytest.mark.parametrize("page", [None, "", " \n\t ", "<p>", "<<<>>", "<!--", "<script>x", "</p></div>", "<p></p><br>", "\x00"])
def test_pages_without_blocks_or_with_broken_markup(page):
    assert all(t.strip() for t in texts(page))


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in b.fresh(1).items()}
    sizes = np.array([3, 1, 5])
    forward, backward, mask = b.places(sizes)
    x = r.normal(size=(9, b.WIDTH))
    for side, at in (("f", forward), ("b", backward)):
        weight = r.normal(size=(9, b.HIDDEN)).astype(np.float32)
        keep, grads = [], {}
        b.lstm(w, side, x, at, mask, keep)
        dx = b.back(w, side, x, at, keep, weight, grads)
        loss = lambda: float((b.lstm(w, side, x, at, mask) * weight).sum())
        for name, g, value in [(n, grads[n], w[n]) for n in (f"h{side}", f"x{side}", f"c{side}")] + [("x", dx, x)]:
            for _ in range(4):
                i = tuple(int(r.integers(n)) for n in value.shape)
                old = value[i]
                value[i] = old + 1e-3
                up = loss()
                value[i] = old - 1e-3
                down = loss()
                value[i] = old
                assert g[i] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=0.02), name


def test_pages_do_not_touch_each_other():
    w = b.fresh(3)
    pages, _ = b.layouts(20, ["one", "two", "three"], 5)
    together = b.scores(w, pages)
    alone = np.concatenate([b.scores(w, [p]) for p in pages])
    assert np.allclose(together, alone, atol=1e-4)
    assert len(b.scores(w, [[], []])) == 0


@pytest.fixture(scope="module")
def weights():
    words = [f"w{k}" for k in range(300)]
    return b.learnt(*b.layouts(450, words, 7))


def test_held_out_layouts(weights):
    pages, marks = b.layouts(200, [f"v{k}" for k in range(300)], 11)  # none of the words was seen
    y = np.concatenate(marks)
    right = (b.scores(weights, pages) > 0) == (y > 0.5)
    assert right.mean() > 0.95 and right[y > 0.5].mean() > 0.95


def test_the_rest_of_the_page_decides(weights):
    # The same block, without names: among menu entries, and among paragraphs.
    p = "<div>This is a sentence of some words.</div>"
    menu = "".join(f"<div><a href='/{k}'>Home</a></div>" for k in range(6))
    text = "".join("<div><p>" + "Some longer text, with words and more words. " * 6 + "</p></div>" for _ in range(6))
    odds = {}
    for name, page in (("menu", menu + p + menu), ("text", text + p + text)):
        blocks = b.leaves(page)
        odds[name] = b.scores(weights, [blocks])[[x.text for x in blocks].index("This is a sentence of some words.")]
    assert odds["text"] > odds["menu"]


def plain(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in found if x)


def test_query_gives_every_article(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op11_block_labeller"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def test_odd_rows(spark, weights):
    long = "<article>" + "<p>" + "word " * 200_000 + "</p>" + "<p>one more sentence here.</p>" * 5000 + "</article>"
    rows = [("a", None), ("a", ""), (None, long), ("b", "<article><p>x y z, more.</p></article>"), ("b", "<article><p>x y z, more.</p></article>")]
    df = spark.createDataFrame(rows, "page_id string, html string").selectExpr("*", "'u' AS url", "1 AS text", "2 AS n_chars")
    got = b.article_text(df, weights=weights).collect()
    assert sorted((str(r.page_id), r.n_blocks) for r in got) == [("None", 5001), ("a", 0), ("a", 0), ("b", 1), ("b", 1)]
    big = next(r for r in got if r.page_id is None)
    assert big.n_chars == len(big.text) and big.text.startswith("word word") and big.text.count("\n\n") > 4900
    assert b.article_text(df.limit(0), weights=weights).count() == 0


def test_empty_table_is_fitted_from_layouts(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert b.fitted(df, drawn=10)["out"].shape == (2 * b.HIDDEN + b.WIDTH, 1)
