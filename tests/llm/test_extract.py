"""Page blocks, the labeller's gradients, and extracted texts against the layouts' own labels."""

import html
import random
import re

import numpy as np
import pytest

from tablewise.llm import extract
from tablewise.llm.html_blocks import leaf_blocks
from tablewise.llm.layouts import MAIN, OTHER, Dresser

FOLDER = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks():
    assert texts("") == [] and texts("<p></p> <!-- x --><br>") == []
    assert texts("<p>a<b>b</b>c<br>d&amp;e &eacute;&#233;&nbsp;f\n\t g<p>h<div>i<span>j</span>") == ["abc d&e éé f g", "h", "ij"]
    assert texts("x<script>var t='<p>no</p>';</script>y<style>p{}</STYLE>z<!-- <p>q -->w") == ["x", "y", "zw"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><th>g</table>h") == list("abcdefgh")
    assert texts("1 < 2 <3 & a<b title='>'>c</b> <p title=\"x>y\">d <p title='open>e</p>")[0] == "1 < 2 <3 & ac"
    assert texts("<script>never closed <p>x") == [] and texts("<!-- never closed <p>x") == []
    paths = [b.path for b in leaf_blocks('<div class="Main-Text x2" id=a role=main><p>t</div><p>u')]
    assert paths == [["div", ".main", ".text", ".x", ".a", "role main", "p"], ["p"]]
    link = leaf_blocks("<li><a href=x>ab</a> cd</li>")[0]
    assert (link.text, link.linked) == ("ab cd", 2)


def test_blocks_of_broken_pages_do_not_crash():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<a href='", '"', "'", ">", "<", "</", "<!--", "-->", "<script>", "</script", "&amp", "&#x110000;", "text ", "<td>", "</table>", "<b/>", "\0", "</p x=1>"]
    for _ in range(300):
        page = "".join(rng.choices(bits, k=rng.randint(1, 40)))
        assert all(b.text == " ".join(b.text.split()) and b.text for b in leaf_blocks(page))
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep * 2) == ["x", "x"]


def test_gradients():
    rng = np.random.default_rng(0)
    dresser = Dresser(["some words. of prose here"], ["menu"], 3)
    pages = [leaf_blocks(dresser.page()) for _ in range(3)] + [[]]
    labels = np.array([float(b.text.startswith(MAIN)) for p in pages for b in p])
    model = extract.BlockLabeller.start(1)
    sequence = extract._sequence(pages)
    _, grads = extract.loss_and_gradients(model, sequence, labels)
    for name, weights in model.weights.items():
        flat, gradient = weights.reshape(-1), grads[name].reshape(-1)
        for at in [*rng.choice(len(flat), 3), int(np.abs(gradient).argmax())]:
            here, step = flat[at], 1e-5
            flat[at] = here + step
            up = extract.loss_and_gradients(model, sequence, labels)[0]
            flat[at] = here - step
            down = extract.loss_and_gradients(model, sequence, labels)[0]
            flat[at] = here
            assert abs((up - down) / (2 * step) - gradient[at]) < 1e-6
    # side by side or one by one, a page is labelled alike
    alone = [model.probabilities(extract._sequence([p])) for p in pages[:3]]
    assert np.allclose(np.concatenate(alone), model.probabilities(sequence))


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit_labeller(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def expected(page):
    """The article of a test page, by cutting its source."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_every_page_of_the_table(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = extract.extract_text(pages, model).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(found) == len(source)
    assert all(r.text == expected(source[r.page_id]) and r.n_chars == len(r.text) for r in found)


def test_unseen_layouts(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").limit(40).collect()
    prose = [t for r in pages for t in expected(r.html).split("\n")]
    dresser, wrong = Dresser(prose, ["Menu", "Login"], 77), 0
    made = [dresser.page() for _ in range(200)]
    want = ["\n".join(b.text[1:] for b in leaf_blocks(p) if b.text[0] == MAIN) for p in made]
    sources = [re.sub(f"[{MAIN}{OTHER}]", "", p) for p in made]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(sources)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract_text(df, model).collect()}
    wrong = sum(got[i] != re.sub(f"[{MAIN}{OTHER}]", "", w) for i, w in enumerate(want))
    assert wrong <= 14


def test_a_page_of_many_parts(spark, model):
    page = """<html><head><title>T</title></head><body><div id="cookie-banner">We use cookies to do things.</div>
    <header class="site-header"><a href="/">Site</a><nav class="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav></header>
    <div class="layout"><main><article><h1>A title here</h1><p>First words of the text, which go on for a while.</p>
    <div class="ad">Buy this now. It is good.</div><p>Second <a href="x">linked</a> part &mdash; with dashes.</p><ul><li>point one</li><li>point two</li></ul>
    </article><section class="comments"><h3>Comments</h3><div class="comment"><p>I think that this is not right at all.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><p>Another story of great interest to all.</p></aside></div>
    <form class="newsletter"><label>Mail</label><button>Send</button></form><footer><p>All rights reserved.</p></footer></body></html>"""
    rows = [(1, "u", page, "x"), (2, None, None, None), (None, "u", "", ""), (1, "u", page, "x"), (3, "v", "<nav>menu</nav>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract.extract_text(df, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = "A title here\nFirst words of the text, which go on for a while.\nSecond linked part — with dashes.\npoint one\npoint two"
    got = sorted(((r.page_id or 0, r.text) for r in found.collect()))
    assert got == [(0, ""), (1, want), (1, want), (2, ""), (3, "")]
    long = "<article>" + "<p>Words of prose that fill a line of text.</p>" * 30_000 + "</article><footer>x</footer>"
    one = extract.extract_text(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string"), model).first()
    assert one.text.count("\n") == 29_999


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract_text(none, extract.fit_labeller(none, layouts=40, steps=5)).count() == 0
