import re
from itertools import product

import numpy as np
import pytest

from quadrille.llm import html_extract
from quadrille.llm.html_extract import Maker, decode, extract, main_text, parse, train


@pytest.fixture(scope="module")
def model():
    return train()


def blocks(page):
    return [text for _, text in parse(page).texts]


def test_parser():
    assert blocks("<p>a <b>b<br>c<p>d &amp; &copy;&amp x") == ["a b c", "d & ©& x"]
    assert blocks("<ul><li>a<li>b</ul>c<div>d</div>e") == ["a", "b", "c", "d", "e"]
    assert blocks("x<!-- <p>no</p> -->y<script>var t='</p>';</script>z<style>p{}</style>") == ["xy z"]
    assert blocks("<head><title>t</title></head><body>b") == ["b"]
    assert blocks('<p title="a>b">c</p><p title=\'<p>\'>d') == ["c", "d"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("a\n\t&nbsp; b") == ["a b"]
    assert blocks("</p>a</div>b</b>c") == ["a", "bc"]
    assert blocks("a < b <3 &unknown; <") == ["a < b <3 &unknown; <"]
    assert blocks("<p>a<!-- never closed <p>b") == ["a"]
    assert blocks("<script>never closed") == [] == blocks("")
    assert blocks('<p title="never closed>a') in ([], ["a"])
    tree = parse('<DIV CLASS="Main-Menu x9" id=top><p>t')
    assert tree.tokens[1] == ["div", "main", "menu", "x", "top"] and tree.parents == [-1, 0, 1]


def test_open_head(model):
    page = "<html><head><title>x</title>{}<body><article><p>text</p></article></body></html>"
    assert blocks(page.format("")) == blocks(page.format("</head>")) == ["text"] == blocks("<head><meta charset=x><style>p{}</style>text")
    assert blocks("<head><title>x</title><p>a</p><head>b") == ["a", "b"]
    article = "<article><h1>Title</h1><p>One two, three.</p><p>Four, five six.</p></article>"
    assert main_text([parse(f"<html><head><title>x</title>{end}<body>{article}") for end in ("", "</head>")], model) == ["Title\n\nOne two, three.\n\nFour, five six."] * 2


def test_drawings_formulas_and_controls():
    assert blocks("<svg class='i'/><article><p>a</p></article>") == ["a"] == blocks("<math/><p>a</p>")
    assert blocks("<svg><path d='M0'/><p>a</p>") == ["a"]
    assert blocks("<button>b<article><p>a</p></article>") == ["b", "a"]
    assert blocks("<select><option>x<option>y<article><p>a</p><select><option>z</select>b</article>c") == ["x y", "a", "z b", "c"]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert blocks("<p>a<button>b</button>c <svg><title/><text>d</text></svg> e</p><p>f") == ["a b c d e", "f"]
    assert blocks("<svg><style>p{}</style></svg>a <svg><title>b<p>c") == ["a b", "c"]


def test_decoding_against_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 10))
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        logits = rng.normal(0, 2, n)
        log_keep, log_drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)

        def value(choice):
            return sum(log_keep[k] if choice[k] else log_drop[k] for k in range(1, n))

        allowed = [c for c in product([False, True], repeat=n) if c[0] and all(c[parents[k]] or not c[k] for k in range(1, n))]
        got = decode(parents, logits)
        assert tuple(got.tolist()) in allowed and value(got) == pytest.approx(max(map(value, allowed)))


def test_held_out_pages(model):
    maker, right, kept, wanted = Maker(77), 0, 0, 0
    for _ in range(200):
        page = maker.page()
        marked = parse(page)
        want = [t for k, t in marked.texts if marked.marks[k] != "0"]
        got = main_text([parse(re.sub(" data-y=.(?:1|0|-).", "", page))], model)[0].split("\n\n")
        right += len(set(want) & set(got))
        kept, wanted = kept + len(set(got)), wanted + len(set(want))
    assert right / kept > 0.97 and right / wanted > 0.97


def test_rows(spark, model):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>One  two.</p><p>Three, four.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "v", page, "x"), (1, "u", page, "x"), (4, "w", "<article>" + "<p>word word.</p>" * 20000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages, model).collect()), key=str)
    text = "Title\n\nOne two.\n\nThree, four."
    long = "\n\n".join(["word word."] * 20000)
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (None, "v", text, len(text)), (1, "u", text, len(text)), (4, "w", long, len(long))], key=str)
    assert extract(pages.limit(0), model).count() == 0


def test_deep_and_wide_pages(model):
    """Elements left open by the thousand are no more than linear work, and many pages at once give what each gives alone."""
    import time

    began = time.time()
    for page in ("<main>" * 20_000 + "x", "<p>a" * 20_000, "<ul>" + "<li>b" * 20_000, "<div><span>" * 10_000, "</i>" * 50_000, "<table>" + "<tr><td>c" * 10_000):
        parse(page)
    assert time.time() - began < 8
    pages = [Maker(seed).page() for seed in range(30)]
    assert main_text(map(parse, pages), model) == [main_text([parse(p)], model)[0] for p in pages] and main_text([], model) == []
    before = html_extract.NODES_AT_ONCE
    try:
        html_extract.NODES_AT_ONCE = 10
        assert main_text(map(parse, pages), model) == [main_text([parse(p)], model)[0] for p in pages]
    finally:
        html_extract.NODES_AT_ONCE = before
