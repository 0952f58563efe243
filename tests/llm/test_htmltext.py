"""Main text of pages: the block reader on hand-made markup, the network's gradients, and held-out pages."""

import random
import re
from html import unescape

import numpy as np
import pytest

from topolake.llm import htmltext, labeller
from topolake.llm.blocks import blocks, path_buckets
from topolake.llm.queries import queries

SCHEMA = "page_id long, url string, html string"


def texts(html):
    return [t for _, t, _ in blocks(html)]


def test_blocks_of_broken_markup():
    assert texts("<p>a <b>b</b>c<p>d<br>e<ul><li>f<li>g &amp; h</ul>i<script>x</p></script>j") == ["a bc", "d e", "f", "g & h", "ij"]
    assert texts("<!-- <p>no</p> --><!DOCTYPE html><title>t</title>a < b <p") == ["a < b"]
    assert texts('<p title="a>b">c</p></div></nope><td>d<td>e') == ["c", "d", "e"]
    assert texts("<STYLE>p{}</STYLE ><P>\n x\t y </P>&eacute;&#233;&am") == ["x y", "éé&am"]
    assert texts("<style>never closed <p>a</p>") == [] == texts("") == texts("<p> </p><!-- open")
    assert [x for *_, x in blocks("<p><a href=x>ab</a></p><p>ab<a>cd</p><p>ef")] == [1.0, 0.5, 0.0]


def test_paths_name_classes_and_ids():
    path, *_ = blocks("<div class='postBody wide-2' id=Main role=main><span class=note><p>x")[0]
    assert path == ("div", ".post", ".body", ".wide", ".main", ".note", "p")
    assert len(path_buckets(())) == 1


def test_long_pages_are_read_in_time():
    assert len(blocks("<p>a" * 100_000)) == 100_000
    assert len(blocks("<div><b>" * 400 + "x" + '<a "' * 2000)) <= 2001


def made(seed, n=6):
    r = random.Random(seed)
    some = [htmltext._features(" ".join(r.choices(["one", "two", "three,", "four."], k=k)), 0.0) for k in (3, 9, 40)]
    return [htmltext._made_page(r, some, some) for _ in range(n)]


def arrays(pages):
    return (
        [path_buckets(p) for page in pages for p, _, _ in page], np.array([f[0] for page in pages for _, f, _ in page]), np.array([f[1] for page in pages for _, f, _ in page]),
        np.array([len(p) for p in pages]), np.array([float(t) for page in pages for *_, t in page]),
    )


def test_gradients_are_those_of_the_loss():
    args, model, r = arrays(made(1)), labeller.new(3), np.random.default_rng(1)
    _, grads = labeller.gradients(model, *args)
    for name, g in grads.items():
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(r.integers(0, n) for n in g.shape)]:
            old, ends = model[name][at], []
            for e in (1e-5, -1e-5):
                model[name][at] = old + e
                ends.append(labeller.gradients(model, *args)[0])
            model[name][at] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6, name


def test_pages_together_are_labelled_as_alone():
    pages, model = made(2), labeller.new(4)
    paths, words, stat, sizes, _ = arrays(pages)
    every = labeller.logits(model, labeller.embedded(model, paths, words, stat), sizes)[0]
    alone = [labeller.logits(model, labeller.embedded(model, *arrays([p])[:3]), np.array([len(p)]))[0] for p in pages]
    assert np.allclose(every, np.concatenate(alone))


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return htmltext.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def plain(html):
    """The article of the given pages: they are of one form."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    cut = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in cut if x)


def test_given_pages_give_their_articles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r["page_id"]: r for r in queries()["op11_html_extraction"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got = found[r["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (plain(r["html"]), len(plain(r["html"])), r["url"])


LAYOUT = """<html><head><title>T</title></head><body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><header class="site-header"><a href="/">Daily</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="layout"><{0}><h1>{1}</h1><p>{2}</p><div class="advert">Buy now!</div><p>{3}</p>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked it.</p></div></section></{4}><aside class="sidebar"><h3>Most read</h3><ul><li><a href=x>Other story</a></li></ul></aside>
<form class="newsletter"><label>Email</label><input></form></div><footer>&copy; 2024</footer></body></html>"""


def test_other_layouts(spark, sf_dir, model):
    words = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(9).collect()]
    lines = [" ".join(re.sub(r"[<&>]", "", w)[:400].split()) for w in words]
    rows, want = [], {}
    for i, open_tag in enumerate(("article", "main", 'div class="post-content"', 'div id="article-body"', 'main class="entry"')):
        for j in range(3):
            rows.append((len(rows), "u", LAYOUT.format(open_tag, *lines[3 * j : 3 * j + 3], open_tag.split()[0])))
            want[len(want)] = "\n".join(lines[3 * j : 3 * j + 3])
    found = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert sum(found[i] == want[i] for i in want) >= 12, [(i, found[i]) for i in want if found[i] != want[i]]


def test_made_pages_that_it_has_not_seen(model):
    pages = made(1234, 300)
    paths, words, stat, sizes, truth = arrays(pages)
    right = (labeller.logits(model, labeller.embedded(model, paths, words, stat), sizes)[0] > 0) == (truth > 0)
    assert right.mean() > 0.95


def test_odd_pages(spark, model):
    rows = [(1, None, None, "t", 1), (2, "u", "", "t", 1), (None, None, "<article><p>a b.</p></article>", None, None), (2, "u", "", "t", 1), (3, "u", "no tags at all", "t", 1), (4, "u", "<article>" + "<p>Some words.</p>" * 5000, "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", text string, `row.0` int")
    found = htmltext.extract(df, model)
    assert found.columns == ["page_id", "url", "row.0", "text"]
    got = sorted((r["page_id"] or 0, r["text"]) for r in found.collect())
    assert len(got) == 6 and got[1] == (1, "") and got[2:4] == [(2, "")] * 2 and got[0] == (0, "a b.")
    assert got[5][1].count("\n") >= 4990
    assert htmltext.extract(df.where("false"), model).count() == 0
    assert htmltext.extract(df, htmltext.train(df.where("false"))).count() == 6
