import itertools
import random

import numpy as np
import pytest

from loanscope.llm import html_extract as H
from loanscope.llm import labelled_pages as L
from loanscope.llm import tree_model
from loanscope.llm.html_tree import parse


def leaves(page):
    return [n.text for n in parse(page) if n.tag == "#text"]


def test_parser():
    assert leaves("<p>a <b>b</b>c<br>d&amp;e&eacute;&#33;<p>x<div>y</div>z") == ["a bc d&eé!", "x", "y", "z"]
    assert leaves("<ul><li>a<li>b <a href='>'>c</a></ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b c", "1", "2", "3"]
    assert leaves('<script>var t="</p>";</script>x<style>p{}</style><!-- no <p> --> y<title>t</title>') == ["x y"]
    assert leaves("a < b <p title=\"x > y\">c</p><p") == ["a < b", "c"]
    assert leaves("") == leaves(" \n ") == leaves("<div></div>") == []
    assert leaves("<p>cut off <em>here</e") == ["cut off here"]
    assert leaves("plain\n\n text") == ["plain text"]
    assert leaves("</div></p>a</li>") == ["a"]
    assert leaves("<p>" + "<div>" * 3000 + "deep") == ["deep"]
    assert len(leaves("<p>x" * 5000)) == 5000
    assert leaves("<![CDATA[a<b]]><?php x ?>c") == ["a<bc"]


def test_malformed_markup_keeps_its_text():
    assert leaves("<p title=it's>It's one paragraph.</p><p>two</p>") == ["It's one paragraph.", "two"]
    assert leaves('<p class="a"">one "quoted" word</p><p title = "x > y" id=b>two</p>') == ['one "quoted" word', "two"]
    assert leaves('<a href=/x?q="b>one "word"</a><p a==">two "more"</p>') == ['one "word"', 'two "more"']
    assert leaves('<p title="not closed>one</p><p>two</p>') == ["one", "two"]
    assert leaves("<p title='x'id='>'>one</p><p a= >two</p>") == ["one", "two"]
    for name in ("svg", "object", "noscript", "iframe", "template", "noembed", "noframes", "xmp"):
        assert leaves(f"<p>a</p><{name} width=1><p>b</p><{name}><p>c</p>") == ["a", "b", "c"]
        assert leaves(f"<p>a</p><{name}><p>b</p></{name}><{name}><p>c</p>") == ["a", "c"]
    for name in ("script", "style", "title", "textarea"):
        assert leaves(f"<p>a</p><{name}>b<p>c</p>") == ["a"]
    assert len(leaves("<p>x<svg>" * 20_000)) == 20_000


def random_forest(rng, sizes, features):
    parent, depth, leaf, node, feature = [], [], [], [], []
    for n in sizes:
        start = len(parent)
        up = [-1] + [rng.randrange(i) for i in range(1, n)]
        for i, p in enumerate(up):
            parent.append(p + start if p >= 0 else -1)
            depth.append(0 if p < 0 else depth[p + start] + 1)
            leaf.append(i not in up and i > 0)
            for f in rng.sample(range(features), 2):
                node.append(start + i)
                feature.append(f)
    return tree_model.Forest(*map(np.array, (parent, depth, leaf, node, feature)))


def test_marginals_match_enumeration():
    rng = random.Random(1)
    forest = random_forest(rng, [1, 6, 5], 4)
    weights = np.random.default_rng(1).normal(size=(4, 3))
    edge = np.random.default_rng(2).normal(size=(3, 3))
    got, pairs = tree_model.infer(forest, weights, edge)
    total = np.zeros((3, 3))
    for first, n in ((0, 1), (1, 6), (7, 5)):
        mass, own, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for states in itertools.product(range(3), repeat=n):
            if any(forest.leaf[first + i] and s == 2 for i, s in enumerate(states)):
                continue
            score = sum(weights[f, states[v - first]] for v, f in zip(forest.node, forest.feature) if first <= v < first + n)
            edges = [(states[forest.parent[first + i] - first], states[i]) for i in range(1, n)]
            w = np.exp(score + sum(edge[e] for e in edges))
            mass += w
            own[np.arange(n), states] += w
            for e in edges:
                both[e] += w
        assert np.allclose(got[first:first + n], own / mass)
        total += both / mass
    assert np.allclose(pairs, total)


@pytest.fixture(scope="module")
def model():
    return H.train(["<body><nav><a href=x>menu</a></nav><article><p>Some words of a story that goes on and on.</p></article></body>"])


def test_held_out_layouts(model):
    made, right, extra, missing, total = L.Pages(["some other words to fill the pages with text that reads on"], 99), 0, 0, 0, 0
    for _ in range(150):
        page = made.page()
        want = [n for n in leaves(page) if L.MARK in n]
        want = [w.replace(L.MARK, "") for w in want]
        got = model.extract([page.replace(L.MARK, "")])[0].split("\n\n")
        right += got == want
        extra, missing, total = extra + len(set(got) - set(want)), missing + len(set(want) - set(got)), total + len(want)
    assert right >= 135 and extra + missing <= 0.04 * total


WRAPS = ["<div id=main>%s</div>", '<div class="content">%s</div>', "<article>%s</article>", "<main>%s</main>", '<div class="post-body">%s</div>',
         '<article class="story"><div class="text">%s</div></article>']
COMMENTS = ['<div class="reader-comments">%s</div>', '<section class="comments"><h3>Comments</h3>%s</section>',
            '<div id="comments"><div class="comment">%s</div></div>', '<ol class="comment-list"><li class="comment">%s</li></ol>']
AROUND = ["%s", "<nav class=menu><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>%s<footer><p>&copy; 2024 The paper</p></footer>"]
STORY = "the story of a small town that wanted to build its own bridge across the river and had no money for it so people gave what they could".split()


def test_grid_of_short_articles_and_reader_comments(model):
    """Known texts: wrappers, lengths, and comments inside the article's element, behind it or absent."""
    rng = random.Random(3)

    def sentence(low, high):
        at = rng.randrange(len(STORY))
        return " ".join((STORY * 3)[at:at + rng.randint(low, high)]).capitalize() + "."

    pages, wants = {"inside": [], "after": [], "none": []}, {"inside": [], "after": [], "none": []}
    for wrap, n, where, comments, around in itertools.product(WRAPS, (1, 2, 4), pages, COMMENTS, AROUND):
        head, text, comment = sentence(5, 5)[:-1], [sentence(14, 30) for _ in range(n)], comments % f"<p>{sentence(6, 24)}</p>"
        body = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in text)
        page = wrap % (body + comment * (where == "inside")) + comment * (where == "after")
        pages[where].append(f"<html><body>{around % page}</body></html>")
        wants[where].append("\n\n".join([head, *text]))
    for where, least in (("none", 1.0), ("after", 0.99), ("inside", 0.93)):
        got = model.extract(pages[where])
        assert sum(g == w for g, w in zip(got, wants[where])) >= least * len(got), where
        assert all(g for g in got), where


def test_page_parts(model):
    page = """<html><head><title>T</title></head><body><div class="cookie-banner"><p>We use cookies to improve this site, please accept.</p></div>
    <header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav></header>
    <div id="content"><article><h1>A title</h1><p>The first   paragraph of the <b>story</b> &amp; more.</p>
    <p>A second paragraph,<br>with a break in the text.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I think that this story is very good indeed.</p></div></section></div>
    <aside class="sidebar"><h3>Related</h3><p>Another story that you may want to read as well.</p></aside>
    <form class="newsletter"><p>Subscribe to our newsletter today.</p><input><button>Go</button></form>
    <footer><p>&copy; 2024 The site. All rights reserved.</p></footer></body></html>"""
    assert model.extract([page])[0] == ("A title\n\nThe first paragraph of the story & more.\n\nA second paragraph, with a break in the text.")


def test_table(spark, model):
    long = "<article>" + "<p>" + "A long paragraph of many words. " * 3000 + "</p>" * 2 + "</article>"
    good = "<html><body><nav><a href=/>x</a></nav><article><h1>Head</h1><p>Text of it.</p></article></body></html>"
    rows = [(1, "u", good), (2, None, None), (3, "u", ""), (4, "u", long), (None, "u", good), (1, "u", good), (6, "u", "<script>x")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    got = H.extract(pages, layouts=150).collect()
    texts = {good: "Head\n\nText of it.", long: ("A long paragraph of many words. " * 3000).strip()}
    assert sorted((str(r.id), str(r.url), r.text) for r in got) == sorted((str(i), str(u), texts.get(h, "")) for i, u, h in rows)
    assert H.extract(pages.limit(0), layouts=20).count() == 0
