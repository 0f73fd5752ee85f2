"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements and text leaves.  Node features (tag,
words of class and id, text length, link share, position) and parent-child
potentials give, by sum-product message passing up and down the tree, each
leaf's marginal probability of being content; leaves above one half are the
article, in page order, joined by an empty line.  See ``tree_model`` for the
model and ``labelled_pages`` for the labelled layouts it is trained from; their
words come from a bounded sample of the table's own pages, and sampled pages
with exactly one ``article`` element are labelled by it and join the training.

Defined cases: null and empty pages, and pages without text, give the empty
text; a page that is plain text is one leaf; unclosed, crossed and cut off tags
are repaired; rows are independent, so repeated rows, ties and null ids change
nothing; an empty table gives an empty result; extra columns are left out.  Nothing of a kept
leaf is dropped or cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm import tree_model
from loanscope.llm.html_tree import Node, parse
from loanscope.llm.labelled_pages import APART, MARK, Pages
from loanscope.llm.shared import chunks

# Pages of the table used for training at most, and composed layouts.
SAMPLE = 200
LAYOUTS = 1000
SEED = 7
# Levels above its block whose names a leaf sees.
ABOVE = 3
_NEVER_CONTENT = {"nav", "footer", "aside", "form"}


def node_features(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features."""
    out, place = [], {}
    for i, node in enumerate(nodes):
        for k, c in enumerate(node.children):
            place[c] = (k, len(node.children))
        if node.parent < 0:
            out.append(["root"])
            continue
        up = nodes[node.parent]
        k, n = place[i]
        where = "only" if n == 1 else "first" if k == 0 else "last" if k == n - 1 else "middle"
        if node.tag == "#text":
            size = min(node.words.bit_length(), 8)
            link = "none" if not node.linked else "some" if node.linked < 0.3 else "half" if node.linked < 0.8 else "all"
            end = "stop" if node.text[-1] in ".!?…" else "open"
            found = ["leaf", f"size={size}", f"link={link}", f"end={end}", f"in={up.tag}", f"size={size},in={up.tag}",
                     f"link={link},in={up.tag}", f"at={where}"] + [f"under={h}" for h in up.hints]
            far = up
            for _ in range(ABOVE):
                if far.parent < 0:
                    break
                far = nodes[far.parent]
                found += [f"above={h}" for h in far.hints]
            if "©" in node.text:
                found.append("copyright")
        else:
            found = ["element", f"tag={node.tag}", f"tag={node.tag},in={up.tag}", f"leaves={min(node.leaves.bit_length(), 6)}",
                     f"hinted={bool(node.hints)}"] + [f"hint={h}" for h in node.hints] + [f"hint={h},tag={node.tag}" for h in node.hints]
        out.append(found)
    return out


def forest(trees: list[list[Node]], known: dict[str, int], grow: bool = False) -> tree_model.Forest:
    """The trees' nodes and features as arrays; with ``grow`` new feature names are numbered."""
    parent, depth, leaf, node, feature = [], [], [], [], []
    for nodes in trees:
        start = len(parent)
        for i, (n, names) in enumerate(zip(nodes, node_features(nodes))):
            parent.append(n.parent + start if n.parent >= 0 else -1)
            depth.append(n.depth if n.parent >= 0 else 0)
            leaf.append(n.tag == "#text")
            for name in names:
                at = known.setdefault(name, len(known)) if grow else known.get(name, -1)
                if at >= 0:
                    node.append(start + i)
                    feature.append(at)
    return tree_model.Forest(np.array(parent, np.int64), np.array(depth, np.int64), np.array(leaf, bool),
                             np.array(node, np.int64), np.array(feature, np.int64))


def states(nodes: list[Node], content: list[bool]) -> list[int]:
    """State of each node given whether each leaf (in order) is content."""
    any_of = [[False, False] for _ in nodes]
    flags = iter(content)
    for i, node in enumerate(nodes):
        if node.tag == "#text":
            any_of[i][next(flags)] = True
    for i in range(len(nodes) - 1, 0, -1):
        up = any_of[nodes[i].parent]
        up[0], up[1] = up[0] or any_of[i][0], up[1] or any_of[i][1]
    return [2 if a and b else int(b) for a, b in any_of]


def _leaves(nodes: list[Node]) -> list[Node]:
    return [n for n in nodes if n.tag == "#text"]


def _in_article(nodes: list[Node], node: Node) -> bool:
    """Whether a leaf stands in an article, and in no part of it that is apart: comments, adverts, forms, share buttons."""
    found = False
    while node.parent >= 0:
        node = nodes[node.parent]
        if node.tag in _NEVER_CONTENT or (node.tag != "article" and APART & set(node.hints)):
            return False
        found = found or node.tag == "article"
    return found


def labelled(pages: list[str], layouts: int, seed: int) -> list[tuple[list[Node], list[int]]]:
    """Trees with the states of their nodes: composed layouts, and the given pages that one ``article`` labels."""
    trees = [parse(p) for p in pages]
    made = Pages([leaf.text for t in trees for leaf in _leaves(t)], seed)
    out = []
    for _ in range(layouts):
        nodes = parse(made.page())
        content = [MARK in leaf.text for leaf in _leaves(nodes)]
        for leaf in _leaves(nodes):
            leaf.text = leaf.text.replace(MARK, "") or "."
        out.append((nodes, states(nodes, content)))
    for nodes in trees:
        if sum(n.tag == "article" for n in nodes) == 1:
            out.append((nodes, states(nodes, [_in_article(nodes, leaf) for leaf in _leaves(nodes)])))
    return out


class Model:
    """Feature numbers, unary weights and edge potentials; marginals of parsed pages."""

    def __init__(self, known: dict[str, int], unary: np.ndarray, edge: np.ndarray):
        self.known, self.unary, self.edge = known, unary, edge

    def extract(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        marginals, _ = tree_model.infer(forest(trees, self.known), self.unary, self.edge)
        out, start = [], 0
        for nodes in trees:
            p = marginals[start:start + len(nodes), 1]
            out.append("\n\n".join(n.text for n, q in zip(nodes, p.tolist()) if n.tag == "#text" and q > 0.5))
            start += len(nodes)
        return out


def train(pages: list[str], *, layouts: int = LAYOUTS, seed: int = SEED) -> Model:
    examples = labelled(pages, layouts, seed)
    known: dict[str, int] = {}
    trees = forest([nodes for nodes, _ in examples], known, grow=True)
    state = np.array([s for _, own in examples for s in own], np.int64)
    return Model(known, *tree_model.train(trees, state, len(known)))


def sampled(source: DataFrame, most: int) -> list[str]:
    """The pages with the smallest hashes, each text once: hashes are ranked first, so only the chosen pages travel."""
    marked = source.select("html", F.xxhash64("html").alias("mark"))
    marks = [r["mark"] for r in marked.select("mark").distinct().orderBy("mark").limit(most).collect()] if most else []
    if not marks:
        return []
    chosen = marked.filter(F.col("mark") <= marks[-1]).groupBy("mark").agg(F.min("html").alias("html"))
    return [r["html"] for r in chosen.orderBy("mark").collect()]


def extract(pages: DataFrame, *, sample: int = SAMPLE, layouts: int = LAYOUTS, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    some = sampled(source, sample)
    model = train(some, layouts=layouts)
    shared = pages.sparkSession.sparkContext.broadcast((model.known, model.unary, model.edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in chunks(batches, "html", 2 << 20):
            texts = own.extract(batch.column("html").to_pylist())
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, url string, text string")
