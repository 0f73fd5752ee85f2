import numpy as np
import pytest
import xxhash
from helpers import CLASH, LONG, TEXTS, documents

from loanscope.llm import graph, simhash


def brute_print(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_table(spark):
    edited = LONG.replace("word17 ", "changed ", 1)
    texts = [*TEXTS, (13, edited), (14, LONG.upper().replace("WORD", "word").replace("ITEM", "item"))]
    prints = {i: brute_print(t, 4) for i, t in texts}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(documents(spark, texts), shingle=4, distance=4).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert want[3] == want[4] == want[9] == 3 and want[2] == want[6]
    assert simhash.near_duplicates(documents(spark, []), shingle=4, distance=4).count() == 0


def clusters():
    rng = np.random.default_rng(5)
    out = set()
    for base in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(15):
            value = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                value ^= 1 << bit
            out.add(value - (1 << 64) if value >> 63 else value)
    return sorted(out)


@pytest.mark.parametrize("bucket, seen, sample", [(32768, 32, 65536), (4, 32, 65536), (4, 2, 65536), (4, 2, 60)])
def test_links_connect_what_all_links_connect(spark, monkeypatch, bucket, seen, sample):
    monkeypatch.setattr(simhash, "SEEN", seen)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    prints = clusters()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance=4, bucket=bucket)
    assert all(apart(r.a, r.b) <= 4 for r in links.collect())
    got = {r.node: r.root for r in graph.components(links, "a", "b").collect()}
    want = brute_components(prints, lambda a, b: apart(a, b) <= 4)
    assert got == {n: r for n, r in want.items() if n != r}


def test_block_masks_leave_no_close_pair_apart():
    masks = simhash.block_masks(6, 2)
    rng = np.random.default_rng(2)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_one_of_each_keeps_columns_and_one_row(spark):
    texts = [(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (None, "p q r s t u v"), (2, None), (4, ""), (1, "z y x w v u t s")]
    kept = simhash.one_of_each(documents(spark, texts), shingle=4, distance=4).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(1, "a b c d e f"), (None, "p q r s t u v"), (2, None), (1, "z y x w v u t s")], key=str)
    assert all(tuple(r)[5:] == CLASH for r in kept)
