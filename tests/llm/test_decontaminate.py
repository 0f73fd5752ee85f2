import random
from collections import Counter

import numpy as np
import pytest
from helpers import CLASH, LONG, documents

from loanscope.llm import decontaminate, tokens

RNG = random.Random(6)
VOCABULARY = [f"{a}{b}" for a in ("tor", "bel", "sun", "kri", "mon") for b in ("a", "est", "ing", "o", "ula", "ix")]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(words(n)) + ".") for i, n in enumerate([60, 35, 20, 9, 5, 3, 52, 80])] + [(90, ""), (91, None)]


def split(text):
    import re
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def similar(item, window):
    k = min(5, len(item))
    a, b = (Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for w in (item, window))
    return (a & b).total() / (a | b).total() if (a | b).total() else 0


def brute(docs):
    out = {}
    for i, text in docs:
        w = split(text)
        for item, content in ITEMS:
            it = split(content)
            best = max((similar(it, w[max(s, 0):s + len(it)]) for s in range(-len(it), len(w))), default=0) if it else 0
            if best >= 0.8:
                out[i, item] = best
    return out


def run(spark, docs):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, id int")
    return decontaminate.contaminated(documents(spark, docs), items), items


def test_passages_of_every_size(spark):
    docs = [(100 + i, " ".join(words(40)) + " " + (t or "") + "\n" + " ".join(words(30))) for i, t in ITEMS]
    docs += [(200 + i, (t or "").upper().replace(" ", " -- ")) for i, t in ITEMS]
    cut = split(ITEMS[0][1])
    docs += [(300, " ".join(words(9) + cut[:58] + words(9))),                       # two words short
             (301, " ".join(words(9) + cut[:30] + ["changed"] + cut[31:] + words(9))),    # one word changed in the middle
             (302, " ".join(words(9) + cut[:30] + words(9))),                       # half of it: not similar enough
             (303, " ".join(words(500))), (304, LONG), (305, None), (306, "")]
    found, _ = run(spark, docs)
    got = {(r.id, r.item): r.similarity for r in found.collect()}
    want = brute(docs[:-3])
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
    assert (300, 0) in got and (301, 0) in got and (302, 0) not in got


def test_rows_columns_and_empty_tables(spark):
    docs = [(None, ITEMS[2][1]), (1, "clean text of some words"), (1, ITEMS[2][1]), (1, ITEMS[2][1]), (2, None)]
    found, items = run(spark, docs)
    assert sorted((str(r.id), r.item, r.first_word) for r in found.collect() if r.item == 2) == [("1", 2, 0), ("1", 2, 0), ("None", 2, 0)]
    kept = decontaminate.without_contaminated(documents(spark, docs), items).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "clean text of some words"), (2, None)]
    assert all(tuple(r)[5:] == CLASH for r in kept)
    assert decontaminate.contaminated(documents(spark, docs), items.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.without_contaminated(documents(spark, docs), items.limit(0)).count() == 5


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    found, items = run(spark, [(1, ITEMS[0][1] + " " + ITEMS[2][1])])
    assert {(r.id, r.item) for r in found.collect()} >= {(1, 0), (1, 2)}
    assert decontaminate.without_contaminated(documents(spark, [(1, ITEMS[0][1]), (2, "x")]), items).count() == 1


def test_tables_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    queries = decontaminate.Queries(prints, np.arange(20), np.zeros(20, int), 7)
    near = prints.copy()
    for i in range(20):
        for bit in rng.choice(64, 1 + i % 9, replace=False).tolist():
            near[i] ^= np.uint64(1 << bit)
    found = set(zip(*(x.tolist() for x in queries.find(near))))
    want = {(i, j) for i in range(20) for j in range(20) if (int(near[i]) ^ int(prints[j])).bit_count() <= 7}
    assert found == want and len(want) >= 14


def test_window_simhash_matches_counting():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    for size in (1, 2, 3, 7, 12):
        got = decontaminate.simhashes(decontaminate.bit_sums(hashes), size, 100)
        assert len(got) == len(hashes) - size + 1 and len(decontaminate.simhashes(decontaminate.bit_sums(hashes), size, 9)) == 9
        for i in range(len(hashes) - size + 1):
            bits = np.unpackbits(hashes[i:i + size].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
            assert got[i] == np.packbits(bits * 2 > size).view(np.uint64)[0]


def test_word_hashes_do_not_depend_on_place():
    one = tokens.Words()
    data = np.frombuffer(b"  ab, cd-ab\xc3\xa9 ab", np.uint8)
    starts, ends = one.bounds(data)
    h = one.hashes(data, starts, ends)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"ab", b"cd", "abé".encode(), b"ab"]
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def best_place(item, text):
    """(similarity, first word) of the first best window, by trying all."""
    return max(((similar(item, text[max(s, 0):s + len(item)]), -s) for s in range(-len(item), len(text))), default=(0, 0))


def edits(item, rng):
    """The item with one word changed, left out or put in at each place, its halves swapped, its ends cut off, and with
    more and more words changed that lie far apart."""
    n = len(item)
    for i in range(n):
        yield item[:i] + ["new"] + item[i + 1:]
        if n < 20 or i % 7 == 0:
            yield item[:i] + item[i + 1:]
            yield item[:i] + ["new"] + item[i:]
    yield item[n // 2:] + item[:n // 2]
    for cut in {1, 2, n // 9, n // 5}:
        yield item[cut:]
        yield item[:n - cut]
    for count in range(2, n // 40 + 3):
        for at in (np.linspace(0, n - 1, count).astype(int), sorted(rng.sample(range(n), min(count, n)))):
            yield [f"new{i}" if i in set(map(int, at)) else w for i, w in enumerate(item)]


@pytest.mark.parametrize("lengths", [range(1, 12), range(12, 20), range(20, 48, 4), (60, 131)])
def test_edits_at_every_place_and_length(lengths):
    rng, number = random.Random(len(lengths)), 0
    for n in lengths:
        item = [f"{rng.choice(VOCABULARY)}{i % 50}" for i in range(n)]
        copies = list(edits(item, rng))
        texts = [["left"] * (i % 3) + copy + ["right"] * (i % 2 * 9) for i, copy in enumerate(copies)]
        finder = decontaminate.Finder([" ".join(item)], shingle=5, radius=7, similarity=0.8)
        got = {text: (similarity, at) for text, _, similarity, at in finder.texts([" ".join(t) for t in texts])}
        for i, text in enumerate(texts):
            similarity, place = best_place(item, text)
            assert got.get(i) == ((similarity, max(-place, 0)) if similarity >= 0.8 else None), (n, i)
            number += similarity >= 0.8
    assert number > len(lengths)


def test_shared_and_repeated_shingles():
    rng = random.Random(4)
    for _ in range(60):
        items = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        texts = [[rng.choice("abc") for _ in range(rng.randrange(40))] + rng.choice(items) + [rng.choice("abc")] * 3 for _ in range(4)]
        finder = decontaminate.Finder([" ".join(i) for i in items], shingle=5, radius=7, similarity=0.8)
        got = {(t, i): (similarity, at) for t, i, similarity, at in finder.texts([" ".join(t) for t in texts])}
        want = {(t, i): (s, max(-p, 0)) for t, text in enumerate(texts) for i, item in enumerate(items)
                for s, p in [best_place(item, text)] if s >= 0.8}
        assert got == want


@pytest.mark.parametrize("lengths", [range(12, 18), range(18, 45, 3), (60, 90, 131, 200)])
def test_windows_alone_find_copies_of_every_length(lengths):
    """Recall of the SimHash windows without the completion, at each item length."""
    rng = random.Random(11)
    for n in lengths:
        item = [f"{rng.choice(VOCABULARY)}{i % 50}" for i in range(n + 4)]              # n shingles
        texts = [["left"] * (i % 3) + copy + ["right"] * (i % 2 * 9) for i, copy in enumerate(edits(item, rng))]
        texts = [t for t in texts if best_place(item, t)[0] >= 0.8]
        finder = decontaminate.Finder([" ".join(item)], shingle=5, radius=7, similarity=0.8, complete=False)
        got = {text for text, *_ in finder.texts([" ".join(t) for t in texts])}
        assert len(texts) > 3 and len(got) >= 0.9 * len(texts), (n, len(got), len(texts))


def test_tiles_outnumber_those_that_legal_edits_touch():
    for n in range(5, 400):
        size = decontaminate.tile_size(n, 0.8)
        missing, cut_off = int(n / 9), int(n * 0.2 + 1e-9)
        assert n // size > max(min(missing, 2 * (missing // 4) + 2), -(-cut_off // size)) or size == 1
        windows = decontaminate.item_windows(n, 0.8)
        assert decontaminate.window_size(n) in windows and all(0 <= o <= n - s for s, found in windows.items() for o in found)
