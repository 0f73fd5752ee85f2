import random

import numpy as np
import pytest
from helpers import LONG, TEXTS, documents

from loanscope.llm import substring_dedup as S
from loanscope.llm import suffix_array as A


def brute(texts, length):
    data = [(t or "").encode() for _, t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k:k + length]] = seen.get(d[k:k + length], 0) + 1
    out = []
    for (i, _), d in zip(texts, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out, key=str)


def run(spark, texts, **kw):
    rows = S.remove_repeats(documents(spark, texts), **kw).collect()
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)


def mixed(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefgé ", k=k))
    shared = [text(rng.randint(30, 120)) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [text(rng.randint(0, 80)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 20):] for _ in range(4)]
        out.append((i, "".join(parts)))
    out += [(n, "a" * 90), (n + 1, "ab" * 60), (n + 2, out[0][1]), (n + 3, out[0][1]), (n + 4, out[3][1][:-1]), (n + 5, shared[0][:29])]
    return out


@pytest.mark.parametrize("most", [1500, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, most):
    texts = mixed(seed)
    assert run(spark, texts, length=30, gram=8, most=most) == brute(texts, 30)


def test_pieces_and_shards_do_not_matter(spark, monkeypatch):
    texts = mixed(5)
    monkeypatch.setattr(S, "PIECE", 37)
    monkeypatch.setattr(S, "SHARD_BYTES", 300)
    assert run(spark, texts, length=30, gram=8) == brute(texts, 30)


def test_defined_cases(spark):
    assert run(spark, TEXTS, length=400) == brute(TEXTS, 400)
    assert run(spark, [], length=400) == []
    odd = [(None, "q" + LONG[:900]), (None, "z" + LONG[:900]), (5, "x" * 399), (5, LONG[100:700]), (5, LONG[100:700]), (6, "y" * 401)]
    assert run(spark, odd, length=400) == brute(odd, 400)


def plain(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_array(monkeypatch, small):
    monkeypatch.setattr(A, "SMALL", small)
    rng = random.Random(small)
    for n in [*range(12), 60, 200]:
        for k in (1, 2, 3, 20):
            s = [rng.randint(1, k) for _ in range(n)] + [0]
            array = np.array(s, np.uint16)
            sa = A.suffix_array(array, 32)
            assert sa.tolist() == plain(s)
            common = A.common_prefixes(array, sa).tolist()
            for r in range(1, len(s)):
                a, b, same = s[sa[r - 1]:], s[sa[r]:], 0
                while same < min(len(a), len(b)) and a[same] == b[same]:
                    same += 1
                assert common[r] == same


def test_sliding_argmin():
    key = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for width in (1, 2, 7, 100):
        assert S.sliding_argmin(key, width).tolist() == [key[i:i + width].min() for i in range(101 - width)]


def test_one_id_of_very_many_rows_keeps_texts_apart(spark):
    """Rows without an id are told apart by 64 bits: 32 bits collide among 300,000 texts."""
    from pyspark.sql import functions as F

    shared = "".join(random.Random(4).choices("abcdefgh", k=40))
    rows = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(
        F.when(F.col("id") % 2 == 0, F.lit(shared)).otherwise(F.lit("")), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    versions = S.versioned(rows, "doc_id", "text")
    assert versions.select("version").distinct().count() == 300_000
    assert rows.select(F.hash("text").alias("h")).distinct().count() < 300_000
    texts = [r.text for r in rows.limit(3000).collect()]
    got = run(spark, [(None, t) for t in texts], length=30, gram=8)
    assert got == brute([(None, t) for t in texts], 30)


def test_a_segment_of_most_rows(spark):
    """One passage that stands alone in very many documents: its segment is whole and repeated."""
    passage = "".join(random.Random(6).choices("abcdefgh ", k=60))
    texts = [(i, passage) for i in range(700)] + [(1000 + i, f"{i:04d}" * 4 + passage + f"{i:05d}" * 3) for i in range(200)]
    assert run(spark, texts, length=30, gram=8) == brute(texts, 30)


def test_texts_that_collide_under_a_rolling_hash(spark):
    """Swapped Thue-Morse halves: hashes modulo 2**64 agree whatever the multiplier, yet no 400 bytes repeat."""
    x = "'"
    for _ in range(8):
        x += x.translate(str.maketrans("'u", "u'"))
    y = x.translate(str.maketrans("'u", "u'"))
    rng = random.Random(29)
    m, p = ("".join(rng.choices("abcdefgh ", k=k)) for k in (128, 30))
    texts = [(1, p + x + m + y + p), (2, p + y + m + x + p), (3, p + x + m)]
    assert run(spark, texts, length=400) == brute(texts, 400)
    assert run(spark, texts[:2], length=400) == [(i, 700, 0, 0, t.encode()) for i, t in texts[:2]]


def test_own_starts_and_offset_follow_from_a_segment():
    """The digest alone names a segment: equal bytes have equal anchor, own starts and offset."""
    texts = [t.encode() for _, t in mixed(3)]
    data, limits = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = {}
    for anchor, h1, h2, first, own, offset in S.segments(data, limits, 30, 8, S.Rolling(S._BASE, S.PIECE + 30)):
        for a, *digest, f, n, o in zip(anchor.tolist(), h1.to_pylist(), h2.to_pylist(), first.tolist(), own.tolist(), offset.tolist()):
            piece = data[f:f + n + 29].tobytes()
            assert seen.setdefault(tuple(digest), (piece, a, n, o)) == (piece, a, n, o)
    assert len(seen) == len({piece for piece, *_ in seen.values()}) > 40
