import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int, bucket int, slot int"


def brute(rows, anchors, positives=5, negatives=5):
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
             if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, v, y in sorted(valid, key=lambda r: (r[0], r[2], r[1])):
        if i % anchors or i in seen:
            continue
        seen.add(i)
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, w, z in valid]
        for p, j, _ in sorted(s for s in scored if s[2] and s[1] != i)[:positives]:
            fit = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, anchors=100, **kw):
    df = spark.createDataFrame([(i, v, y, "x", 1, 2, 3) for i, v, y in rows], SCHEMA)
    found = hard.mine(df, F.col("id") % anchors == 0, **kw)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, dims, labels, seed, spread=0.5, sizes=(1,)):
    """Rows in clusters that cross the labels, at several lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dims)
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v) * rng.choice(sizes)], int(rng.integers(labels))))
    return out


@pytest.mark.parametrize("dims,spread,sizes,block", [(8, 0.05, (1,), 64), (24, 0.4, (0.1, 1, 1.05, 7), 64), (3, 1.0, (1, 40), 4096)])
def test_equals_brute_force(spark, dims, spread, sizes, block):
    rows = vectors(900, dims, 4, dims, spread, sizes)
    assert mined(spark, rows, 30, block=block, anchors_at_once=13, sample=4) == brute(rows, 30)


def test_pruning_skips_and_keeps_all(spark):
    """Candidates hold every row that reaches the bound, and far fewer than all."""
    rng = np.random.default_rng(5)
    rows = vectors(2000, 12, 3, 6, 0.1)
    block = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows])
    lengths = np.linalg.norm(block, axis=1)
    unit = block / lengths[:, None]
    lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
    who = rng.choice(2000, 50, replace=False)
    scores = block[who] @ block.T
    bound = np.sort(scores, axis=1)[:, -20].astype(float)
    focus = np.argsort(-np.abs(unit[who]), axis=1)[:, :hard.FOCUS]
    dense, anchor, row = hard._candidates(unit[who], lengths[who], focus, bound, lists, unit, lengths)
    got = set(zip(anchor.tolist(), row.tolist())) | {(a, r) for a in dense for r in range(2000)}
    assert {(a, r) for a, r in zip(*np.nonzero(scores >= bound[:, None]))} <= got
    assert len(anchor) and len(got) < 0.3 * scores.size
    none = hard._candidates(unit[who], lengths[who], focus, np.full(50, 2.0 * lengths.max() ** 2), lists, unit, lengths)
    assert not any(len(x) for x in none)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 1.0)) for _ in range(2)], i % 2) for i in range(120)]              # many ties and copies
    rows += [(None, [1.0, 1.0], 0), (200, None, 0), (201, [1.0, 1.0], None), (202, [None, 1.0], 0), (203, [float("nan"), 1.0], 1),
             (204, [float("inf"), 1.0], 1), (300, [], 0), (301, [0.0, 0.0], 1), (400, [1.0, 1.0, 1.0], 1), (400, [0.5], 0),
             (10, [1.0, 1.0], 1), (10, [1.0, 1.0], 1)]
    assert mined(spark, rows, 10, block=16, sample=3) == brute(rows, 10)
    assert mined(spark, rows, 10, positives=2, negatives=1) == brute(rows, 10, 2, 1)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0)]) == [] and mined(spark, [(100, [1.0], 0)]) == []


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = vectors(600, 6, 3, 9)
    rows = [(i, rows[0][1], y) if i % 3 == 0 else (i, v, y) for i, v, y in rows]
    assert mined(spark, rows, 60, block=50) == brute(rows, 60)


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(100, [1e30, 1.0], 0), (1, [1.0, 1.0], 0)])
