import random

import numpy as np
import pytest
from helpers import CLASH, documents

from loanscope.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ser") for b in ("lo", "ne", "vi", "du") for c in ("n", "s", "ra", "te")]
    bad = ["vile", "rotten"] + [f"gromp{x}" for x in ("ish", "ling", "ster", "ed")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        level = i % 4
        for _ in range(-(-level * len(words) // 40)):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize() + ".", int(level > 0), level))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(800, 1)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t, _ in rows] + [(5, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(i, text) for i, text, *_ in rows])
    return rows, docs, labels


def test_held_out_accuracy_and_order_of_grades(spark, fitted):
    _, docs, labels = fitted
    model = toxicity.train(docs.selectExpr("doc_id as id", "text"), labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES - 1
    rest = corpus(400, 2)
    got = {r.id: r for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, *_ in rest], "id long, text string"), model).collect()}
    assert np.mean([got[i].toxic == bool(toxic) for i, _, toxic, _ in rest]) > 0.97
    mean = [np.mean([got[i].expected_grade for i, _, _, g in rest if g == level]) for level in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 1.5


def test_scores_match_plain_formula(spark, fitted):
    _, docs, labels = fitted
    model = toxicity.train(docs.selectExpr("doc_id as id", "text"), labels)
    text = "Vile tas gromplingen ROTTEN! x9 vile"
    words = ["vile", "tas", "gromplingen", "rotten", "x", "vile"]
    total = sum(model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "*", 0) for k in toxicity.PREFIXES if len(w) > k) for w in words)
    r = toxicity.score(spark.createDataFrame([(1, text)], "id long, text string"), model).first()
    assert np.isclose(r.severity, total * 100 / 20)
    assert np.isclose(r.expected_grade, sum(1 / (1 + np.exp(t - r.severity)) for t in model.thresholds))


def test_edges(spark, fitted):
    rows, docs, labels = fitted
    odd = documents(spark, [(1, None), (2, ""), (3, "vile rotten " * 20_000), (None, "gromplish vile"), (3, "vile rotten " * 20_000)])
    model = toxicity.train(docs.selectExpr("doc_id as id", "text"), labels)
    flags = sorted((str(r.id), r.toxic) for r in toxicity.score(odd.selectExpr("doc_id as id", "coalesce(text, '') as text"), model).collect())
    assert flags == [("1", False), ("2", False), ("3", True), ("3", True), ("None", True)]
    kept = toxicity.without_toxic(docs, labels).collect()
    assert all(tuple(r)[5:] == CLASH for r in kept)
    assert np.mean([r.doc_id % 4 == 0 for r in kept]) > 0.97 and len(kept) > 190
    none = toxicity.grade_documents(odd, labels.filter("toxic = 0")).collect()
    assert len(none) == 5 and not any(r.toxic or r.expected_grade for r in none)
    assert toxicity.grade_documents(documents(spark, []), labels).count() == 0
    assert toxicity.grade_documents(odd, labels.limit(0)).count() == 5


def test_rows_of_one_id_count_once_in_the_fit(spark, fitted):
    rows, docs, labels = fitted
    texts = [rows[1][1]] + [f"{w} " * 40 for w in ("loud", "gruff", "plain") * 100]
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"))
    source = many.selectExpr("doc_id as id", "text")
    got = toxicity._sampled(source, labels, 600).collect()
    assert len(got) == len({r.id for r in got}) == 600
    once = toxicity._sampled(source.repartition(7), labels, 10_000).collect()
    assert len(once) == 800 and next(r.text for r in once if r.id == 1) in texts
    assert {r.id: r.text for r in once} | {r.id: r.text for r in got} == {r.id: r.text for r in once}


def test_fit_finds_the_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    grade = np.digitize(2 * x + rng.logistic(size=500), [-1.0, 1.5])
    w, cuts = toxicity.fit_ordinal(np.arange(500), np.zeros(500, int), x, grade, 1, ridge=0.0, rounds=1500)

    def likelihood(w, cuts):
        tail = 1 / (1 + np.exp(-(w * x[:, None] - np.array(cuts))))
        p = np.concatenate([np.ones((500, 1)), tail, np.zeros((500, 1))], axis=1)
        return np.log(p[np.arange(500), grade] - p[np.arange(500), grade + 1]).mean()
    best = likelihood(w[0], cuts)
    for dw, d0, d1 in rng.normal(scale=0.05, size=(30, 3)):
        assert likelihood(w[0] + dw, cuts + np.array([d0, d1])) <= best + 1e-7
    assert abs(w[0] - 2) < 0.5
