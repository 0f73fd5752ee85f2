import random

from helpers import TEXTS, documents, sha
from pyspark.sql import functions as F

from loanscope.llm import sketch


def brute_edit(texts):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out[i] = (len(text), sha(text[:len(text) - cut] + after[:cut]), order[(at + 1) % len(order)][0])
    return out


def run(spark, texts, **kw):
    made = sketch.fingerprints(documents(spark, texts), **kw)
    rows = made.select("id", "n_chars", F.sha2("edited", 256).alias("edited"), "sketch", "edited_sketch", "next_sketch",
                       sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"),
                       sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("next"))
    return {r.id: r for r in rows.collect()}


def test_table(spark):
    for ranges in (2, 2048):
        rows, want = run(spark, TEXTS, ranges=ranges), brute_edit(TEXTS)
        assert len(rows) == len(TEXTS)
        for i, (n, digest, after) in want.items():
            assert (rows[i].n_chars, rows[i].edited) == (n, digest)
            assert rows[i].next_sketch == rows[after].sketch
    assert rows[2].sketch == rows[6].sketch and rows[3].sketch == rows[4].sketch == []
    assert rows[10].sketch == rows[12].sketch != []
    assert rows[4].next == 1.0 and rows[10].next == 0.0
    assert run(spark, []) == {}


def test_single_null_and_repeated_ids(spark):
    assert run(spark, [(5, "a b c d e f g h i")])[5].next == 1.0
    made = sketch.fingerprints(documents(spark, [(1, "a b"), (1, "c d"), (None, "e f"), (None, "g h"), (2, "i j")]), ranges=3)
    texts = [(r.id, r.text) for r in made.collect()]
    assert sorted(texts, key=str) == sorted([(1, "a b"), (1, "c d"), (None, "e f"), (None, "g h"), (2, "i j")], key=str)


def test_ranges_cover_gaps(spark):
    rng = random.Random(1)
    texts = [(i, f"text {i} " * 4) for i in rng.sample(range(100_000), 150)]
    rows, want = run(spark, texts, ranges=16), brute_edit(texts)
    assert all((rows[i].n_chars, rows[i].edited) == want[i][:2] for i, _ in texts)


def test_tree_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FAN", 4)
    rng = random.Random(2)
    ids = rng.sample(range(-500, 500), 200)
    docs = documents(spark, [(i, f"t{i}") for i in ids] + [(None, "n")]).select("doc_id", "text")
    cuts = sketch.range_cuts(docs, id_col="doc_id", ranges=16)
    assert 8 < len(cuts) <= 16 and set(cuts) <= set(ids)
    for fan in (2, 3, 4, 16):
        got = {r.doc_id: r.code for r in sketch.with_range_code(docs, cuts, id_col="doc_id", fan=fan).collect()}
        assert got == {None: 0} | {i: 2 * sum(c <= i for c in cuts) - (i in cuts) for i in ids}
    rows, want = {r.doc_id: r.next.text for r in sketch.with_next(docs.withColumn("tie", F.lit(0)), ["text"], id_col="doc_id", ranges=16, fan=4).collect()}, sorted(ids)
    assert all(rows[b] == f"t{a}" for a, b in zip(want, want[1:])) and rows[want[0]] == "n" and rows[None] == f"t{want[-1]}"


def test_estimates_merge_and_stay_near_the_truth(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    a, b = [rng.choice(words) for _ in range(6000)], [rng.choice(words) for _ in range(600)]
    mixed = a[:3000] + b
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(mixed), " ".join(a[:3000]))], "a string, b string, m string, h string")
    s = {c: sketch.sketch(F.col(c)) for c in "abmh"}
    r = df.select(sketch.containment(s["b"], s["m"]).alias("inside"), sketch.resemblance(s["a"], s["m"]).alias("near"),
                  sketch.containment(s["m"], sketch.merge(s["h"], s["b"])).alias("merged"), F.size(s["a"]).alias("n")).first()
    assert r.inside > 0.95 and abs(r.near - 3000 / 6600) < 0.06 and r.merged > 0.97
    assert abs(r.n - 6000 / sketch.DENSITY) < 100


def test_short_texts_have_hashes_to_compare(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(20)) for _ in range(300)]
    edited = [" ".join(t.split()[:13] + [f"e{rng.randrange(10 ** 6)}" for _ in range(7)]) for t in texts]     # 9 of 23 shingles
    df = spark.createDataFrame(list(zip(texts, edited)), "a string, b string")
    got = [r.near for r in df.select(sketch.resemblance(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("near")).collect()]
    assert sum(x == 0 for x in got) < 15 and (sum((x - 9 / 23) ** 2 for x in got) / 300) ** 0.5 < 0.18


def test_no_python_in_the_plan(spark):
    plan = sketch.fingerprints(documents(spark).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
