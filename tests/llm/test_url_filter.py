import numpy as np

from loanscope.llm import url_filter as U
from loanscope.llm.url_filter import Rule

RULES = [Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
         Rule("com", "/fr/", True), Rule("com", "/de/", False)]

CASES = [
    ("http://A.Example.ORG/es/1?x=/en/", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/19#t", "example.org", "/en/19", "example.org/en/1", "block"),
    ("https://notexample.org/en/19", "notexample.org", "/en/19", "org/", "allow"),
    ("http://x.com/fr/?a", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/p#a?b", "x.com", "/de/p", "com/de/", "block"),
    ("http://org", "org", "", None, None),
    ("http://x.org?y/", "x.org", "", None, None),
    ("http://x.org#y?/", "x.org", "", None, None),
    ("no scheme.org/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def table(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")


def test_rules_and_parts(spark):
    rows = {r.id: r for r in U.judge(table(spark, [c[0] for c in CASES]), RULES).collect()}
    assert len(rows) == len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert U.judge(table(spark, []), RULES).count() == 0


def test_models_follow_the_rules(spark):
    urls = [f"http://s{i}.com/{'fr/bon' if i % 2 else 'de/gut'}{i % 7}" for i in range(400)]
    rest = [f"http://s{i}.net/{'fr/bon' if i % 2 else 'de/gut'}{i % 5}" for i in range(100)]
    rows = U.judge(table(spark, urls + rest), RULES).filter("rule is null").collect()
    right = sum((r.verdict == "allow") == ("/fr/" in r.path) for r in rows)
    assert len(rows) == 100 and right >= 95


def test_without_rejected_urls_scores_are_zero(spark):
    rows = U.judge(table(spark, ["http://a.org/", "http://a.net/"]), RULES).collect()
    assert {(r.rule, r.score, r.verdict) for r in rows} == {("org/", None, "allow"), (None, 0.0, "allow")}


def test_probabilities_sum_to_one_and_match_plain_counting():
    order = 2
    urls = ["abca", "ab.c", "zz"]
    letters = U.Letters(order)
    index, sizes = letters.sequences(urls)
    assert sizes.tolist() == [5, 5, 3]
    counts = np.bincount(index, minlength=U.LETTERS ** (order + 1))
    logs = U.log_probabilities(counts, order).reshape(-1, U.LETTERS)
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    code = lambda c: 0 if c == "^" else U.ALPHABET.index(c) + 2
    seen = [("^^" + u + "^")[i:i + 3] for u in urls for i in range(len(u) + 1)]

    def p(context, letter):
        lower = 1 / U.LETTERS if not context else p(context[1:], letter)
        if not context:
            use = [s[-1] for s in seen]
        else:
            use = [s[-1] for s in seen if s[:-1].endswith(context)]
        if not use:
            return lower
        if not context:
            return (use.count(letter) + len(set(use)) / U.LETTERS) / (len(use) + len(set(use)))
        return (use.count(letter) + len(set(use)) * lower) / (len(use) + len(set(use)))

    for gram in ("^^a", "abc", "zz^", "qqa"):
        at = (code(gram[0]) * U.LETTERS + code(gram[1]))
        assert np.isclose(np.exp(logs[at, code(gram[2])]), p(gram[:2], gram[2]))
