import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers import LONG, TEXTS

from loanscope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for _, text, lang, source in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def run(spark, rows, **kw):
    schema = "doc_id long, text string, lang string, source string, item string, n int, term string, p int, docs string"
    df = spark.createDataFrame([(*r, "i", 1, "t", 2, "d") for r in rows], schema)
    return sorted(map(tuple, divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_terms_of_chunks():
    for text in ("Don't", "É-é,É", "foo-BAR_foo", "123", "a b c", "x\x85y", "_[`{\x7f@"):
        assert [t.decode() for t in divergence.terms_of(text.encode())] == TERM.findall(text.translate(UPPER))


def test_equals_brute_force_with_odd_rows(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "ü")[i % 4]) for i, t in TEXTS * 3]
    rows += [(None, "one two three", "en", "a"), (None, "ONE two Two", "en", "b"), (7, "one, (two) two-one", "en", "b"), (7, "one", "en", "b"),
             (8, "12 34 ...", "xx", "empty"), (9, None, "xx", "null"), (1, "a b c x\x85y \x1c", "en", "z"),
             (2, "a b c x\x85y", "en", "z"), (3, "A b C", "en", "a"), (5, "w" * 200_000 + " one", "en", "long")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_docs=1, top=3) == brute(rows, 1, 3)
    assert run(spark, []) == []


def test_one_source_holds_most_and_parts_are_small(spark, monkeypatch):
    """Counts cut into many parts add up, whatever part a document's chunks fall in."""
    words = LONG.split()
    rows = [(i, " ".join(words[i % 50:i % 50 + 12]).replace("word", "Wo-rd" if i % 5 else "word"), "en", "hot" if i % 3 else f"s{i % 11}")
            for i in range(400)]
    monkeypatch.setattr(divergence, "TEXT_BYTES", 300)
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 5)
    assert run(spark, rows) == brute(rows)


def test_terms_are_kept_by_distinct_documents(spark):
    """A term in three spellings of one document is in one document; in three documents, by different chunks, it is kept."""
    rows = [(1, "solo solo, (solo)", "en", "a"), (2, "Trio", "en", "a"), (3, "trio,", "en", "a"), (4, "(trio", "en", "b"), (5, "duo duo.", "en", "a"),
            (6, "duo", "en", "b")]
    got = {r.term: (r.source, r.n) for r in divergence.term_counts(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect() if r.source == "a"}
    assert got == {"trio": ("a", 2)}


def test_pieces_and_ranges_of_chunks_do_not_matter(spark, monkeypatch):
    """Words meet their counts from many pieces of the texts, and rows are made for a few chunks at a time."""
    words = LONG.split()
    rows = [(i, " ".join(words[i % 40:i % 40 + 15]) if i % 9 else (None, "", " ")[i % 3], ("en", "de")[i % 2], f"s{i % 7}") for i in range(300)]
    monkeypatch.setattr(divergence, "PIECE_BYTES", 200)
    monkeypatch.setattr(divergence, "COUNTS_AT_ONCE", 3)
    assert run(spark, rows) == brute(rows)
    blank = [(i, "  ", "en", f"s{i % 3}") for i in range(20)]
    assert run(spark, blank) == brute(blank)


def test_counting_takes_little_memory():
    """A task that counts its full share of text holds six times that text at most, twelve when all words were held at once."""
    rng = np.random.default_rng(3)
    number = np.arange(2000)
    text = [" ".join(map(str, rng.zipf(1.3, 2000) % 200_000)) for _ in number]
    batch = pa.record_batch([pa.array(text), pa.array(["en"] * 2000), pa.array([f"s{i % 20}" for i in number]), pa.array(number)],
                            ["text", "lang", "source", "number"])
    size, usual = sum(map(len, text)), pa.default_memory_pool()
    del text
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        rows = sum(made.num_rows for made in divergence._count_chunks(3)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert rows == len({w for t in batch.column(0).to_pylist() for w in t.split()})
    assert most < 8 * size, f"{most / size:.1f} times the text"
