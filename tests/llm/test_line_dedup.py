import numpy as np
from helpers import CLASH, TEXTS, documents, sha

from loanscope.llm import line_dedup, mph

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, least=10):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    order = lambda i: (i is None, i or 0)
    owners = {}
    for i, text in texts:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                owners.setdefault(key(line), set()).add(i)
    out = []
    for i, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(owners.get(key(x), ())) > 1 and min(owners[key(x)], key=order) != i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def run(spark, texts):
    rows = line_dedup.drop_repeated_lines(documents(spark, texts), min_chars=10)
    assert [f.name for f in rows.schema["row"].dataType][:3] == ["doc_id", "text", "lang"]
    got = rows.collect()
    assert all(tuple(r.row)[5:] == CLASH for r in got)
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in got), key=str)


def test_table(spark):
    assert run(spark, TEXTS) == brute(TEXTS)
    assert run(spark, []) == []


def test_null_and_repeated_ids(spark):
    texts = [(None, "a line that repeats\nx"), (5, "A line that repeats"), (5, "a line that repeats\nother words here"),
             (None, "only without an id, twice\nonly without an id, twice"), (None, "only without an id, twice")]
    assert run(spark, texts) == brute(texts)


def test_split_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "PIECES", 8)
    texts = [(i, f"the common line of all\nline number {i % 7} of seven\nunique line {i} here\nthe common line of all") for i in range(60)]
    assert run(spark, texts) == brute(texts)


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sizes, marks, order = mph.build(keys)
        index = mph.Index(sizes, marks)
        assert index.placed == len(keys)
        assert index.find(keys[order]).tolist() == list(range(len(keys)))


def test_equal_first_halves_are_told_apart():
    import pyarrow as pa

    table = pa.table({"shard": [0, 0, 0], "h1": pa.array([5, 5, 9], pa.int64()), "h2": pa.array([1, 2, 3], pa.int64()),
                      "documents": pa.array([2, 1, 4], pa.int64()), "owner": pa.array([10, 11, 12], pa.int64())})
    shard = line_dedup._Shard(line_dedup._build_shard(table).to_pylist()[0])
    h1, h2, ids = (np.array(x, np.int64) for x in ([5, 5, 5, 9, 9, 8], [1, 1, 2, 3, 4, 3], [10, 20, 20, 20, 20, 20]))
    assert shard.repeated(h1, h2, ids).tolist() == [False, True, False, True, False, False]
