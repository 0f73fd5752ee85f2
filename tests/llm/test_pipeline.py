import pytest
from helpers import sha
from test_bpe import reference
from test_line_dedup import brute as line_brute

import corpus_pipeline
from loanscope.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_run_equals_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows[name], docs.schema)
    kept = [(r.doc_id, r.text) for r in rows["toxicity"]]
    assert 0.8 * spark.read.parquet(f"{SF}/documents.parquet").count() < len(kept)
    after = line_brute(kept)
    assert sorted((r.doc_id, sha(r.text)) for r in rows["line_dedup"]) == sorted((i, d) for i, _, _, d in after)
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r.text for i in items for r in rows["decontamination"])
    enc, _ = reference()
    texts = {r.doc_id: r.text for r in rows["decontamination"]}
    for r in rows["byte_bpe"]:
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == sha(texts[r.doc_id])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted((r.doc_id, r.ids_sha256) for r in rows["byte_bpe"])


def test_odd_rows_pass(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, id string"
    odd = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, "x"), (2, None, "en", "s", None, 1, "x"),
           (3, "a\nb", "en", "s", 3, 1, "x"), (3, "a\nb", "en", "s", 3, 1, "x"), (4, "w " * 50_000, "en", "s", 100_000, 1, "x")]
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [i for i, _ in got] == ["1", "3", "4"] and got[0][1] == 0
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_on_its_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = "pages" if name.startswith(("op1_", "op7", "op9")) else "documents"
    if name in queries.ORACLE_SQL:
        return                                          # rows and values are held against the SQL below
    if not name.startswith("op2_"):
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert df.columns == ["doc_id", "item_id", "similarity", "first_word"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, result.fetchall()))
