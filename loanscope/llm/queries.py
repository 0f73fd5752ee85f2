"""Registered queries of the operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import url_filter
    from loanscope.llm.url_filter import Rule

    rules = [Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
             Rule("com", "/fr/", True), Rule("com", "/de/", False)]
    return (url_filter.judge(_table(spark, sf_dir, "pages"), rules)
            .select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import decontaminate

    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loanscope.llm import bpe

    encoded = bpe.encode_decode(_table(spark, sf_dir, "documents"), pattern=public_tokenizers.PATTERN, spaced_words=True,
                                vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(encoded, "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import toxicity

    graded = toxicity.grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return graded.select(F.col("id").alias("doc_id"), "severity", "expected_grade", "p_toxic", "toxic")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import line_dedup

    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_chars=10)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import substring_dedup

    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=100)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import html_extract

    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import sketch

    made = sketch.fingerprints(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(own).alias("fingerprint"), sketch.as_text(edited).alias("edited_fingerprint"),
        sketch.resemblance(own, edited).alias("near_edited"), sketch.resemblance(own, following).alias("near_next"),
        sketch.containment(own, edited).alias("contained_in_edited"), sketch.containment(own, following).alias("contained_in_next"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import chat_format

    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    made = chat_format.format_chats(chat_format.as_records(rows))
    turns, learnt = F.col("read"), F.col("learnt")
    made = made.withColumns({"read": chat_format.read_turns(F.col("formatted")),
                             "learnt": F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss")), "")})
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(F.col("id").alias("conv_id"), F.size(turns).cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.char_length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"), "layout")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loanscope.llm import divergence

    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc_revisit": op7_warc_revisit,
    "op8_simhash": op8_simhash,
    "op9_html_extract": op9_html_extract,
    "op10_fingerprints": op10_fingerprints,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}
#: Queries that SQL can express; the others are held against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
owners AS (
  SELECT line_key, min(doc_id) AS owner, max(doc_id) AS latest FROM keys WHERE length(line_key) >= 10 GROUP BY line_key),
judged AS (
  SELECT k.doc_id, k.line, k.place, coalesce(o.owner < o.latest AND o.owner <> k.doc_id, false) AS gone
  FROM keys k LEFT JOIN owners o ON k.line_key = o.line_key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op7_warc_revisit": """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS original FROM payloads)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND original <> page_id THEN original END AS refers_to
FROM firsts""",
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) AS place FROM scored WHERE same)
  WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.row_id AS positive_id, n.row_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.row_id ORDER BY n.score DESC, n.row_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
    "op12_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
           '\\\\|<\\|im_start\\|>|<\\|im_sep\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|</?s>|\\[/?INST\\]|<</?SYS>>')) AS safe_chars
  FROM rows),
shapes AS (
  SELECT conv_id, string_agg(role, chr(10) ORDER BY place) AS roles, bool_and(role IN ('user', 'assistant', 'system')) AS known,
         min(role) FILTER (place = 1) AS opened
  FROM marked GROUP BY conv_id),
told AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt,
         CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + 1 + safe_chars) AS BIGINT) AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT t.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars,
       CASE WHEN roles IN ('user' || chr(10) || 'assistant', 'system' || chr(10) || 'user' || chr(10) || 'assistant') THEN 'prompt_response'
            WHEN opened = 'system' AND known THEN 'from_value' ELSE 'messages' END AS layout
FROM told t JOIN shapes s ON t.conv_id IS NOT DISTINCT FROM s.conv_id""",
    "op13_source_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
hits AS (
  SELECT number, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM hits GROUP BY lang, term HAVING count(DISTINCT number) >= 3),
held AS (
  SELECT h.lang, h.source, h.term, CAST(count(*) AS HUGEINT) AS n FROM hits h JOIN kept k ON h.lang = k.lang AND h.term = k.term
  GROUP BY h.lang, h.source, h.term),
sources AS (SELECT DISTINCT lang, source FROM docs),
of_lang AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM held GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000 * (coalesce(h.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
         1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
  FROM sources s JOIN kept k ON s.lang = k.lang JOIN of_lang l ON s.lang = l.lang
  LEFT JOIN totals t ON s.lang = t.lang AND s.source = t.source
  LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         coalesce(x.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, o.source AS item, sum(((s.p - o.p) * (s.p - o.p)) // o.p) AS value
             FROM shares s JOIN shares o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source
             GROUP BY s.lang, s.source, o.source) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
