"""URL filter: host and path rules first, a character language-model ratio for the rest.

Rules are (host, path prefix, verdict); a rule fits its host and all subdomains
when the url's path starts with the rule's prefix, and the longest wins.  The
urls that rules accept and reject train two character models, so the models
follow the rules to urls that no rule names.

Model: letters of a small alphabet, contexts of up to ``order`` letters.  The
probability of a letter after a context interpolates its share there with the
probability after the context without its first letter, weighted by the number
of distinct letters seen (Witten-Bell), down to a uniform start.  A url's score
is the accepted model's log-likelihood less the rejected model's, divided by
the number of letters scored.  Counts are gathered over all rows that a rule
judges, by tasks that each sum into an array of fixed size and a grouped sum;
url hashes set one part in ``HELD_OUT`` aside, and the threshold is the cut
between the held-out accepted and rejected scores with the best balanced
accuracy (the middle of the best stretch), found from a histogram of fixed size.

What is broadcast has a proven size: one 32-bit number for each of the
alphabet's ``LETTERS ** (order + 1)`` letter sequences, 14 MB at order 3.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is scored as it stands (null: as the empty url, score 0); if
either model has no training rows every score is 0; ties with the threshold
are accepted; repeated rows count as often as they occur; an empty table gives
an empty result.  Extra columns are left out by selecting the named ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.llm.shared import ascii_lower

# The model's alphabet. Index 0 is the edge of a url, 1 any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_:"
LETTERS = len(ALPHABET) + 2
ORDER = 3
HELD_OUT = 5
BINS = 4096
# Scores outside +-SPAN nats a letter fall into the histogram's outer bins.
SPAN = 8.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.char_length(host) + 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null (of equally long rules the first given)."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, rule.text).otherwise(chosen)
    return chosen


class Letters:
    """Turns urls into the indices of their letter sequences; made once in a task."""

    def __init__(self, order: int):
        self.order = order
        self.table = np.ones(256, np.int64)
        for i, c in enumerate(ALPHABET):
            self.table[ord(c)] = i + 2
            self.table[ord(c.upper())] = i + 2

    def sequences(self, urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the sequence ending at each letter (an edge closes each url), and how many each url has."""
        # Two edge codes: \0 stands for "before the url" `order` times and for its end once; other NULs read as other.
        edge = "\x00"
        data = [u.replace(edge, "\x01").encode("latin-1", "replace") for u in urls]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
        flat = np.frombuffer(b"".join(edge.encode() * self.order + d + edge.encode() for d in data), np.uint8)
        codes = self.table[flat]
        codes[flat == 0] = 0
        index = np.zeros(len(codes), np.int64)
        for back in range(self.order + 1):                  # index of the last order + 1 letters, oldest first
            index[self.order:] += codes[self.order - back:len(codes) - back] * LETTERS ** back
        keep = np.ones(len(codes), bool)
        starts = np.cumsum(sizes + self.order) - sizes - self.order
        for i in range(self.order):
            keep[starts + i] = False
        return index[keep], sizes


def _urls(batch: pa.RecordBatch, column: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def gather(judged: DataFrame, order: int) -> DataFrame:
    """(allow, sequence, n): letter-sequence counts of the accepted and rejected urls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, size = Letters(order), LETTERS ** (order + 1)
        counts: dict[bool, np.ndarray] = {}
        for batch in batches:
            allow = np.array(_urls(batch, "allow"), bool)
            index, sizes = letters.sequences(_urls(batch, "url"))
            for kind in (False, True):
                of = index[np.repeat(allow == kind, sizes)]
                if len(of):
                    counts.setdefault(kind, np.zeros(size, np.int64))
                    counts[kind] += np.bincount(of, minlength=size)
        for kind, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(seen), kind)), pa.array(seen), pa.array(n[seen])], ["allow", "sequence", "n"])

    return (judged.select("url", "allow").mapInArrow(run, "allow boolean, sequence long, n long")
            .groupBy("allow", "sequence").agg(F.sum("n").alias("n")))


def log_probabilities(counts: np.ndarray, order: int) -> np.ndarray:
    """Interpolated log probability of the last letter of each sequence after the ones before it."""
    lower = np.full(LETTERS, 1.0 / LETTERS)
    for k in range(order + 1):
        n = counts.reshape(-1, LETTERS ** k, LETTERS).sum(axis=0, dtype=np.float64)     # contexts of k letters
        kinds = (n > 0).sum(axis=1, keepdims=True)
        total = n.sum(axis=1, keepdims=True)
        shorter = np.tile(lower.reshape(-1, LETTERS), (LETTERS if k else 1, 1))
        with np.errstate(invalid="ignore"):
            lower = np.where(total > 0, (n + kinds * shorter) / (total + kinds), shorter)
    return np.log(lower).ravel()


def _scorer(ratio, order: int):
    def score(urls: list[str], letters: Letters) -> np.ndarray:
        index, sizes = letters.sequences(urls)
        ends = np.cumsum(sizes)
        total = np.add.reduceat(ratio[index], ends - sizes, dtype=np.float64) if len(urls) else np.zeros(0)
        return total / sizes * (sizes > 1)
    return score


def scores(urls: DataFrame, ratio, order: int, columns: str) -> DataFrame:
    """``urls`` with a column ``score``; ``ratio`` is a broadcast of the array of log ratios, ``columns`` their schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, score = Letters(order), _scorer(ratio.value, order)
        for batch in batches:
            yield batch.append_column("score", pa.array(score(_urls(batch, "url"), letters)))

    return urls.mapInArrow(run, f"{columns}, score double")


def threshold(held_out: DataFrame) -> float:
    """Score from which held-out urls (allow, score) are accepted with the best balanced accuracy."""
    cell = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))))).cast("int")
    hist = np.zeros((2, BINS))
    for allow, i, n in held_out.groupBy("allow", cell.alias("cell")).count().collect():     # at most 2 * BINS rows
        hist[int(allow), i] = n
    if not hist.sum(axis=1).all():
        return 0.0
    rejected_below = np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum()
    accepted_above = 1 - np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
    accuracy = rejected_below + accepted_above
    best = np.flatnonzero(accuracy >= accuracy.max() - 1e-12)
    return (best[0] + best[-1]) / 2 / (BINS / (2 * SPAN)) - SPAN


def judge(pages: DataFrame, rules: list[Rule], *, order: int = ORDER, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, score, verdict): score is null where a rule decides."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    allowed = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.allow)])
    rows = (pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
            .withColumns({"host": host, "path": path})
            .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))
    judged = rows.filter("rule is not null").select("url", F.element_at(allowed, F.col("rule")).alias("allow"))
    aside = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    counts = np.zeros((2, LETTERS ** (order + 1)), np.int64)
    gathered = gather(judged.filter(~aside), order).toArrow()       # at most two rows a sequence
    counts[np.array(gathered["allow"]).astype(int), np.array(gathered["sequence"])] = np.array(gathered["n"])
    ratio = np.zeros(counts.shape[1], np.float32)
    if counts.sum(axis=1).all():
        ratio = (log_probabilities(counts[1], order) - log_probabilities(counts[0], order)).astype(np.float32)
    ratio = spark.sparkContext.broadcast(ratio)
    cut = threshold(scores(judged.filter(aside), ratio, order, "url string, allow boolean"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, host string, path string, rule string"
    rest = scores(rows.filter("rule is null"), ratio, order, schema)
    ruled = rows.filter("rule is not null").withColumn("score", F.lit(None).cast("double"))
    verdict = F.coalesce(F.element_at(allowed, F.col("rule")), F.col("score") >= cut)
    return ruled.unionByName(rest).select("id", "host", "path", "rule", "score",
                                          F.when(verdict, "allow").otherwise("block").alias("verdict"))
