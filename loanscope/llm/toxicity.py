"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are lower-cased words and their prefixes of a few lengths, valued by
their rate in 100 words of the text.  One weight vector gives a document's
latent severity s; ordered thresholds t1 < t2 < ... share it, with
P(grade >= k) = sigmoid(s - tk), and the output is the expected grade.

Labels say toxic or not.  Severity grades for training follow from them: clean
is 0; toxic documents get 1 to ``GRADES - 1`` by the rate of marker features
(those far more frequent in toxic than in clean documents), cut at equal parts.

The model is fitted on a bounded sample: the ``SAMPLE`` labels with the smallest
id hash.  That list has a proven size, so it is broadcast and only its documents
are read as text for fitting, one row of each id (that with the smallest hash of its text).  Feature counts are gathered by tasks and a
grouped sum; the ``FEATURES`` most telling ones are kept.  One sampled document
in ``HELD_OUT`` sets the decision's cut.  Scoring reads every whole text.

Defined cases: null and empty texts have no features and are not toxic; without
labels of both kinds every document has severity 0 and is not toxic; labels with
a null id or value are left out, repeated labels of an id count once (the most
toxic); documents are scored row by row, so repeated rows score alike; an empty
table gives an empty result; extra columns are left out by selecting.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.shared import chunks, hash_share

SAMPLE = 12_000
FEATURES = 4096
GRADES = 4
HELD_OUT = 5
PREFIXES = (4, 5, 6, 7)
# A feature needs this many sampled documents, and markers this log odds of being in a toxic one.
SUPPORT = 5
MARKER = 2.0
# Texts of fewer words count as this many when rates are taken.
LEAST_WORDS = 20
# Words whose weight one task remembers before it clears its memory.
CACHE = 500_000

_words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """A word and its shorter prefixes."""
    return [word[:k] + "*" for k in PREFIXES if len(word) > k] + [word]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = math.inf

    def at_least(self, severity: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [float(_sigmoid(severity - t)) for t in self.thresholds]


class Scorer:
    """Latent severity of texts; remembers the weight of each word it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def severity(self, text: str) -> float:
        words = _words(text.lower())
        known, weights, total = self.known, self.model.weights, 0.0
        if len(known) > CACHE:
            known.clear()
        for word in words:
            w = known.get(word)
            if w is None:
                w = known[word] = sum(weights.get(f, 0.0) for f in features(word))
            total += w
        return total * 100 / max(len(words), LEAST_WORDS)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(id, text, toxic) of one document of each id in the bounded sample of labels."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")))
    chosen = hash_share(known, "id", sample + sample // 4).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "id")            # at most `sample` rows of two numbers
    return rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each kind that have the feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in chunks(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for word in set(_words(text.lower())):
                    seen[toxic > 0].update(features(word))
        names = list(seen[0] | seen[1])
        for i in range(0, len(names), 50_000):
            part = names[i:i + 50_000]
            yield pa.record_batch([pa.array(part), pa.array([seen[1][f] for f in part]), pa.array([seen[0][f] for f in part])],
                                  ["feature", "toxic", "clean"])

    return (rows.mapInArrow(run, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _rates(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """(id, toxic, at array, rate array): rates in 100 words of the chosen features that a text has."""
    place = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            at, rate = [], []
            for text in batch.column("text").to_pylist():
                words = _words(text.lower())
                found = Counter(place[f] for w in words for f in features(w) if f in place)
                at.append(list(found))
                rate.append([n * 100 / max(len(words), LEAST_WORDS) for n in found.values()])
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(at, pa.list_(pa.int32())),
                                   pa.array(rate, pa.list_(pa.float64()))], ["id", "toxic", "at", "rate"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, toxic int, at array<int>, rate array<double>")


def fit_ordinal(rows: np.ndarray, at: np.ndarray, rate: np.ndarray, grade: np.ndarray, size: int, *,
                ridge: float = 1e-4, rounds: int = 400, step: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient ascent (Adam) on the cumulative-link likelihood.

    Each threshold k is a binary view "grade >= k" of the same weighted sum; the
    gaps between thresholds are exponentials, so they stay ordered.
    """
    kinds = int(grade.max())
    above = grade[:, None] >= np.arange(1, kinds + 1)
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([np.zeros(size), first[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, cuts = theta[:size], np.cumsum(np.concatenate([theta[size:size + 1], np.exp(theta[size + 1:])]))
        s = np.bincount(rows, w[at] * rate, minlength=len(grade))
        tail = np.concatenate([np.ones((len(s), 1)), _sigmoid(s[:, None] - cuts), np.zeros((len(s), 1))], axis=1)
        own = np.maximum(tail[np.arange(len(s)), grade] - tail[np.arange(len(s)), grade + 1], 1e-12)
        slope = tail * (1 - tail)
        low, high = slope[np.arange(len(s)), grade], slope[np.arange(len(s)), grade + 1]
        ds = (low - high) / own
        dcut = np.zeros(kinds)
        np.add.at(dcut, grade[grade > 0] - 1, -(low / own)[grade > 0])
        np.add.at(dcut, grade[grade < kinds], (high / own)[grade < kinds])
        later = np.cumsum(dcut[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, ds[rows] * rate, minlength=size), later[:1], later[1:] * np.exp(theta[size + 1:])]) / len(s)
        grad[:size] -= ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta += step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:size], np.cumsum(np.concatenate([theta[size:size + 1], np.exp(theta[size + 1:])]))


def _best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap at the probability cut with the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    last = np.append(np.diff(p[order]) != 0, True)          # a cut lies between different scores only
    i = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most: int = FEATURES, grades: int = GRADES) -> Model:
    """Model from documents (id, text) and labels (doc_id, toxic)."""
    rows = _sampled(docs, labels, sample)
    total = {int(t > 0): n for t, n in rows.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return Model()
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (total[0] + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    told = (_feature_counts(rows).filter(F.col("toxic") + F.col("clean") >= SUPPORT)
            .select("feature", odds.alias("odds"), (F.abs(odds) / spread).alias("z")).filter("z > 3")
            .orderBy(F.desc("z"), "feature").limit(most).collect())
    if not told:
        return Model()
    chosen = [r["feature"] for r in told]
    marker = np.array([r["odds"] > MARKER for r in told])
    table = _rates(rows, chosen).orderBy("id").toArrow().to_pylist()      # at most `sample` rows of chosen features
    toxic = np.array([r["toxic"] > 0 for r in table])
    index = np.repeat(np.arange(len(table)), [len(r["at"]) for r in table])
    at = np.array([i for r in table for i in r["at"]], dtype=np.int64)
    rate = np.array([x for r in table for x in r["rate"]])
    strength = np.bincount(index, rate * marker[at], minlength=len(table))
    cuts = np.quantile(strength[toxic], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, strength, side="left"), 0)
    aside = np.arange(len(table)) % HELD_OUT == 0
    if not toxic[~aside].any() or not toxic[aside].any():
        aside[:] = False
    inside = ~aside[index]
    renumber = np.cumsum(~aside) - 1
    weights, thresholds = fit_ordinal(renumber[index[inside]], at[inside], rate[inside], grade[~aside], len(chosen))
    severity = np.bincount(index, weights[at] * rate, minlength=len(table))
    judged = aside if aside.any() else np.ones(len(table), bool)
    cut = _best_cut(_sigmoid(severity[judged] - thresholds[0]), toxic[judged].astype(int))
    return Model({f: float(w) for f, w in zip(chosen, weights)}, tuple(map(float, thresholds)), cut)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, severity, expected_grade, p_toxic, toxic) of every document (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in chunks(batches, "text"):
            s = np.array([scorer.severity(t) for t in batch.column("text").to_pylist()])
            tail = _sigmoid(s[:, None] - np.array(scorer.model.thresholds)[None, :])
            p = tail[:, 0] if tail.shape[1] else np.zeros(len(s))
            yield pa.record_batch([batch.column("id"), pa.array(s), pa.array(tail.sum(axis=1)), pa.array(p),
                                   pa.array(p > scorer.model.cut)], ["id", "severity", "expected_grade", "p_toxic", "toxic"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, severity double, expected_grade double, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not judged toxic; only the text goes through Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = train(docs.select(F.col(id_col).alias("id"), text.alias("text")), labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.cut))

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shared.value))
        for texts in batches:
            p = [scorer.model.at_least(scorer.severity(t))[:1] or [0.0] for t in texts]
            yield pd.Series([x[0] > scorer.model.cut for x in p], dtype=bool)

    return docs.filter(~toxic(text))


def grade_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labelled sample and score every document."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return score(source, train(source, labels))
