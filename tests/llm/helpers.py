"""Small tables for the operator tests."""

from __future__ import annotations

import hashlib

# Columns beyond the named ones, with names that operators use inside.
EXTRA = "row int, id string, fp string, h1 int, key string, version string, next string, line string, n string, anchor int"
CLASH = (7, "x", "f", 1, "k", "v", "n", "l", "m", 3)

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(12_000))

TEXTS = [
    (1, "Hello world, this is a fairly plain text line\nShared line number one\nshort\n  Shared Line Number TWO  "),
    (2, "Another text here\nShared line number one\nshort\nshared line number two\t\n"),
    (3, ""),
    (4, None),
    (5, LONG),
    (6, "Another text here\nShared line number one\nshort\nshared line number two\t\n"),
    (7, "é" * 30 + "\nÉ" + "é" * 29),
    (8, "é" * 30),
    (9, "   \t\n\n  "),
    (10, "one"),
    (11, LONG + " tail of words"),
    (12, "one"),
]


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def documents(spark, texts=TEXTS, clash: bool = True):
    if clash:
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASH) for i, t in texts],
                                     f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    return spark.createDataFrame(texts, "doc_id long, text string")


def collected(df, key: str) -> dict:
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
