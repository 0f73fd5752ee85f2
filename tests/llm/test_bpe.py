import base64
import random

import public_tokenizers
import tiktoken
from helpers import TEXTS, collected, documents, sha

from loanscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def codecs():
    model = bpe.serialise_model(bpe.read_ranks(PATH))
    return [bpe.Codec(model, public_tokenizers.PATTERN, spaced_words=s) for s in (True, False)]


def test_random_texts_match_and_round_trip():
    enc, _ = reference()
    rng = random.Random(4)
    letters = " \n\t'sdtABCz09.,%é߀ß中文😀▁\x85ـ" + " " * 6
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(4000)]
    texts += ["a" * 3000, " " * 2000 + "x", "\n" * 500, "the " * 500, "it's we'll 'tis", "a  b", " a", "a ", ""]
    for codec in codecs():
        for text, ids in zip(texts, codec.encode(texts)):
            assert list(ids) == enc.encode_ordinary(text), text
            assert codec.decode(ids) == text.encode()


def test_every_piece_is_its_own_rank():
    _, ranks = reference()
    codec = codecs()[1]
    texts = [p.decode() for p in ranks if p.isascii() and len(codec.split(p.decode())) == 1]
    for text, ids in zip(texts, codec.encode(texts)):
        assert list(ids) == [ranks[text.encode()]]


def test_memory_cleared_between_chunks_changes_nothing():
    codec = codecs()[0]
    small = bpe.Codec(bpe.serialise_model(bpe.read_ranks(PATH)), public_tokenizers.PATTERN, spaced_words=True, cache=3)
    texts = [t for _, t in TEXTS if t]
    assert [codec.encode([t]) for t in texts] == [small.encode([t]) for t in texts]


def test_table(spark):
    enc, _ = reference()
    args = dict(vocabulary=PATH, pattern=public_tokenizers.PATTERN, spaced_words=True)
    rows = collected(bpe.digests(bpe.encode_decode(documents(spark), **args), "doc_id"), "doc_id")
    assert len(rows) == len(TEXTS)
    for i, text in TEXTS:
        ids = enc.encode_ordinary(text or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    assert bpe.encode_decode(documents(spark, []), **args).count() == 0
    assert bpe.encode_decode(documents(spark, [(None, "x"), (None, "x")]), **args).count() == 2


def test_memory_is_bounded_by_bytes():
    _, codec = codecs()
    small = bpe.Codec(bpe.serialise_model(bpe.read_ranks(PATH)), public_tokenizers.PATTERN, spaced_words=True, cache=200_000)
    long = " ".join("x" * 5_000 + str(i) for i in range(60))                     # few units, many bytes
    for i in range(30):
        text = f"{long} {i} " + " ".join(f"unit{i}-{k}" for k in range(500))
        assert small.encode([text])[0] == codec.encode([text])[0]
        assert small.held <= 200_000 and (len(small.known) == 0) == (small.held == 0)
