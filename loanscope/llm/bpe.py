"""Byte-level BPE encoding and decoding with a sentencepiece model.

The rank file's byte strings are written as text by a byte-to-character map
and serialised directly as a sentencepiece BPE model: one piece per rank, its
score the negative rank, identity normalisation, no dummy prefix and no
white-space escaping.  Sentencepiece then merges the pair with the lowest rank
first, leftmost on ties, which is the byte-pair merge order.  The text is cut
into pre-tokens by a pattern, each encoded separately; a pre-token that is
itself in the vocabulary is that one id, whether or not merges reach it.
Decoding maps ids to pieces and the pieces' characters back to bytes.

Defined cases: null text is the empty text; the empty text has no ids and
decodes to no bytes; rows are independent, so repeated rows, ties, null ids
and extra columns (kept out by selecting the named ones) change nothing; an
empty table gives an empty result.  A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import itertools
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.shared import chunks

# Bytes that the remembered units of text and their ids may take in one task before they are forgotten.
CACHE = 64 << 20
# A remembered unit's place in the table, beside its text and ids.
_SLOT = 104


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file (base64, space, rank per line) in rank order."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    if not {bytes([b]) for b in range(256)} <= set(ranks.values()):
        raise ValueError("every single byte must be in the vocabulary")
    return [ranks[r] for r in range(len(ranks))]


def byte_letters() -> list[str]:
    """One printable character for each byte: itself if it is visible in Latin-1, else the next free one from U+0100."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = itertools.count(256)
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose id of each piece is its rank; the id after the last is <unk>.

    Field numbers are those of the public model format: pieces 1 (text 1,
    score 2, type 3), trainer 2 (model type 3, vocabulary size 4, special ids
    40-43), normaliser 3 (name 1, dummy prefix 3, extra spaces 4, escaping 5).
    """
    letters = byte_letters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(letters[b] for b in piece).encode()
        out += _bytes(1, _bytes(1, text) + b"\x15" + struct.pack("<f", -rank))
    out += _bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    n = len(pieces)
    out += _bytes(2, _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    out += _bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes inside a task; built from a serialised model and a pre-token pattern.

    ``spaced_words`` says that in the pattern a single space between two other
    characters always starts a pre-token, and that a run of letters with one
    space or none before it is one.  A text without two spaces in a row is then
    cut at its spaces first, and the ids of each such unit are remembered,
    packed as 32-bit integers.
    """

    def __init__(self, model: bytes, pattern: str, *, spaced_words: bool = False, cache: int = CACHE):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.processor.unk_id()
        self.split = regex.compile(pattern).findall
        self.spaced_words = spaced_words
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        back = {c: b for b, c in enumerate(letters)}
        size = self.processor.get_piece_size()
        self.space = letters[ord(" ")]
        self.piece_bytes = [bytes(map(back.__getitem__, self.processor.id_to_piece(i))) if i != self.unknown else b""
                            for i in range(size)]
        self.whole = {p: i for i, p in enumerate(self.piece_bytes) if p}
        self.known: dict[str, bytes] = {}
        self.cache, self.held = cache, 0

    def units(self, text: str) -> list[str]:
        """Pieces of the text that can be cut into pre-tokens one by one."""
        if not self.spaced_words or "  " in text:
            return self.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]

    def _tokens(self, unit: str) -> list[str]:
        return [unit] if self.spaced_words and unit[1:].isalpha() and unit[0] == " " else self.split(unit)

    def _mapped(self, token: str) -> str:
        if token.isascii() and token[1:].isalpha() and token[0] == " ":
            return self.space + token[1:]
        return token.encode().decode("latin-1").translate(self.to_letters)

    def _learn(self, units: list[str]) -> None:
        tokens = [self._tokens(u) for u in units]
        ids = {t: self.whole.get(t.encode()) for t in itertools.chain.from_iterable(tokens)}
        merge = [t for t, i in ids.items() if i is None]
        merged = self.processor.encode([self._mapped(t) for t in merge], out_type=int, num_threads=1)
        packed = {t: struct.pack("=i", i) for t, i in ids.items() if i is not None}
        packed |= {t: array("i", i).tobytes() for t, i in zip(merge, merged)}
        for unit, parts in zip(units, tokens):
            self.known[unit] = packed[parts[0]] if len(parts) == 1 else b"".join(map(packed.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of each text."""
        cut = [self.units(t) for t in texts]
        seen = dict.fromkeys(itertools.chain.from_iterable(cut))
        if new := [u for u in seen if u not in self.known]:
            self._learn(new)
            self.held += sum(sys.getsizeof(u) + sys.getsizeof(self.known[u]) + _SLOT for u in new)
        ids = [array("i", b"".join(map(self.known.__getitem__, units))) for units in cut]
        if self.held > self.cache:                          # so one batch's units at most are held beyond the bound
            self.known, self.held = {}, 0
        return ids

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, ids))


def encode_decode(docs: DataFrame, *, vocabulary: str, pattern: str, spaced_words: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): every whole text encoded, and its ids decoded again."""
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in chunks(batches, "text"):
            codec = codec or Codec(model.value, pattern, spaced_words=spaced_words)
            ids = codec.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
            flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat),
                                   pa.array(map(codec.decode, ids), pa.binary())], ["id", "ids", "decoded"])

    kind = source.schema["id"].dataType.simpleString()
    return (source.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
            .withColumnRenamed("id", id_col))


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """The named columns, number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded bytes."""
    return encoded.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
