"""WARC archives: write, read back, and resolve repeated payloads to revisit records.

Archives are WARC/1.1 files of gzip members, one member a record: a header, an
empty line, the payload as the record's block, and two line ends.  Between the
records stands an empty member with a comment of its own (``SEPARATOR``), which
gzip readers pass over.  It is the line separator of Spark's text source, so
Spark writes the files, splits them at any size, and reads one record a row: no
task holds an archive.  The sink gets members in groups of ``GROUP_BYTES`` and
starts a new file after ``FILE_BYTES`` (less than twice as many, and one member),
whatever the number of records; a member longer than a group is followed by
empty lines that count for the rest of it.
Records are cut by their Content-Length, so a payload may hold any bytes, line
ends and record headers included.  Archives of others, several records in a
piece or not compressed, are read as well, a file at a time.

Revisit resolution moves headers only: the smallest record of each payload
digest is found by a grouped minimum (combined before the shuffle, so a payload
that a third of all pages share costs a row a task) and joined back to the
headers by digest.  The revisits found meet the compressed members by the
record's key, unique for each; payloads are unpacked after that, and those of
revisits not at all.  A revisit record in the source stays one.

Defined cases: a null payload is empty; a null url is an empty header value and
line ends inside a url are percent-encoded; rows with a null id sort after all
others when the original is chosen and are named by their key; of rows that tie
on the smallest id one is the response, the others revisit it; an empty table
gives no records; a payload of any length is one record, up to the 2 GB of a
Spark value.  Extra columns are left out by selecting the named ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.shared import CHUNK_BYTES, scratch_path, stored

# Compressed bytes of one archive file, and of the groups of members that the sink gets.
FILE_BYTES = 1 << 30
GROUP_BYTES = 1 << 20
# An empty gzip member whose header holds a comment.
SEPARATOR = bytes([31, 139, 8, 16, 0, 0, 0, 0, 0, 255]) + b"end of record\0" + bytes([3, 0]) + bytes(8)
TEXT = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = ("id long, kind string, url string, digest string, payload_bytes long, refers_to long, "
          "key string, payload binary")
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def member(record: bytes) -> bytes:
    """One gzip member without the separator's bytes in it; strategies other than the usual are for those it would have."""
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FIXED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31, 8, strategy)
        data = packer.compress(record) + packer.flush()
        if SEPARATOR not in data:
            return data
    raise ValueError("the record holds the separator in every form of compression")


def _packed(records: DataFrame, group_bytes: int) -> DataFrame:
    """(value): groups of members; one of ``n`` times ``group_bytes`` is followed by ``n - 1`` empty rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                data = member(record.as_py())
                held.append(data)
                size += len(data) + len(SEPARATOR)
                if size >= group_bytes:
                    yield pa.record_batch([pa.array([SEPARATOR.join(held)] + [b""] * (size // group_bytes - 1), pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([SEPARATOR.join(held)], pa.binary())], ["value"])

    return records.mapInArrow(run, "value binary")


def write_records(records: DataFrame, path: str, *, date: str = DATE, file_bytes: int = FILE_BYTES,
                  group_bytes: int = GROUP_BYTES) -> None:
    """Write (id, kind, url, digest, payload_bytes, refers_to, payload) rows as archives under ``path``.

    A revisit record has no block; its payload's length and digest stay in the header.
    """
    records = records.withColumn("key", F.uuid())
    block = F.when(F.col("kind") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    urn = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")),
                     F.concat(F.lit("<urn:uuid:"), F.col("key"), F.lit(">")))
    profile = F.when(F.col("kind") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("kind")), _header("WARC-Record-ID", urn),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", url), _header("WARC-Profile", profile),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(F.col("kind") == "revisit", refers)),
        _header("X-Record-Key", F.col("key")),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("Content-Type", F.lit("text/html")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit(END))
    (_packed(records.select(record.cast("binary").alias("record")), group_bytes)
     .select(F.col("value").cast("string")).write.options(**TEXT)
     .option("maxRecordsPerFile", max(1, file_bytes // group_bytes)).text(path))


class Records:
    """Iterates over (position, header, block) of the records in some bytes, gzip members or plain, unpacked piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.inflate and self.inflate.eof:               # one gzip member after the other
            self.data, self.at, self.inflate = memoryview(self.inflate.unused_data + bytes(self.data[self.at:])), 0, zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at:self.at + (1 << 18)]
        self.buffer += self.inflate.decompress(piece) if self.inflate else piece
        self.at += 1 << 18
        return True

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        position = 0
        while True:
            header, end = self.header()
            if header is None:
                return
            size = int(header["Content-Length"])
            while len(self.buffer) < end + 8 + size:
                if not self._more():
                    raise ValueError("archive ends inside a record")
            yield position, header, bytes(self.buffer[end + 4:end + 4 + size])
            del self.buffer[:end + 8 + size]
            position += end + 8 + size

    def header(self) -> tuple[dict[str, str] | None, int]:
        """The next record's header and where it ends, or None after the last record."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record's header")
                return None, 0
        lines = self.buffer[:end].decode().split("\r\n")
        return dict(line.split(": ", 1) for line in lines[1:]), end


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None


def _row(header: dict[str, str], block: bytes, payload: bool) -> tuple:
    """A record as RECORD; the block of a full record must fit its digest."""
    digest, kind = header["WARC-Payload-Digest"].removeprefix("sha256:"), header["WARC-Type"]
    if kind != "revisit" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"payload of record {header.get('WARC-Record-ID')} does not fit its digest")
    return (_page(header.get("WARC-Record-ID")), kind, header["WARC-Target-URI"], digest,
            int(header.get("X-Payload-Length", len(block))), _page(header.get("WARC-Refers-To")),
            header.get("X-Record-Key") or header["WARC-Record-ID"], block if payload else None)


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about CHUNK_BYTES; a row's last value is the long one."""
    names, types = zip(*(f.split() for f in schema.split(", ")))
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size > CHUNK_BYTES:
            yield pa.record_batch([pa.array(c, TYPES[t]) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, TYPES[t]) for c, t in zip(zip(*held), types)], names)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(piece): the bytes between separators, for archives of ``write_records`` one record each."""
    return spark.read.options(**TEXT).text(path).select(F.col("value").cast("binary").alias("piece")).filter(F.octet_length("piece") > 0)


def read_records(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``; the block of a full record must fit its digest.

    ``payload=False`` returns headers only.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for piece in batch.column(0):
                for _, header, block in Records(piece.as_py()):
                    yield _row(header, block, payload)

    return _pieces(spark, path).mapInArrow(lambda batches: _batches(rows(batches), RECORD), RECORD)


def _keyed(spark: SparkSession, path: str) -> DataFrame:
    """(key, member): the records of all archives, still compressed; only their headers are unpacked."""
    schema = "key string, member binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for piece in batch.column(0):
                data = piece.as_py()
                header, _ = Records(data).header()
                if "X-Record-Key" not in header:
                    raise ValueError("archives of others are deduplicated after write_records(read_records(...))")
                yield header["X-Record-Key"], data

    return _pieces(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema), schema)


def resolve(headers: DataFrame, *, least_bytes: int) -> DataFrame:
    """(key, original, again): the records that become revisits; equal payloads of ``least_bytes`` or more keep one response."""
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    long = headers.filter(F.col("payload_bytes") >= least_bytes)
    originals = (long.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                 .filter("n > 1").select("digest", "first"))
    return (long.select("key", "digest").join(originals, "digest").filter(F.col("first.key") != F.col("key"))
            .select("key", F.col("first.id").alias("original"), F.lit(True).alias("again")))


def deduplicate(spark: SparkSession, source: str, target: str, *, least_bytes: int = 100) -> None:
    """Read the archives under ``source`` (of ``write_records``) and write them under ``target``, repeated payloads as revisit records."""
    read = read_records(spark, source, payload=False)
    headers = stored(read.filter("kind <> 'revisit'").select("id", F.unhex("digest").alias("digest"), "payload_bytes", "key"), "warc-headers")
    revisits = resolve(headers, least_bytes=least_bytes)
    decided = _keyed(spark, source).join(revisits, "key", "left").select("again", "original", "member")
    schema = "id long, kind string, url string, digest string, payload_bytes long, refers_to long, payload binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for again, original, packed in zip(*(batch.column(i) for i in range(3))):
                found = Records(packed.as_py())
                if again.as_py():                           # its payload was held against the digest when the headers were read
                    header, _ = found.header()
                    yield (_page(header["WARC-Record-ID"]), "revisit", header["WARC-Target-URI"],
                           header["WARC-Payload-Digest"].removeprefix("sha256:"), int(header["X-Payload-Length"]), original.as_py(), b"")
                else:
                    [(_, header, block)] = found
                    page, kind, url, digest, size, refers, _, _ = _row(header, block, False)
                    yield page, kind, url, digest, size, refers, block

    write_records(decided.mapInArrow(lambda batches: _batches(rows(batches), schema), schema), target)


def archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html") -> None:
    """Write one response record for each row, whatever its payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.lit("response").alias("kind"), F.col(url_col).alias("url"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.lit(None).cast("long").alias("refers_to"), payload.alias("payload"))
    write_records(rows, path)


def round_trip(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """Archive the pages, deduplicate the archives, and read those back: one row a page."""
    spark = pages.sparkSession
    raw, final = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    archive(pages, raw)
    deduplicate(spark, raw, final, least_bytes=least_bytes)
    return read_records(spark, final, payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to")
