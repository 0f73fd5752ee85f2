import gzip
import random
import zlib

import pytest
from helpers import sha

from loanscope.llm import warc

BIG = "x" * 150
TRAP = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + "y" * 100
PAGES = [(1, "http://a/", "short"), (2, "http://b/", "short"), (3, "http://c/\r\nX: y", BIG), (4, None, BIG), (5, "http://é/", TRAP),
         (6, "http://f/", TRAP), (7, "", None), (8, "http://h/", ""), (9, "http://i/", "é" * 60), (10, "http://j/", "\r\n" * 80),
         (None, "http://n/", BIG), (11, "http://k/", BIG), (12, "", "z" * 100), (13, "", "z" * 100), (14, "", "z" * 99), (15, "", "z" * 99),
         (16, "u", "w" * 3_000_000), (0, "u", "w" * 3_000_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, position int")


def test_round_trip(spark):
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(table(spark, PAGES)).collect()}
    assert len(got) == len(PAGES)
    order = sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0))
    first = {}
    for i, _, html in order:
        data = (html or "").encode()
        original = first.setdefault(data, i) if len(data) >= 100 else i
        again = original != i
        assert got[i] == (len(data), sha(data), "revisit" if again else "response", original if again else None)


def test_rows_that_tie_on_the_smallest_id(spark):
    rows = warc.round_trip(table(spark, [(3, "u", BIG), (3, "u", BIG), (3, "v", BIG)])).collect()
    assert sorted((r.record_type, str(r.refers_to)) for r in rows) == [("response", "None"), ("revisit", "3"), ("revisit", "3")]


def test_empty_table(spark):
    assert warc.round_trip(table(spark, [])).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    warc.archive(table(spark, PAGES[:3]).coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 3 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n" in data
    assert b"WARC-Target-URI: http://c/%0D%0AX: y\r\n" in data and b"Content-Length: 150\r\n\r\nxxx" in data


def test_reader_takes_several_members_and_refuses_cut_archives():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    whole = gzip.compress(one) + gzip.compress(one)
    assert [(p, b) for p, _, b in warc.Records(whole)] == [(0, b"hi"), (len(one), b"hi")]
    with pytest.raises(ValueError):
        list(warc.Records(gzip.compress(one[:-6])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.Records(gzip.compress(one[:20])))


def test_files_are_bounded_by_bytes_and_split_anywhere(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "u", rng.randbytes(rng.choice([0, 50, 3_000, 40_000])).hex()) for i in range(300)] + [(300, "u", rng.randbytes(400_000).hex())]
    records = spark.createDataFrame([(i, "response", u, sha(h), len(h), None, h.encode()) for i, u, h in rows],
                                    "id long, kind string, url string, digest string, payload_bytes long, refers_to long, payload binary")
    path, least = str(tmp_path / "w"), "spark.sql.files.maxPartitionBytes"
    warc.write_records(records.coalesce(1), path, file_bytes=200_000, group_bytes=20_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 12 and sizes[-2] < 2 * 200_000 + 45_000 and sizes[-1] < 2 * 200_000 + 450_000
    before = spark.conf.get(least)
    spark.conf.set(least, "30000")
    try:
        got = warc.read_records(spark, path).collect()
    finally:
        spark.conf.set(least, before)
    assert sorted((r.id, bytes(r.payload).decode()) for r in got) == [(i, h) for i, _, h in rows]
    assert len({r.key for r in got}) == len(rows)


def test_separator_inside_a_payload():
    for data in (warc.SEPARATOR, warc.SEPARATOR * 50 + random.Random(1).randbytes(5000)):
        packed = warc.member(data)
        assert warc.SEPARATOR not in packed and gzip.decompress(packed) == data
    assert gzip.decompress(warc.SEPARATOR) == b""


def test_archives_of_others(spark, tmp_path):
    def record(i, body):
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: u\r\n"
                f"WARC-Payload-Digest: sha256:{sha(body)}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    folder = tmp_path / "others"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(gzip.compress(record(1, b"x" * 9)) + gzip.compress(record(2, b"\n" * 9)))
    (folder / "b.warc").write_bytes(record(3, b"") + record(4, b"\r\n\r\n"))
    got = sorted((r.key[10:11], bytes(r.payload), r.payload_bytes, r.id) for r in warc.read_records(spark, str(folder)).collect())
    assert got == [("1", b"x" * 9, 9, None), ("2", b"\n" * 9, 9, None), ("3", b"", 0, None), ("4", b"\r\n\r\n", 4, None)]
    with pytest.raises(Exception, match="archives of others"):
        warc.deduplicate(spark, str(folder), str(tmp_path / "out"))
    one = tmp_path / "one"
    warc.write_records(warc.read_records(spark, str(folder)), str(one))
    warc.deduplicate(spark, str(one), str(tmp_path / "done"), least_bytes=4)
    assert warc.read_records(spark, str(tmp_path / "done")).count() == 4


def test_revisits_of_the_source_stay(spark, tmp_path):
    names = [str(tmp_path / n) for n in "abc"]
    warc.archive(table(spark, PAGES), names[0])
    for source, target in zip(names, names[1:]):
        warc.deduplicate(spark, source, target)
    once, twice = ([r.asDict() for r in warc.read_records(spark, n).drop("key").collect()] for n in names[1:])
    assert sorted(once, key=str) == sorted(twice, key=str) and sum(r["kind"] == "revisit" for r in once) == 6       # three of BIG, one each of TRAP, z and w
