import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from threatspark.llm.common import shared_folder
from threatspark.llm.warc import chunked, dechunked, payload_digests, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload string, key string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    big = "<p>" + "grün " * 20_000
    evil = "x" * 990 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + "WARC/1.1\r\n" * 400
    rows = [(k, f"http://h/{k}", rng.choice(["a", "é" * 499, "é" * 500, "same " * 300, big, evil, "", "\r\n", "0\r\n\r\n"])) for k in range(120)]
    rows += [(200, None, None), (201, "http://x/\r\nWARC-Type: evil", "b" * 2000), (201, "u", "b" * 2000), (150, "u", "b" * 2000), (None, "u", "b" * 2000), (None, "u", "c" * 1500), (None, "u", "c" * 1500)]
    return spark.createDataFrame([(*r, "p", "k") for r in rows], SCHEMA).repartition(4)


def expected(rows):
    last = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(last.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = last.get(data)
        refers = None if refers == i else refers
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression,whole_files,segment_bytes", [("gzip", True, 32_768), ("none", False, 700), ("none", True, 1_500)])
def test_round_trip(spark, pages, compression, whole_files, segment_bytes):
    path = shared_folder(spark, "test")
    write_archives(pages, path, compression=compression, segment_bytes=segment_bytes)
    records = read_archives(spark, path, whole_files)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in payload_digests(records).collect()), key=str) == expected(rows)
    got = sorted((bytes(r.payload) for r in records.where("record_type = 'response'").collect()))
    assert set(got) == {(h or "").encode() for _, _, h in rows}
    assert records.where(F.col("url").isNull()).count() == 1


def test_a_key_with_several_payloads(spark):
    rows = [(5, "u", "a" * 2000), (5, "u", "b" * 3000), (3, "u", "a" * 2000), (4, "u", "b" * 3000), (4, "u", "a" * 2000), (None, "u", "b" * 3000)]
    pages = spark.createDataFrame([(*r, "p", "k") for r in rows], SCHEMA).repartition(3)
    path = shared_folder(spark, "test")
    write_archives(pages, path)
    assert sorted((tuple(r) for r in payload_digests(read_archives(spark, path, whole_files=True)).collect()), key=str) == expected(rows)


def test_archives_are_as_other_tools_expect(spark, pages):
    """Gzip members hold one record each; every record has an id, a date and its length; a revisit names a response."""
    path = shared_folder(spark, "test")
    write_archives(pages, path, date="2026-01-02T03:04:05Z")
    responses, refers, ids = set(), [], []
    for file in spark.read.format("binaryFile").load(path).collect():
        data = bytes(file.content)
        while data:
            stream = zlib.decompressobj(wbits=31)
            record = stream.decompress(data) + stream.flush()
            data = stream.unused_data
            head, _, block = record.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines)
            assert first == b"WARC/1.1" and fields[b"WARC-Date"] == b"2026-01-02T03:04:05Z"
            assert block[int(fields[b"Content-Length"]):] == b"\r\n\r\n"
            ids.append(fields[b"WARC-Record-ID"])
            if fields[b"WARC-Type"] == b"response":
                responses.add((fields[b"WARC-Record-ID"], fields[b"WARC-Payload-Digest"]))
            elif fields[b"WARC-Type"] == b"revisit":
                assert fields[b"WARC-Refers-To-Date"] == b"2026-01-02T03:04:05Z"
                refers.append((fields.get(b"WARC-Refers-To"), fields[b"WARC-Payload-Digest"], fields[b"X-Refers-To-Key"]))
    assert len(ids) == len(set(ids)) and len(refers) > 20
    for name, digest, key in refers:
        assert (name, digest) in responses if key != b"201" else name is None  # the key 201 is repeated


def test_damage_is_seen(spark, pages):
    path = shared_folder(spark, "test")
    write_archives(pages, path, compression="none", segment_bytes=5_000)
    text = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where("value <> ''")
    cut = text.where(~F.col("value").contains("WARC-Segment-Number: 3\r\n"))  # one part of every large record is lost
    lost = shared_folder(spark, "test")
    cut.select(F.concat(F.lit("WARC/1.1\r\n"), F.expr("left(value, length(value) - 2)")).alias("value")).write.option("lineSep", "\r\n").text(lost)
    assert read_archives(spark, path).where("not valid").count() == 0
    damaged = read_archives(spark, lost).where("not valid")
    assert damaged.count() > 0
    assert damaged.where("payload is not null").count() == 0
    with pytest.raises(Exception, match="damaged archive record|without its response"):
        payload_digests(read_archives(spark, lost)).collect()


def test_chunks():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"WARC/1.\r\n0a") for _ in range(rng.randint(0, 60))) + b"WARC/1.1\r\n" * rng.randint(0, 3)
        framed = chunked(data, rng.randint(1, 30))
        assert dechunked(framed) == data and b"WARC/1.1\r\nWARC" not in framed
    assert dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_empty_table(spark, pages):
    path = shared_folder(spark, "test")
    write_archives(pages.limit(0), path)
    assert payload_digests(read_archives(spark, path, whole_files=True)).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(version, kind, url, block):
        head = f"WARC/{version}\r\nWARC-Record-ID: <urn:{url}>\r\nContent-Length: {len(block)}\r\nwarc-type: {kind}\r\nWARC-Target-URI: {url}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    parts = [record("1.0", "response", "http://a/", http + b"one WARC/1.1\r\nWARC-Type: response"), record("1.1", "response", "http://b/", http + b"two")]
    for name, data in [("plain", b"".join(parts)), ("members", b"".join(map(gzip.compress, parts)))]:
        (tmp_path / name).write_bytes(data)
        got = read_archives(spark, str(tmp_path / name), whole_files=True).collect()
        assert sorted((r.url, bytes(r.payload), r.valid) for r in got) == [("http://a/", b"one WARC/1.1\r\nWARC-Type: response", True), ("http://b/", b"two", True)]
    (tmp_path / "other").write_bytes(b"no archive at all")
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(Exception, match="no WARC record"):
        read_archives(spark, str(tmp_path / "other"), whole_files=True).collect()
    assert read_archives(spark, str(tmp_path / "empty"), whole_files=True).count() == 0
    for name in ("plain", "other"):
        with pytest.raises(Exception, match="whole_files=True"):
            read_archives(spark, str(tmp_path / name)).collect()
