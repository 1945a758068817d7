"""WARC archives: writing with revisit records, and reading back with segment reassembly.

Payloads are written as HTTP responses in chunked transfer framing. A block longer than ``segment_bytes`` is written as a
first record and continuation records. Reading groups the records by the id of the first one (the origin), orders them by
segment number, verifies the total length and takes the chunks apart.

Archives are written and read by Spark's own writers and readers, so they can lie in any store Spark reaches. In gzip every
record is a member of its own, as other tools expect it; such files, and archives of others, are read file by file and record
by record (``whole_files=True``), of any WARC version and order of fields. Plain archives of this writer are also read in
splits: records are told apart by ``SEPARATOR``, and the writer never lets it stand in a block, as it ends a chunk (or a
segment) in the middle of it. Every record is checked against its length.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatspark.llm.common import settled, ship_code

VERSION = b"WARC/1.1\r\n"
_ANY_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
SEPARATOR = "WARC/1.1\r\nWARC-Type: "
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
LEAST_REVISIT = 1_000
RECORDS_PER_FILE = 10_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_RECORD = "record string, origin string, segment int, total long, kind string, key string, url string, refers_to string, digest string, block binary, valid boolean"


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; ``VERSION`` never stands within one chunk."""
    out, low = [], 0
    while low < len(payload):
        high = min(len(payload), low + chunk_bytes)
        found = payload.find(VERSION, low, min(len(payload), high + len(VERSION)))
        if found >= 0:
            high = min(high, found + 4)
        out.append(b"%x\r\n%b\r\n" % (high - low, payload[low:high]))
        low = high
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over. Damaged framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("damaged chunk")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {line.partition(b":")[0].strip().lower(): line.partition(b":")[2].strip().lower() for line in head.split(b"\r\n")[1:]}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def member(record: bytes) -> bytes:
    """A record as a gzip member, without its last byte: this is the highest of the four of its length, zero below 16 MB."""
    data = gzip.compress(record, 6, mtime=0)
    if data[-1]:
        raise ValueError("a record of 16 MB or more")
    return data[:-1]


def _field(url: str | None) -> bytes:
    return (url or "").encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def _records(row: dict, segment_bytes: int, date: bytes) -> Iterator[bytes]:
    """The records of one page, without the final CRLF."""
    name, url = row["name"].encode(), _field(row["url"])
    common = b"WARC-Target-URI: %b\r\nWARC-Payload-Digest: sha1:%b\r\nX-Key: %b\r\n" % (
        url, base64.b32encode(bytes.fromhex(row["digest"])), b"" if row["key"] is None else str(row["key"]).encode())
    if row["url"] is None:
        common = common.partition(b"\r\n")[2]
    if row["refers_to"] is not None:
        common += b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Key: %d\r\n" % row["refers_to"]
        common += b"WARC-Refers-To-Date: %b\r\n" % date
        if row["refers_id"] is not None:
            common += b"WARC-Refers-To: %b\r\n" % row["refers_id"].encode()
        if row["refers_url"] is not None:
            common += b"WARC-Refers-To-Target-URI: %b\r\n" % _field(row["refers_url"])
        block, kind = _HTTP + b"\r\n", b"revisit"
    else:
        block, kind = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"]), b"response"
    cuts = list(range(0, len(block), segment_bytes))
    for k, low in enumerate(cuts):
        part = block[low : low + segment_bytes]
        fields = b"%b%b\r\nWARC-Record-ID: %b\r\nWARC-Date: %b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n" % (
            VERSION + b"WARC-Type: ", kind if k == 0 else b"continuation", name if k == 0 else name[:-1] + b":part%d>" % k, date, len(part))
        if len(cuts) > 1:
            fields += b"WARC-Segment-Number: %d\r\n" % (k + 1)
        if k:
            fields += b"WARC-Segment-Origin-ID: %b\r\n" % name
            if k == len(cuts) - 1:
                fields += b"WARC-Segment-Total-Length: %d\r\n" % len(block)
        else:
            fields += common
        yield fields + b"\r\n" + part + b"\r\n"


def write_archives(
    pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_revisit: int = LEAST_REVISIT, segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip", date: str | None = None,
) -> None:
    """Writes one response or revisit for each row of ``pages`` to archives in the folder ``path``.

    Of rows with equal payloads of at least ``least_revisit`` bytes those with the largest key are responses, the others
    revisit them and name its record, unless the largest key is repeated. ``compression`` is ``gzip`` (a member for each record) or
    ``none``; ``date`` is that of all records, now by default. Null html is an empty payload. A null key never is the largest unless all are null; rows that repeat the
    largest key are all responses. An empty table writes an empty folder; other columns are not read.
    """
    if compression not in ("gzip", "none") or not 0 < segment_bytes <= 8 << 20:
        raise ValueError("compression is gzip or none, a segment has 8 MB at most")
    when = (date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).encode()
    ship_code(pages)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.octet_length("payload") >= least_revisit).groupBy("same", "key").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    large = large.groupBy("same").agg(F.max(F.struct("key", "n", "url")).alias("last"), F.sum("n").alias("n"))
    repeated = settled(large.where("n > 1").select(F.col("same").alias("_same"), "last"), "repeated")
    digest, last = F.sha1("payload"), F.col("last.key")
    # the one record that others refer to has a name made of key and payload
    named = F.when(F.col("last.n") == 1, F.concat(F.lit("<urn:page:"), last.cast("string"), F.lit(":"), digest, F.lit(">")))
    revisits = ~F.col("key").eqNullSafe(last)
    judged = rows.join(repeated, F.col("same") == F.col("_same"), "left").select(
        F.coalesce(F.when(F.col("key") == last, named), F.concat(F.lit("<urn:page:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))).alias("name"),
        "key", "url", "payload", digest.alias("digest"), F.when(revisits, last).alias("refers_to"),
        F.when(revisits, named).alias("refers_id"), F.when(revisits, F.col("last.url")).alias("refers_url"))
    pack = member if compression == "gzip" else bytes

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                out = [pack(r if compression == "none" else r + b"\r\n") for row in batch.slice(low, 500).to_pylist() for r in _records(row, segment_bytes, when)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = judged.mapInArrow(serialise, "record binary").select(F.col("record").cast("string").alias("value"))
    ends = "\r\n" if compression == "none" else "\x00"  # of a record, or of a member: its last byte
    records.write.option("lineSep", ends).option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parsed(data: bytes) -> dict:
    """One record from what follows the separator."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {a.strip().lower(): c.strip() for a, _, c in (line.partition(b":") for line in lines[1:])}
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    size = int(fields.get(b"content-length", b"-1"))
    return {
        "record": text(b"warc-record-id"), "origin": text(b"warc-segment-origin-id") or text(b"warc-record-id"),
        "segment": int(fields[b"warc-segment-number"]) if b"warc-segment-number" in fields else None,
        "total": int(fields[b"warc-segment-total-length"]) if b"warc-segment-total-length" in fields else None,
        "kind": lines[0].strip().decode("utf-8", "replace"), "key": text(b"x-key") or None, "url": text(b"warc-target-uri"),
        "refers_to": text(b"x-refers-to-key"), "digest": text(b"warc-payload-digest"), "block": rest[: max(size, 0)],
        "valid": size >= 0 and rest[size:] in (b"\r\n\r\n", b"") and len(rest) >= size,
    }


def _whole_file(content: bytes) -> Iterator[dict]:
    """The records of one archive, by their lengths; its gzip members are taken apart. One without a record raises ValueError."""
    if content.startswith(b"\x1f\x8b"):
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    if not _ANY_VERSION.search(content) and content.strip():
        raise ValueError("no WARC record in a file")
    while found := _ANY_VERSION.search(content, at):
        head_end = content.find(b"\r\n\r\n", found.end())
        head_end = len(content) if head_end < 0 else head_end
        head = content[found.end() : head_end]
        fields = {a.strip().lower(): c.strip() for a, _, c in (line.partition(b":") for line in head.split(b"\r\n"))}
        size = int(fields.get(b"content-length", b"0"))
        others = [x for x in head.split(b"\r\n") if not x.lower().startswith(b"warc-type:")]
        block = content[head_end + 4 : head_end + 4 + size]
        yield _parsed(fields.get(b"warc-type", b"") + b"\r\n" + b"\r\n".join(others) + b"\r\n\r\n" + block + b"\r\n\r\n")
        at = head_end + 4 + size


def _own(data: bytes) -> dict:
    """One record of the writer's layout; anything else raises ValueError."""
    row = _parsed(data)
    if row["kind"] not in _TYPES:
        raise ValueError("an archive of another layout: read it with whole_files=True")
    return row


def _decoded(row: dict) -> dict:
    payload, valid = None, row["valid"]
    if valid and row["kind"] == "response":
        try:
            payload = payload_of(row["block"])
        except ValueError:
            valid = False
    return {k: row[k] for k in ("key", "url", "kind", "refers_to", "digest")} | {"payload": payload, "valid": valid}


_DECODED = "key string, url string, kind string, refers_to string, digest string, payload binary, valid boolean"
_DECODED_ARROW = pa.schema([(n, pa.string()) for n in ("key", "url", "kind", "refers_to", "digest")] + [("payload", pa.binary()), ("valid", pa.bool_())])


def read_archives(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per response or revisit: key, url, record_type, refers_to, digest (sha1 in base 32), payload, valid.

    ``valid`` is false for records whose length, total length, segment numbers or chunk framing are damaged; their payload
    is null. Revisits carry no payload. ``whole_files`` takes plain files and gzip, any WARC version and order of fields, and
    holds each file in one row, at most 2 GB (the writer puts ``RECORDS_PER_FILE`` records into one). A file without a record, damaged gzip, or without ``whole_files`` an archive
    whose records don't begin as the writer's, ends the job with an error.
    """

    if whole_files:
        found = spark.read.format("binaryFile").load(path).select("content")
    else:
        value = spark.read.option("lineSep", SEPARATOR).text(path).where("value <> ''")
        found = value.select(F.col("value").cast("binary").alias("content"))
    ship_code(found)

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for data in batch.column(0):
            yield from _whole_file(data.as_py()) if whole_files else (_own(data.as_py()),)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = [_decoded(r) for r in rows_of(batch.slice(low, 500)) if r["segment"] is None]
                yield pa.RecordBatch.from_pylist(rows, _DECODED_ARROW)

    segment_schema = pa.schema([
        ("record", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), *[(n, pa.string()) for n in ("kind", "key", "url", "refers_to", "digest")],
        ("block", pa.binary()), ("valid", pa.bool_())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_pylist([r for r in rows_of(batch.slice(low, 500)) if r["segment"] is not None], segment_schema)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                parts = row.pop("parts")
                row["block"] = b"".join(p["block"] for p in parts)
                row["valid"] = row["valid"] and [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and len(row["block"]) == row["total"]
                yield pa.RecordBatch.from_pylist([_decoded(row)], _DECODED_ARROW)

    # a record is segmented if its head says so; the block is not looked at
    in_segments = found if whole_files else found.where(F.substring_index(F.col("content").cast("string"), "\r\n\r\n", 1).contains("\r\nWARC-Segment-Number:"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = in_segments.mapInArrow(segments, _RECORD).groupBy("origin").agg(
        # one page's segments: as long as its payload
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        *[first(c) for c in ("kind", "key", "url", "refers_to", "digest")], F.min("valid").alias("valid"))
    out = found.mapInArrow(alone, _DECODED).unionByName(joined.drop("origin").mapInArrow(reassemble, _DECODED))
    return out.select(F.col("key").cast("long").alias("key"), "url", F.col("kind").alias("record_type"),
                      F.col("refers_to").cast("long").alias("refers_to"), "digest", "payload", "valid")


def payload_digests(records: DataFrame) -> DataFrame:
    """One row per record: key, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.

    Revisits have no payload; length and digest are those of the response they refer to, which has its key and the payload
    digest that the revisit names, as a key may be repeated with other payloads. A damaged record, or a revisit whose response is
    missing, ends the job with an error.
    """
    slim = settled(records.select(
        "key", "record_type", "refers_to", "digest", "valid", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")), "records")
    whole = F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.lit("damaged archive record")))
    # responses of one key and digest are equal
    responses = slim.where("record_type = 'response'").groupBy(F.col("key").alias("_key"), F.col("digest").alias("_named")).agg(
        F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    asked = slim.where("record_type = 'revisit'").select("refers_to", "digest").distinct()
    meant = (F.col("refers_to") == F.col("_key")) & (F.col("digest") == F.col("_named"))
    responses = settled(responses.join(asked, meant, "left_semi"), "responses")
    joined = slim.join(responses, (F.col("record_type") == "revisit") & meant, "left")
    missing = F.raise_error(F.lit("a revisit without its response")).cast("long")
    return joined.select(
        "key", F.coalesce("payload_bytes", "_bytes", missing).alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        whole.alias("record_type"), "refers_to")
