"""WARC archives of web pages, written and read back by Spark.

Writing: each page is an HTTP response in chunked framing. Of pages with equal payloads of `LEAST_BYTES` at least, the one
with the smallest page_id is written as a response and the others as revisits that refer to it. A record whose block is
longer than `SEGMENT_BYTES` is cut into a first segment and continuation records. Archives are text files whose rows are
whole records, of a bounded number of records each.

Reading: files are read whole (their size is bounded by the writer) and split by Content-Length. Segments are grouped by the
identifier of their origin, ordered by number, checked for gaps and against the total length, and joined; then the chunked
framing is taken off. A record that fails a check raises `ValueError`: results are never made from part of a record.

Null html is an empty payload; a null url is written as an empty target; a null page_id is kept and never referred to.
Equal pages are told apart by a record identifier that counts rows. Among equal page_ids with equal payloads, one is the
response. An empty table gives an empty archive and an empty result. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm import common

LEAST_BYTES, SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 100, 16_384, 4_096, 4_000
END = "\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """record, page_id, url, html, digest and refers_to (the response's record and page_id, for revisits) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("record", F.monotonically_increasing_id()).withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    least = rows.where((F.octet_length("html") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    # only digests that occur again need the join; a group's response is found by a minimum, which combines before the shuffle
    first = least.groupBy("digest").agg(F.min(F.struct("page_id", "record")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("record") != F.col("first.record"))
    return rows.select("record", "page_id", "url", "html", "digest", F.when(again, F.col("first.record")).alias("to_record"), F.when(again, F.col("first.page_id")).alias("to_page"))


def _uri(record: int) -> str:
    return f"<urn:uuid:00000000-0000-4000-{record >> 48 & 0xFFFF:04x}-{record & 0xFFFFFFFFFFFF:012x}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _cut(payload, size) if p) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunks and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _cut(block: bytes, size: int) -> list[bytes]:
    """Parts of about `size` bytes that don't split a UTF-8 character, as archives are written as text."""
    out, at = [], 0
    while at < len(block):
        end = min(len(block), at + size)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out or [b""]


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[bytes] = []
        for record, page, url, html, digest, to_record, to_page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            uri = _uri(record)
            head = [b"WARC/1.1", b"WARC-Date: 2026-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}".encode(), f"WARC-Payload-Digest: sha256:{digest}".encode()]
            head += [] if page is None else [b"X-Page-Id: %d" % page]
            if to_record is not None:
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                head += [b"WARC-Type: revisit", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(to_record)}".encode(), b"X-Refers-To-Page-Id: %d" % to_page]
            else:
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
                head.append(b"WARC-Type: response")
            segments = _cut(block, segment_bytes)
            for k, part in enumerate(segments):
                if k == 0:
                    own = [*head, f"WARC-Record-ID: {uri}".encode()] + ([b"WARC-Segment-Number: 1"] if len(segments) > 1 else [])
                else:
                    part_id = _uri(record)[:-1] + f"-{k + 1}>"
                    own = [b"WARC/1.1", b"WARC-Type: continuation", b"WARC-Date: 2026-01-01T00:00:00Z", f"WARC-Record-ID: {part_id}".encode(), f"WARC-Segment-Origin-ID: {uri}".encode(), b"WARC-Segment-Number: %d" % (k + 1)]
                    if k == len(segments) - 1:
                        own.append(b"WARC-Segment-Total-Length: %d" % len(block))
                out.append(b"\r\n".join([*own, b"Content-Length: %d" % len(part)]) + b"\r\n\r\n" + part)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])


def write(planned: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of planned pages below path."""
    rows = planned.withColumn("html", F.col("html").cast("binary")).mapInArrow(lambda it: _records(it, segment_bytes), "value string")
    rows.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


FIELDS = ("warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-refers-to", "warc-payload-digest", "x-page-id", "x-refers-to-page-id", "content-length")
PARSED = "type string, id string, origin string, number int, total long, refers string, stated string, page_id long, to_page long, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    def rows(data: bytes):
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            lines = data[at:end].split(b"\r\n")
            if end < 0 or not lines[0].startswith(b"WARC/"):
                raise ValueError("an archive holds something that is not a record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
            n = int(head["content-length"])
            block = data[end + 4 : end + 4 + n]
            if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
                raise ValueError("a record is shorter or longer than it says")
            at = end + 8 + n
            kind, rid, origin, number, total, refers, digest, page, to_page, _ = (head.get(f) for f in FIELDS)
            whole = lambda x: None if x is None else int(x)
            yield kind, rid, origin, whole(number), whole(total), refers, (digest or "").removeprefix("sha256:") or None, whole(page), whole(to_page), block

    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["type", "id", "origin", "number", "total", "refers", "stated", "page_id", "to_page", "block"]
    for b in batches:
        for content in b.column(0):
            data = content.as_py()
            held, size = [], 0
            for r in rows(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                held.append(r)
                size += len(r[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def parse(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path, segments apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, PARSED)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests = [], []
        for stated, parts in zip(b.column(4), b.column(5), strict=True):
            stated, block = stated.as_py(), b"".join(parts.as_py())
            head, _, body = block.partition(b"\r\n\r\n")
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            digest = hashlib.sha256(payload).hexdigest()
            if stated and digest != stated:
                raise ValueError("a payload differs from its digest")
            sizes.append(len(payload))
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["id", "page_id", "refers", "to_page", "payload_digest", "payload_bytes"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page in the archives below path."""
    parsed = parse(spark, path)
    one = F.col("number").isNull()
    cols = ["id", "page_id", "refers", "to_page", "stated", "block"]
    plain = parsed.where(one & (F.col("type") == "response")).select(*cols).withColumn("block", F.array("block"))
    parts = parsed.where(~one).withColumn("origin", F.coalesce("origin", "id"))
    # a group is one record, as long as the page it came from
    joined = parts.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("page_id", "refers", "to_page", "stated", "total")),
        F.sum(F.octet_length("block")).alias("held"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    whole = (F.col("held") == F.col("total")) & (F.element_at("parts", -1)["number"] == F.size("parts")) & (F.element_at("parts", 1)["number"] == 1)
    # segments are joined in the task that decodes them, once
    block = F.when(whole, F.col("parts.block")).otherwise(F.raise_error(F.lit("segments of a record are missing or too long")).cast("array<binary>"))
    segmented = joined.select(F.col("origin").alias("id"), "page_id", "refers", "to_page", "stated", block.alias("block"))
    schema = "id string, page_id long, refers string, to_page long, payload_digest string, payload_bytes long"
    found = plain.unionByName(segmented).mapInArrow(_payloads, schema)
    responses = found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = parsed.where(one & (F.col("type") == "revisit")).select("page_id", F.col("refers").alias("id"), "to_page")
    # a revisit whose response is not there is an error and not a row less
    lent = revisits.join(found.select("id", "payload_bytes", F.col("payload_digest").alias("found")), "id", "left")
    lent = lent.withColumn("payload_digest", F.coalesce("found", F.raise_error(F.concat(F.lit("no response for a revisit of "), F.col("id"))).cast("string")))
    return responses.unionByName(lent.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to")))


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives of pages to the shared folder and gives what reading them finds."""
    scratch = common.Scratch(spark)
    write(plan(pages), scratch.path("archives"))
    return read(spark, scratch.path("archives"))
