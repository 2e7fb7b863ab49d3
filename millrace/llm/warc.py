"""WARC archives: writing with deduplication by revisit, reading with segment reassembly.

Payloads are sent in chunked transfer framing. A record whose block is longer than segment_chars is cut into a
first record with WARC-Segment-Number 1 and continuation records that name it in WARC-Segment-Origin-ID.
The reader groups segments by origin, orders them by number, verifies the total length, and decodes the framing.
Files are genuine .warc.gz text: a record ends with two line breaks, which is the writer's line separator.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, prepare, written

CRLF = "\r\n"
MIN_REVISIT = 100
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4096
RECORDS_PER_FILE = 4000


def _urn(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _lower_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def _pieces(text: Column, n: int) -> Column:
    """Stretches of n characters each, none for an empty text; one walk over the text, however long."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def chunked(text: Column) -> Column:
    """Chunked transfer framing of a text's UTF-8 bytes."""
    frames = F.transform(_pieces(text, CHUNK_CHARS), lambda p: F.concat(_lower_hex(F.octet_length(p)), F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.when(F.length(text) > 0, F.array_join(frames, "")).otherwise(F.lit("")), F.lit("0" + CRLF + CRLF))


def _record(block: Column, *headers: tuple[str, Column]) -> Column:
    """A record but for its last two line breaks."""
    lines = [F.lit("WARC/1.1"), *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers], F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to: of equal payloads of MIN_REVISIT bytes the smallest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20").alias("url"), F.col("url").isNull().alias("no_url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    planned = rows.join(written(repeated, "repeated-payloads"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return planned.select("page_id", "url", "no_url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_chars: int = SEGMENT_CHARS) -> None:
    """Write a record per page as gzipped WARC files below path, by Spark's text writer."""
    p = plan_records(pages)
    own = _urn(F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.when(F.col("page_id").isNull(), F.col("digest")).otherwise(F.lit("")))
    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF)
    block = F.when(F.col("record_type") == "revisit", F.concat(http, F.lit(CRLF))).otherwise(F.concat(http, F.lit("Transfer-Encoding: chunked" + CRLF + CRLF), chunked(F.col("html"))))
    p = p.select("page_id", "url", "no_url", "digest", "record_type", "refers_to", own.alias("urn"), block.alias("block"))
    parts = p.withColumn("total", F.octet_length("block")).withColumn("segments", _pieces(F.col("block"), segment_chars)).drop("block")
    parts = parts.select("*", F.posexplode("segments").alias("k", "part")).withColumn("many", F.size("segments") > 1).drop("segments")
    first, text = F.col("k") == 0, lambda c: c.cast("string")
    record = _record(
        F.col("part"),
        ("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        ("WARC-Record-ID", F.when(first, F.col("urn")).otherwise(_urn(F.col("urn"), text(F.col("k"))))),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.when(first & ~F.col("no_url"), F.col("url"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        ("WARC-Refers-To", F.when(first & F.col("refers_to").isNotNull(), _urn(F.lit("page"), text(F.col("refers_to")), F.lit("")))),
        ("WARC-Segment-Number", F.when(F.col("many"), text(F.col("k") + 1))),
        ("WARC-Segment-Origin-ID", F.when(F.col("many") & ~first, F.col("urn"))),
        ("WARC-Segment-Total-Length", F.when(F.col("many") & ~first, text(F.col("total")))),
        ("X-Page-Id", F.when(first, text(F.col("page_id")))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
    )
    parts.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive; gzip members are inflated one after another."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's header has no end")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        length = int(headers["content-length"])
        if end + 4 + length > len(data):
            raise ValueError("a record is shorter than its length")
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, with chunked framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its length")
        at = end + 4 + size


_SEGMENT = "record_id string, origin string, segment int, total long, record_type string, url string, digest string, refers string, page_id long, block binary"
_NUMBERS = {"segment": pa.int32(), "total": pa.int64(), "page_id": pa.int64(), "block": pa.binary()}
_FIELDS = [f.split(" ")[0] for f in _SEGMENT.split(", ")]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows: list[tuple] = []
            held = 0
            for h, block in records(data.as_py()):
                g = h.get
                rows.append((g("warc-record-id"), g("warc-segment-origin-id"), _number(g("warc-segment-number")), _number(g("warc-segment-total-length")), g("warc-type"), g("warc-target-uri"), (g("warc-payload-digest") or "").removeprefix("sha256:"), g("warc-refers-to"), _number(g("x-page-id")), block))
                held += len(block)
                if held > 8_000_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _NUMBERS.get(f, pa.string())) for f, c in zip(_FIELDS, zip(*rows, strict=True), strict=True)], names=_FIELDS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload, its size and its digest, verified against the header; a revisit has none of its own."""
    for batch in batches:
        ids, types, urls, digests, refers, pages, blocks = (c.to_pylist() for c in batch.columns)
        payloads = [None if t == "revisit" else payload_of(b) for t, b in zip(types, blocks, strict=True)]
        for p, d, i in zip(payloads, digests, ids, strict=True):
            if p is not None and hashlib.sha256(p).hexdigest() != d:
                raise ValueError(f"payload of {i} does not match its digest")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(types, pa.string()), pa.array(urls, pa.string()), pa.array(digests, pa.string()), pa.array(refers, pa.string()), pa.array(pages, pa.int64()), pa.array([None if p is None else len(p) for p in payloads], pa.int64()), pa.array(payloads, pa.binary())], names=["record_id", "record_type", "url", "payload_digest", "refers", "page_id", "payload_bytes", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, payload_digest, refers, page_id, payload_bytes, payload of each whole record below path.

    Only segmented records are shuffled, by their origin. A missing, repeated or short segment, a false
    digest or broken framing fails the read.
    """
    prepare(spark)
    segments = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content").mapInArrow(_parse, _SEGMENT)
    whole = segments.where("segment is null").select("record_id", "record_type", "url", "digest", "refers", "page_id", "block")
    cut = segments.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    grouped = cut.groupBy("origin").agg(parts.alias("parts"), F.max("total").alias("total"), *[head(c).alias(c) for c in ("record_type", "url", "digest", "refers", "page_id")])
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    numbers = F.transform("parts", lambda x: x["segment"])
    sound = (F.octet_length("block") == F.col("total")) & (F.array_max(numbers) == F.size("parts")) & (F.size(F.array_distinct(numbers)) == F.size("parts"))
    again = grouped.withColumn("block", joined).withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), F.col("origin"))).cast("binary")))
    both = whole.union(again.select(F.col("origin"), "record_type", "url", "digest", "refers", "page_id", "block"))
    return both.mapInArrow(_decode, "record_id string, record_type string, url string, payload_digest string, refers string, page_id long, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null page_id orders last and is kept in the record's name by its payload;
    rows repeating page_id and payload are all responses (or revisits), as there is one capture; further columns are ignored;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    got = written(read_archives(spark, path).drop("payload", "url"), "warc-read")
    origin = got.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("first_bytes")).withColumnRenamed("record_id", "refers")
    named = got.join(origin, "refers", "left")
    return named.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))
