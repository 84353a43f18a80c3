"""WARC records as a chunked table.

A record is one row per chunk of at most CHUNK payload bytes: record key, chunk number, the header block on the first,
the bytes, and the SHA-1 of the payload so far. The JVM cuts a row's payload into chunks, and Python's writer and reader
get PASS_ROWS of these at a time, never a whole payload; a reader can tell where a payload breaks. Header, chunks and two
line ends in order are the record's bytes in a WARC file (write_file, read_file). A payload's later copies are revisits
without bytes, found through one aggregate over digests. Records of one chunk are verified where they are read, and only
those of several chunks are brought together again.

Defined results: a null or empty html is an empty payload; a very long one has as many chunks as it needs; of equal
payloads, rows that share the largest page_id are all responses, and so is one with a null page_id unless an equal
payload has a page_id; a null url is named by its page; pages have no time of their own, so a record's date is a
parameter; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_schema, as_batch, blocks, new_path

CHUNK = 64 << 10
#: Chunks that Python looks at together, 4 MB.
PASS_ROWS = 64
SCHEMA = "record_key string, chunk_no int, header string, data binary, digest_so_far string, last boolean"
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def header_block(page_id: int | None, url: str | None, digest: str, length: int, refers_to: int | None, date: str = DATE) -> str:
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or page_urn(page_id))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {length}\r\n\r\n"
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{page_urn(page_id)}:{digest}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers_to)}:{digest}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else length)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + http


def parse_header(header: str) -> dict[str, str]:
    """Fields of the record by lower-case name; those of the HTTP block have the prefix 'http:'."""
    warc, _, http = header.partition("\r\n\r\n")
    fields = lambda block, prefix: {prefix + k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.split("\r\n")[1:] if line)}
    return fields(warc, "") | fields(http, "http:")


def _page(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1 of the payload, its bytes n, and refers_to, null for responses."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
    narrow = base.select("page_id", "sha1", "n").where(F.col("n") >= min_bytes)
    newest = narrow.groupBy("sha1", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    # Payloads move by page only: digests of many copies meet without their bytes.
    revisits = narrow.join(newest.drop("copies"), ["sha1", "n"]).where("not page_id <=> refers_to").select("page_id", "sha1", "refers_to").distinct()
    other = revisits.toDF("r_page", "r_sha1", "refers_to")
    return base.join(other, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha1") == F.col("r_sha1")), "left").select("page_id", "url", "html", "sha1", "n", "refers_to")


def record_chunks(key: str, header: str, payload: memoryview | bytes, size: int = CHUNK) -> Iterator[dict]:
    """The rows of a record whose payload is at hand, as the archive has them."""
    digest, n = hashlib.sha1(), len(payload)
    for no, at in enumerate(range(0, max(n, 1), size)):
        data = bytes(payload[at : at + size])
        digest.update(data)
        yield {"record_key": key, "chunk_no": no, "header": None if no else header, "data": data, "digest_so_far": base32(digest.digest()), "last": at + size >= n}


def payload_chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """page_id, url, sha1, n, refers_to, chunk_no, data, last: the payloads of responses in chunks, revisits as an empty one."""
    counted = records.withColumn("chunks", F.expr(f"if(refers_to is null, greatest(1, (n + {size - 1}) div {size}), 1)"))
    each = counted.select("*", F.explode(F.expr("sequence(0, cast(chunks as int) - 1)")).alias("chunk_no"))
    data = F.expr(f"if(refers_to is null, substring(cast(html as binary), chunk_no * {size} + 1, {size}), cast('' as binary))")
    return each.select("page_id", "url", "sha1", "n", "refers_to", "chunk_no", data.alias("data"), F.expr("chunk_no + 1 = chunks").alias("last"))


def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PASS_ROWS):
            yield batch.slice(at, PASS_ROWS)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Writes one record per row of (page_id, url, html) under path."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = arrow_schema(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, record, digest = TaskContext.get().partitionId(), -1, hashlib.sha1()
        for batch in passes(batches):
            out = {k: [] for k in schema.names}
            for row in batch.to_pylist():
                header = None
                if not row["chunk_no"]:
                    record, digest = record + 1, hashlib.sha1()
                    header = header_block(row["page_id"], row["url"], base32(bytes.fromhex(row["sha1"])), row["n"], row["refers_to"], date)
                digest.update(row["data"])
                for k, v in zip(schema.names, (f"{part}-{record}", row["chunk_no"], header, row["data"], base32(digest.digest()), row["last"]), strict=True):
                    out[k].append(v)
            yield as_batch(out, schema)

    # A record's chunks follow each other in one task: nothing moves between the two steps.
    payload_chunks(with_revisits(pages, min_bytes)).mapInArrow(run, SCHEMA).write.parquet(path)


def joined_records(rows: Iterable[dict]) -> Iterator[dict]:
    """Facts of each record from its chunks in order; raises where a digest or an order doesn't hold."""
    fields, digest, size, expected, key = {}, hashlib.sha1(), 0, 0, None
    for row in rows:
        if key is not None and row["record_key"] != key:
            raise ValueError(f"record {key}: its end is missing")
        if row["chunk_no"] == 0 and key is None:
            fields, digest, size, expected = parse_header(row["header"]), hashlib.sha1(), 0, 0
        if row["chunk_no"] != expected:
            raise ValueError(f"record {row['record_key']}: chunk {expected} is missing")
        digest.update(row["data"])
        size, expected = size + len(row["data"]), expected + 1
        if base32(digest.digest()) != row["digest_so_far"]:
            raise ValueError(f"record {row['record_key']}: chunk {row['chunk_no']} is damaged")
        key = None if row["last"] else row["record_key"]
        if row["last"]:
            named, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            if kind == "response" and (named != row["digest_so_far"] or size != int(fields["http:content-length"])):
                raise ValueError(f"record {row['record_key']}: the payload isn't what its header says")
            yield {"page_id": _page(fields["warc-record-id"]), "payload_bytes": int(fields["http:content-length"]), "payload_digest": named, "record_type": kind, "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields["warc-target-uri"]}
    if key is not None:
        raise ValueError(f"record {key}: its end is missing")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record under path: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in passes(batches) for row in batch.to_pylist())
        for found in blocks(joined_records(rows), BATCH_ROWS):
            yield as_batch({k: [r[k] for r in found] for k in schema.names}, schema)

    chunks = spark.read.schema(SCHEMA).parquet(path)
    several = chunks.where("not (chunk_no = 0 and last)").repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
    return chunks.where("chunk_no = 0 and last").mapInArrow(run, ddl).union(several.mapInArrow(run, ddl))


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the records, then reads them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path)


def write_file(rows: Iterable[dict], out: BinaryIO) -> None:
    """Chunks in order as the bytes of a WARC file."""
    for row in rows:
        if row["header"] is not None:
            out.write(row["header"].encode())
        out.write(row["data"])
        if row["last"]:
            out.write(b"\r\n\r\n")


def read_file(stream: BinaryIO, size: int = CHUNK) -> Iterator[dict]:
    """Chunks of the records of a WARC file, read piece by piece; stream may be one of gzip.open."""
    record = 0
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        head = line
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head += line
        head += b"\r\n"
        fields = parse_header(head.decode("utf-8", "replace"))
        left = int(fields.get("content-length", 0))
        if "application/http" in fields.get("content-type", ""):
            while left:
                line = stream.readline(left)
                if not line:
                    raise ValueError("the file ends within a record")
                head, left = head + line, left - len(line)
                if line in (b"\r\n", b"\n"):
                    break
        digest, no, on = hashlib.sha1(), 0, True
        while on:
            data = stream.read(min(size, left))
            if len(data) < min(size, left):
                raise ValueError("the file ends within a record")
            digest.update(data)
            left -= len(data)
            on = left > 0
            yield {"record_key": str(record), "chunk_no": no, "header": None if no else head.decode("utf-8", "replace"), "data": data, "digest_so_far": base32(digest.digest()), "last": not on}
            no += 1
        record += 1


SQL = """
WITH payloads AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
    SELECT page_id, url, n, h, max(page_id) OVER (PARTITION BY h, n) AS newest,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest
    FROM payloads
)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to, url
FROM digests
"""
