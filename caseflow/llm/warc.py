"""WARC archives as a chunked record table.

An archive is a Parquet table (record_key, chunk_no, chunk_count, content, prefix_sha256) whose contents, joined in
the order of chunk_no, are one WARC/1.1 record: header lines, an HTTP block, the payload, an empty line. A payload of
any length is written and read chunk by chunk; each row carries the digest of the payload up to its end, so a reader
verifies chunks as they come and never holds a whole record.

Of records with equal payloads of at least `least_bytes` the one with the smallest page_id is a response with its
payload; the others are revisits without payload that name it. The smallest id of a payload is found by a
pre-aggregated minimum over digests, and a hot payload is only joined, which Spark splits at run time.

A record's identifier is its page_id with the key of its row, so repeated rows have identifiers of their own; page_id and
the page a revisit refers to are fields of their own. All records bear the date given, by default that of the call.

Edge cases: null html is an empty payload; a null url has no target line; control characters in urls are percent
encoded, urls may be of any length; rows with the same page_id and payload are all responses; a page_id is a whole number, or a text of one, and others raise; a null page_id never wins and is a revisit of a
known one; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, short_batches

CHUNK = 32 * 1024
LEAST_BYTES = 100

CHUNK_SCHEMA = "record_key long, chunk_no int, chunk_count int, content binary, prefix_sha256 string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, record_type and refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (
        rows.filter(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def _header(key, page_id, url, kind, refers_to, digest, size, date) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{key}>"]
    lines.append(f"Page-ID: {'' if page_id is None else page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _chunks(chunk: int, date: str):
    def write(batches):
        for batch in batches:
            keys, nos, counts, contents, digests, held = [], [], [], [], [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("record_key", "page_id", "url", "digest", "record_type", "refers_to")), batch.column("html"), strict=True)
            for key, page_id, url, digest, kind, refers_to, html in rows:
                view = memoryview(html.as_buffer())
                head = _header(key, page_id, url, kind, refers_to, digest, len(view), date)
                view = view if kind == "response" else view[:0]
                n, sha = max(1, -(-len(view) // chunk)), hashlib.sha256()
                for k in range(n):
                    part = view[k * chunk : (k + 1) * chunk]
                    sha.update(part)
                    keys.append(key), nos.append(k), counts.append(n), digests.append(sha.hexdigest())
                    contents.append((head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if k == n - 1 else b""))
                    held += len(contents[-1])
                    if held > 4 << 20:
                        yield _batch(keys, nos, counts, contents, digests)
                        keys, nos, counts, contents, digests, held = [], [], [], [], [], 0
            yield _batch(keys, nos, counts, contents, digests)

    return write


def _batch(keys, nos, counts, contents, digests) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(nos, pa.int32()), pa.array(counts, pa.int32()), pa.array(contents, pa.binary()), pa.array(digests, pa.string())],
        ["record_key", "chunk_no", "chunk_count", "content", "prefix_sha256"],
    )


def write_archive(pages: DataFrame, path: str, *, chunk: int = CHUNK, least_bytes: int = LEAST_BYTES, date: str | None = None) -> None:
    """Writes one record for each row of pages (page_id, url, html) to the table at path."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    short_batches(pages.sparkSession)
    typed = with_types(pages, least_bytes).withColumn("record_key", F.monotonically_increasing_id())
    typed.mapInArrow(_chunks(chunk, date), CHUNK_SCHEMA).write.parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _read(batches):
    """Folds chunk rows, those of a record one after another, into one row a record; the state is a digest and counts."""
    state = None
    for batch in batches:
        out = []
        columns = (batch.column(c) for c in ("record_key", "chunk_no", "chunk_count", "content", "prefix_sha256"))
        for key, no, count, content, prefix in zip(*columns, strict=True):
            key, no, count, view = key.as_py(), no.as_py(), count.as_py(), memoryview(content.as_buffer())
            if no == 0:
                text = bytes(view[:65536])
                if text.count(b"\r\n\r\n") < 2:  # a long url; the first chunk holds both headers
                    text = bytes(view)
                body = text.index(b"\r\n\r\n", 0) + 4
                payload = text.index(b"\r\n\r\n", body) + 4
                fields, http = _fields(text[: body - 4]), _fields(text[body : payload - 4])
                state = {"key": key, "next": 0, "fields": fields, "http": http, "sha": hashlib.sha256(), "size": 0, "block": payload - body}
                view = view[payload:]
            if state is None or (state["key"], state["next"]) != (key, no):
                raise ValueError(f"record {key}: chunk {no} out of order")
            if no == count - 1:
                view = view[:-4]
            state["sha"].update(view)
            state["size"] += len(view)
            state["next"] += 1
            if state["sha"].hexdigest() != prefix.as_py():
                raise ValueError(f"record {key}: chunk {no} does not have its digest")
            if no == count - 1:
                out.append(_record(state))
                state = None
        yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _record(s: dict) -> dict:
    f, kind = s["fields"], s["fields"]["warc-type"]
    digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(s["http"]["content-length"])
    if int(f["content-length"]) != s["block"] + s["size"] or kind == "response" and (s["size"], s["sha"].hexdigest()) != (size, digest):
        raise ValueError(f"record {s['key']}: payload and header differ")
    number = lambda x: int(x) if x else None
    return {"page_id": number(f["page-id"]), "url": f.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(f.get("refers-to-page-id"))}


def read_archive(chunks: DataFrame) -> DataFrame:
    """One verified row a record of an archive table. Records of one chunk are read in place, others sorted first."""
    short_batches(chunks.sparkSession)
    long = chunks.filter("chunk_count > 1").repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
    return chunks.filter("chunk_count = 1").mapInArrow(_read, RECORD_SCHEMA).unionByName(long.mapInArrow(_read, RECORD_SCHEMA))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to a new archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc"
    write_archive(pages, path, **options)
    return read_archive(spark.read.schema(CHUNK_SCHEMA).parquet(path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN first IS NOT NULL AND q.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND q.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
