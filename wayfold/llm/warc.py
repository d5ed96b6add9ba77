"""Operator 4: WARC output and input, index first.

Writing: each task appends one gzip member per record to its own file and returns an index row (offset, length, URL,
digest). Reading: index rows are chosen first, sorted by file and offset, and near byte ranges are read as one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_fs, written

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Ranges of one file no farther apart are read together, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of a file that one reading task takes, about.
TASK_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url: str, payload: bytes | None, digest: str, refers, date: str) -> bytes:
    """One record; payload is None for a revisit of page `refers`."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + (b"\r\n" if payload is None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if payload is None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers)), ("X-Refers-To-Page-ID", str(refers))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, payload) of one uncompressed record; the payload of an HTTP record is the body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block


def write_warc(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) and return the written index table.

    Null html is an empty payload, a null url an empty one. Of rows with equal payloads of at least revisit_bytes bytes,
    those with the smallest page_id are responses (repeated rows with that id all are), the others revisit it. A null
    page_id is always a response. Other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = rows.where((F.octet_length("html") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"))
    # Only ids and digests are dealt by digest; of the revisits' payloads nothing travels further.
    later = rows.select("page_id", "digest").join(firsts, "digest").where("page_id > first").select(F.col("page_id").alias("later"), F.col("digest").alias("known"), "first").distinct()
    rows = rows.join(later, F.expr("page_id = later and digest = known"), "left").select(
        "page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "digest", "first"
    )

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        # An attempt has a file of its own, which its index rows name: whichever attempt counts, both fit together.
        path = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out = fs = temp = None
        at = 0
        for batch in batches:
            index = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, p = open_fs(path)
                    temp = f"{p}.{uuid.uuid4().hex}.part"
                    fs.create_dir(p.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(temp)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(_record(page_id, url, None if html is None else html.encode(), digest, first, date)) + z.flush()
                out.write(data)
                index.append((path, at, len(data), page_id, url, digest, "response" if html is not None else "revisit"))
                at += len(data)
            if index:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _TYPES, strict=True)], _NAMES)
        if out is not None:
            out.close()
            fs.move(temp, p)

    return written(rows.mapInArrow(run, INDEX), "warc-index")


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) to reads (offset, end, first, last): ranges first..last - 1 lie in one read."""
    reads: list[list[int]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], offset + length)
            reads[-1][3] = k + 1
        else:
            reads.append([offset, offset + length, k, k + 1])
    return [tuple(r) for r in reads]


def read_warc(index: DataFrame) -> DataFrame:
    """Read the records of the chosen index rows: (page_id, url, record_type, payload, digest, stated_digest, refers_to).

    payload and digest (SHA-256 of the payload read) are null for revisits, which carry none. Records of other writers
    have no page_id. No rows chosen give no rows.
    """

    def run(batches):
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in ("file", "offset", "length"))
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a]:
                    b += 1
                fs, path = open_fs(files[a])
                with fs.open_input_file(path) as f:
                    spans = list(zip(offsets[a:b], lengths[a:b], strict=True))
                    for start, end, first, last in coalesce(spans):
                        f.seek(start)
                        data = f.read(end - start)
                        rows = []
                        for offset, length in spans[first:last]:
                            h, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                            page, refers, kind = h.get("x-page-id"), h.get("x-refers-to-page-id"), h["warc-type"]
                            full = kind != "revisit"
                            rows.append((int(page) if page else None, h.get("warc-target-uri"), kind, payload if full else None, hashlib.sha256(payload).hexdigest() if full else None, h.get("warc-payload-digest", "").removeprefix("sha256:"), int(refers) if refers else None))
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                a = b

    names = ["page_id", "url", "record_type", "payload", "digest", "stated_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, ceil(total / TASK_BYTES))
    # Dealt by the bytes that the rows stand for: a stretch of a file is one task's, and the number of tasks is given.
    chosen = index.select("file", "offset", "length", F.expr(f"offset div {TASK_BYTES}").alias("stretch")).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return chosen.drop("stretch").mapInArrow(run, "page_id long, url string, record_type string, payload binary, digest string, stated_digest string, refers_to long")


def page_digests(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, revisits resolved through the page they refer to.

    A revisit whose page is not among the chosen records keeps its stated digest and has null payload_bytes.
    """
    read = written(read_warc(index).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "stated_digest"), "warc-read")
    full = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    target = full.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("stated_digest")).distinct()
    again = read.where("record_type = 'revisit'").select("page_id", "refers_to", "stated_digest")
    again = again.join(target, ["refers_to", "stated_digest"], "left").select("page_id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.union(again)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All of pages, written and read back."""
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return page_digests(index)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM q
"""
