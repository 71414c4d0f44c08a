"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes one archive of single-member gzip records into the shared folder and returns
the index of what it wrote: file, offset, length, URL, digest.  An archive's name holds the task
attempt and only the index of the attempt that succeeded is used, so lost executors and repeated
attempts leave no wrong record.  Reading starts from the index: selected records, sorted by file and
offset, whose gaps are short become one ranged read.

Records with equal payloads of at least ``least`` bytes are written once: the one with the
smallest page_id is the response, the others revisit it and hold no payload.  A null html is an
empty payload, a null url is left out; rows that repeat the smallest page_id are all responses; a
null page_id counts as larger than any other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Widest gap that a ranged read takes along, and most bytes of one read.
GAP, MOST = 64 << 10, 8 << 20
#: Bytes of records that a reading task gets, on average at most.
PART = 64 << 20


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers of a record, its payload, and the Content-Length its HTTP header names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = re.search(rb"\r\nContent-Length: (\d+)", http)
    return fields, payload, int(named[1]) if named else len(payload)


def folder_of(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return f"{C.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes every row of ``pages`` to archives in ``folder``; returns their index, which stands in the shared folder too."""
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    held = held.withColumn("sha1", F.unhex(F.sha1("html")))
    # many equal pages stay where they are; of the others each digest has a few
    firsts = C.checkpoint(held.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")))
    rows = C.heavy_join(held, firsts, ["sha1"], "copies").select("page_id", "url", "html", "sha1", "first")
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    names = INDEX.replace(" long", "").replace(" string", "").split(", ")
    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                made = []
                for page, url, html, sha1, first in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    payload, text = html.encode(), base64.b32encode(sha1).decode()
                    revisit = len(payload) >= least and page != first
                    raw = gzip.compress(record(page, url, payload, text, first, revisit, date), 3, mtime=0)
                    out.write(raw)
                    made.append((page, name, at, len(raw), url, text, "revisit" if revisit else "response"))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 7, types, strict=True)], names)

    return C.checkpoint(rows.mapInArrow(run, INDEX))


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Slices i to j of sorted (file, offset, length) that one read covers."""
    i = 0
    for j in range(1, len(rows) + 1):
        if j < len(rows):
            (f, o, n), (g, p, m) = rows[j - 1], rows[j]
            if f == g and p - (o + n) <= GAP and p + m - rows[i][1] <= MOST:
                continue
        yield i, j
        i = j


def read_warc(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Reads the records that ``index`` selects; ``payload`` adds the text of responses.

    A response's length and digest are those of the payload as read; a damaged one raises an error.
    """
    names = RECORDS.replace(" long", "").replace(" string", "").split(", ") + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payload

    def number(urn: str) -> int | None:
        return int(x) if (x := urn[len("<urn:page:") : -1]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            urls = b.column("url").to_pylist()
            for i, j in ranges(rows):
                start = rows[i][1]
                with fs.open_input_file(f"{root}/{rows[i][0]}") as f:
                    raw = f.read_at(rows[j - 1][1] + rows[j - 1][2] - start, start)
                made = []
                for (_, o, n), url in zip(rows[i:j], urls[i:j], strict=True):
                    fields, body, size = parse(zlib.decompress(raw[o - start : o - start + n], 31))
                    sha1, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (digest(body) != sha1 or len(body) != size):
                        raise ValueError(f"damaged record at {o} of {rows[i][0]}")
                    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                    made.append((number(fields["WARC-Record-ID"]), url, size, sha1, kind, refers, *([body.decode() if kind == "response" else None] * payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, size // PART + 1)
    dealt = index.select("file", "offset", "length", "url").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORDS + ", payload string" * payload)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folder_of(spark)
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of SHA-1: five bytes give eight letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({x} >> {s}) & 31) + 1 AS BIGINT), 1)"
_FORTY = "CAST('0x' || substr(h, {i}, 10) AS BIGINT)"
op4_SQL = (
    "WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p), "
    "e AS (SELECT page_id, payload_bytes, "
    + " || ".join(_LETTER.format(x=_FORTY.format(i=i), s=s) for i in (1, 11, 21, 31) for s in range(35, -1, -5))
    + " AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM d) "
    "SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM e"
)
