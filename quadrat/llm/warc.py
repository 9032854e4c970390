"""WARC archives: a writer that records repeated payloads as revisits, and a sequential reader.

Each record is its own gzip member, so a reader inflates an archive piece by piece and can
stop or start at any member. Records hold an HTTP response block; a revisit holds only the
HTTP headers, whose Content-Length is that of the payload it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, is_small, materialize, new_folder

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. ``digest``: hex SHA-1 of the payload, written in base32 as the format has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def gzip_members(source) -> Iterator[bytes]:
    """The inflated bytes of each gzip member of a file object, one member at a time."""
    waiting, inflate, got = b"", zlib.decompressobj(31), []
    while True:
        chunk = waiting or source.read(READ_BYTES)
        waiting = b""
        if not chunk:
            if got:
                raise ValueError("the archive ends inside a gzip member")
            return
        got.append(inflate.decompress(chunk))
        if inflate.eof:
            yield b"".join(got)
            waiting, inflate, got = inflate.unused_data, zlib.decompressobj(31), []


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. Framing and the block's digest are checked."""
    for member in gzip_members(source):
        head, _, rest = member.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block, tail = rest[:length], rest[length:]
        if len(block) != length or tail != b"\r\n\r\n":
            raise ValueError(f"bad framing in {headers.get('warc-record-id')}")
        said = headers.get("warc-block-digest", "").removeprefix("sha1:")
        if said and base64.b32decode(said) != hashlib.sha1(block).digest():
            raise ValueError(f"bad block digest in {headers.get('warc-record-id')}")
        yield headers, block


def parse_record(headers: dict[str, str], block: bytes) -> dict:
    """A page's row; a response's payload is checked against its length and digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"bad payload in {headers.get('warc-record-id')}")
    to = headers.get("x-refers-to-page-id")
    page = headers.get("x-page-id")
    return {
        "page_id": int(page) if page else None, "payload_bytes": length, "payload_digest": digest.hex(), "record_type": headers["warc-type"],
        "refers_to": int(to) if revisit and to else None, "payload": None if revisit else payload,
    }


def plan_records(pages: DataFrame, least_bytes: int = 1000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for responses.

    Of the rows with equal payloads of at least ``least_bytes`` bytes, those with the largest
    page_id are responses (several only if rows repeat that id) and the others refer to it.
    A null page_id counts as the smallest.
    """
    # Only what is needed below, so other columns may have any names.
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # SHA-1 is the record's digest; whether payloads are equal is told by SHA-256.
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= least_bytes, F.sha2(F.col("html").cast("binary"), 256)))
    large = rows.where("same is not null").select("page_id", "same")
    firsts = large.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("same", "refers_to")
    firsts = materialize(firsts, "repeated")
    side = F.broadcast(firsts) if is_small(firsts, broadcast_rows) else firsts
    joined = rows.join(side, "same", "left")
    revisit: Column = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """One archive for each partition that has rows; returns (path, records), already written."""

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def records():
            nonlocal count
            for batch in batches:
                for page_id, url, html, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    count += 1
                    yield warc_record(page_id, url, html.encode(), digest, to, to is not None)

        found = records()
        first = next(found, None)
        if first is None:
            return
        SharedFiles(folder).write(name, (x for part in ([first], found) for x in part))
        yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([count], pa.int64())})

    return materialize(planned.mapInArrow(write, "name string, records bigint"), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The rows of all archives named in ``archives``; payloads only on request."""
    columns = [x.strip() for x in RECORD.split(",")][: 6 if payloads else 5]
    names = [x.split()[0] for x in columns]
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in columns])

    def read(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with SharedFiles(folder).open(name) as source:
                    for headers, block in read_records(source):
                        row = parse_record(headers, block)
                        rows.append({k: row[k] for k in names})
                        held += len(block)
                        if len(rows) >= 2000 or payloads and held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("name").repartition(max(1, archives.count()), "name").mapInArrow(read, ", ".join(columns))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page as a record, then reads all archives back: a row for each page.

    No pages: no archives and no rows. Pages of one row group become one archive.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder)
