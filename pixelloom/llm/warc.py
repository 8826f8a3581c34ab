"""WARC archives in seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file held as one row ``(bundle, content)``. Its WARC records are grouped
into independent Zstandard frames of about ``frame_bytes``; after them come a skippable frame with
the record index (record id to frame number, offset inside the frame and length) and, last, the
footer seek table of the Zstandard seekable format, so that any decoder reads the file front to back
and a reader with a record id decompresses one frame only.

A record whose payload equals that of a smaller page id is a ``revisit`` of it, payload left out;
payloads under ``min_revisit_bytes`` are always written in full.

Defined cases: null html is an empty payload; a null url leaves WARC-Target-URI out; a null page id
sorts last and is never referred to; rows that repeat a page id and its payload are all responses, of one record id (``fetch``
finds the first of a bundle, ``load`` all); a very long payload is a frame of its own; an empty table gives no bundle; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# Fixed values of the Zstandard seekable format and of the index frame that precedes its table.
SEEK_MAGIC = 0x8F92EAB1
SEEK_SKIPPABLE = 0x184D2A5E
INDEX_SKIPPABLE = 0x184D2A50
BUNDLE_SCHEMA = "bundle string, n_records int, content binary"
PAGE_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def plan(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, sha1, first_id``; ``first_id`` is null for responses.

    The smallest id of each payload is aggregated before the shuffle; a payload that very many pages
    share is then one row to join with, and the planner can split its partition.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    same = (F.length("payload") >= min_revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return rows.join(first, "sha1").withColumn("first_id", F.when(same, F.col("first_id")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first_id is not None:
        head += [f"WARC-Refers-To: <urn:page:{first_id}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def pack_bundle(records: list[tuple[str, bytes]], frame_bytes: int = 1 << 16, level: int = 3) -> bytes:
    """The bytes of one bundle of ``(record id, record)``."""
    z = zstandard.ZstdCompressor(level=level)
    frames: list[bytes] = []
    sizes: list[int] = []
    index: list[tuple[str, int, int, int]] = []
    held = bytearray()

    def close() -> None:
        frames.append(z.compress(bytes(held)))
        sizes.append(len(held))
        held.clear()

    for name, data in records:
        if held and len(held) + len(data) > frame_bytes:
            close()
        index.append((name, len(frames), len(held), len(data)))
        held += data
    if held:
        close()
    named = skippable(INDEX_SKIPPABLE, zstandard.ZstdCompressor(level=level).compress(json.dumps(index).encode()))
    # The index frame counts as a frame without content, so that offsets in the table stay true.
    table = b"".join(struct.pack("<II", len(f), n) for f, n in [*zip(frames, sizes), (named, 0)]) + struct.pack("<IBI", len(frames) + 1, 0, SEEK_MAGIC)
    return b"".join(frames) + named + skippable(SEEK_SKIPPABLE, table)


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """``(offset, compressed, decompressed)`` of every frame, read from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    first = len(content) - 9 - width * count
    for k in range(count):
        packed, raw = struct.unpack_from("<II", content, first + width * k)
        out.append((at, packed, raw))
        at += packed
    return out


def record_index(content: bytes) -> list[tuple[str, int, int, int]]:
    at, packed, _ = seek_table(content)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(content[at + 8 : at + packed]))]


def frame(content: bytes, k: int) -> bytes:
    at, packed, raw = seek_table(content)[k]
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=raw)


def fetch(content: bytes, name: str) -> bytes | None:
    """The record of that id, by decompressing one frame."""
    for known, k, at, size in record_index(content):
        if known == name:
            return frame(content, k)[at : at + size]
    return None


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("a payload differs from its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, path: str, frame_bytes: int = 1 << 16, bundle_bytes: int = 1 << 23, level: int = 3, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0, **columns: str) -> None:
    """Write ``pages`` as a table of bundles under ``path``, each of about ``bundle_bytes`` of records."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0

        def row() -> pa.RecordBatch:
            name = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(b"".join(x[0].encode() + b"," for x in held)).hexdigest()).hex
            return pa.RecordBatch.from_pydict({"bundle": [f"{name}.warc.zst"], "n_records": pa.array([len(held)], pa.int32()), "content": pa.array([pack_bundle(held, frame_bytes, level)], pa.binary())})

        for batch in batches:
            for x in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(x["sha1"])).decode()
                data = record(x["page_id"], x["url"], x["payload"], digest, x["first_id"], date)
                held.append((f"<urn:page:{'' if x['page_id'] is None else x['page_id']}>", data))
                size += len(data)
                if size >= bundle_bytes:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    planned = plan(pages, min_revisit_bytes, **columns).select("page_id", "url", "payload", "sha1", "first_id")
    planned.mapInArrow(bundles, BUNDLE_SCHEMA).write.option("compression", "none").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles under ``path``, payloads checked against their digests."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                by_frame: dict[int, list[tuple[int, int]]] = {}
                for _, k, at, size in record_index(data):
                    by_frame.setdefault(k, []).append((at, size))
                for k, places in by_frame.items():
                    raw = frame(data, k)
                    yield pa.RecordBatch.from_pylist([parse(raw[at : at + size]) for at, size in places], schema)

    return spark.read.parquet(path).select("content").mapInArrow(records, PAGE_SCHEMA)


def archive_path(spark: SparkSession) -> str:
    """A new folder for bundles beside the checkpoints, which all executors share."""
    cut(spark.range(0))  # sets the folder where the session names none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
