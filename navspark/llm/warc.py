"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with an index frame, which maps each record's
identifier to its frame and its offset within the uncompressed frame, and a seek table in the public
seekable format (both are skippable frames, so any Zstandard reader can read the whole bundle). Of
records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is a response and
the others are revisits of it; smaller ones are all responses.

A null html is an empty payload; a null url has no target header. Null page_ids are smaller than any;
payloads that only null page_ids share are all responses, and so are rows that repeat the largest
page_id. An empty table gives no bundles. Other columns are not stored. A bundle's name holds the task
attempt and only names in the committed manifest are read, so a lost executor leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import checked, scratch, table, written

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Fixed values of the public seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{sha1}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at this offset: headers, block, and the offset behind it."""
    stop = frame.index(b"\r\n\r\n", at)
    lines = frame[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at offset {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, frame[stop + 4 : end], end + 4


class Bundle:
    """Collects records; finish() gives the file's bytes."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int, int]] = []
        self.frame = bytearray()
        self.index: dict[str, tuple[int, int]] = {}
        self.raw = 0
        self.compress = zstandard.ZstdCompressor(level=3).compress

    def add(self, name: str, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self._close()
        self.index[name] = (len(self.parts), len(self.frame))
        self.frame += data
        self.raw += len(data)

    def _close(self) -> None:
        data = bytes(self.frame)
        self.parts.append(self.compress(data))
        self.sizes.append((len(self.parts[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.frame = bytearray()

    def finish(self) -> bytes:
        if self.frame:
            self._close()
        index = self.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        sizes = [*self.sizes, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        rows = b"".join(struct.pack("<III", *x) for x in sizes)
        seek = struct.pack("<II", TABLE_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(sizes), 0x80, FOOTER_MAGIC)
        return b"".join([*self.parts, index, seek])


class Reader:
    """Reads frames of a bundle by its seek table, one at a time."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{path} has no seek table")
        rows = self.file.read_at(12 * count, size - 9 - 12 * count)
        self.sizes = [struct.unpack_from("<III", rows, 12 * k) for k in range(count)]
        self.begin = [0]
        for x in self.sizes:
            self.begin.append(self.begin[-1] + x[0])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        data = self.decompress(self.file.read_at(self.sizes[k][0], self.begin[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sizes[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def index(self) -> dict[str, tuple[int, int]]:
        raw = self.file.read_at(self.sizes[-1][0], self.begin[-2])
        return {k: tuple(v) for k, v in json.loads(self.decompress(raw[8:])).items()}

    def record(self, name: str) -> tuple[dict[str, str], bytes]:
        """One record by its identifier; only its frame is read."""
        k, offset = self.index()[name]
        return parse(self.frame(k), offset)[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.sizes) - 1):
            data, at = self.frame(k), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1, refers_to (null for responses), is_revisit."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    equal = large.groupBy("sha1").agg(F.max("page_id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1 and of is not null")
    equal = written(equal.select(F.col("sha1").alias("equal_sha1"), "of"), "warc-equal")
    both = rows.join(checked(equal), (rows["sha1"] == equal["equal_sha1"]) & (F.octet_length("payload") >= MIN_REVISIT), "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return both.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("of")).alias("refers_to"), revisit.alias("is_revisit"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes the bundles under path; the manifest: bundle (file name), records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(path)
        fs.create_dir(root, recursive=True)
        context, bundle, made = TaskContext.get(), Bundle(), 0

        def close() -> pa.RecordBatch:
            nonlocal bundle, made
            name, data = f"{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst", bundle.finish()
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"bundle": [name], "records": pa.array([len(bundle.index)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            bundle, made = Bundle(), made + 1
            return row

        for batch in batches:
            for page_id, url, payload, sha1, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, payload, sha1, refers_to, is_revisit)
                bundle.add(record_id(page_id, sha1), data)
                if bundle.raw >= BUNDLE_BYTES:
                    yield close()
        if bundle.raw:
            yield close()

    return written(planned(pages).mapInArrow(run, "bundle string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's bundles."""

    def number(name: str) -> int | None:
        found = name.split(":")[2]
        return None if found == "none" else int(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for head, block in Reader(fs, f"{root}/{name}").records():
                    http, payload = block.split(b"\r\n\r\n", 1)
                    size = int(http.rsplit(b": ", 1)[1])
                    sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = head["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what was written")
                    rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, sha1, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    bundles = manifest.select("bundle")
    parts = max(1, min(bundles.count(), 4096))
    return bundles.repartition(parts).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), path)
    return read(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     g as (select *, max(page_id) over (partition by payload_digest) as of from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> of then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> of then of end as refers_to
from g"""
