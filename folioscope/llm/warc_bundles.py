"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME bytes. A
skippable frame with the seek table (compressed and plain size of each frame,
in the public seekable format) ends the file, so any standard decoder still
reads the whole archive. The index maps each record identifier to frame number
and offset within the frame's plain bytes: one record costs one range read.

Equal payloads are stored once: the record with the largest page_id is a
response, the others are revisits that carry digest and length of the full
payload and refer to it.

Null html counts as an empty payload; a null url is written as an empty target.
Null page_ids are never referred to unless all ids of that payload are null,
and then these records are responses. Repeated rows of the largest page_id are
all responses. Extra columns are ignored. An empty table writes no archive.
A long page has a frame of its own; the seek table holds sizes below 4 GiB,
which no value of a table reaches.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, RangeReader, discard, materialise, partitions, work_dir

FRAME = 1 << 18
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the public seekable format
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, path string, frame int, offset long, length long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Streams records into a seekable bundle; holds one frame."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard

        self.file, self.compress = AtomicFile(uri), zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int]] = []
        self.pending, self.size = [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number, and offset in that frame's plain bytes."""
        if self.size and self.size + len(data) > FRAME:
            self._flush()
        at = len(self.frames), self.size
        self.pending.append(data)
        self.size += len(data)
        return at

    def _flush(self) -> None:
        if self.size:
            data = self.compress(b"".join(self.pending))
            self.file.write(data)
            self.frames.append((len(data), self.size))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.commit()


class BundleReader:
    """Random access by frame; keeps the last frame."""

    def __init__(self, uri: str):
        import zstandard

        self.file, self.decompress = RangeReader(uri), zstandard.ZstdDecompressor().decompress
        n, _, magic = struct.unpack("<IBI", self.file.read(self.file.size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read(self.file.size - 9 - 8 * n, 8 * n)
        self.frames = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.begins = [0]
        for size, _ in self.frames:
            self.begins.append(self.begins[-1] + size)
        self.last, self.plain = -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.last:
            size, plain = self.frames[frame]
            self.last, self.plain = frame, self.decompress(self.file.read(self.begins[frame], size), max_output_size=plain)
        return self.plain[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def write_bundles(pages: DataFrame, out: str) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), a bundle for each partition; returns the index."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    # Only digests that several pages have, as a table of its own: a join with a hot one can be split.
    newest = materialise(rows.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest"), "newest")
    linked = rows.join(newest, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        path, bundle = f"{out}/bundle-{TaskContext.get().partitionId():06d}.warc.zst", None
        try:
            for batch in batches:
                bundle = bundle or Bundle(path)
                ids, places = batch.column(0).to_pylist(), []
                for i, url, digest, refers in zip(range(len(ids)), *(batch.column(k).to_pylist() for k in (1, 3, 4))):
                    data = record(ids[i], url, batch.column(2)[i].as_py(), digest, refers)
                    places.append((*bundle.add(data), len(data)))
                if places:
                    frame, offset, length = zip(*places)
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "record_id": [_urn(x) for x in ids], "path": [path] * len(ids), "frame": pa.array(frame, pa.int32()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})
            if bundle:
                bundle.close()
        except BaseException:
            if bundle:
                bundle.file.abandon()
            raise

    linked.mapInArrow(write, INDEX).write.parquet(f"{out}/index")
    discard(newest)
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def read_bundles(index: DataFrame) -> DataFrame:
    """What the archives say of each indexed record; digests of responses are taken anew from their payloads."""

    def read(batches):
        import pyarrow as pa

        path, bundle = None, None
        for batch in batches:
            out = []
            for where, frame, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if where != path:
                    if bundle:
                        bundle.close()
                    path, bundle = where, BundleReader(where)
                fields, payload = parse(bundle.read(frame, offset, length))
                response = fields["WARC-Type"] == "response"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {where}")
                out.append((_id(fields["WARC-Record-ID"]), len(payload) if response else int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], _id(fields.get("WARC-Refers-To"))))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in ROWS.split(", ")])
        if bundle:
            bundle.close()

    region = (F.col("frame") / 64).cast("int")
    dealt = index.repartition(partitions(index.sparkSession), "path", region).sortWithinPartitions("path", "frame", "offset")
    return dealt.select("path", "frame", "offset", "length").mapInArrow(read, ROWS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_dir(spark, "warc")))
