"""Content-addressed media payloads in tar shards.

A payload is stored as a lossless 8-bit grey PNG of ROW samples a line, as a
tar member named by the SHA-256 of the payload. Table rows carry digest, shard,
offset and length only. Width, height, depth and colour type come from range
reads of a member's first 33 bytes; the samples are read only where features
are wanted.

Each task writes the distinct payloads of its own rows, so copies within a
task are stored once without any text being shuffled; the index then keeps one
place for each digest (the first shard), which all rows with it share.

A null payload counts as empty. Payloads are padded with spaces to a positive
multiple of ROW bytes. Null ids and repeated rows are kept. Other columns are
ignored, whatever their names. An empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, RangeReader, partitions, slices, work_dir

ROW = 192
HEADER = 33  # signature and IHDR of a PNG
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PLACES = "id long, n_bytes long, digest string, path string, offset long, length long"
FEATURES = "digest string, format string, width int, height int, bit_depth int, colour_type int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """8-bit grey image of ROW samples a line; every line has filter 0."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """width, height, bit depth, colour type from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    width, height, depth, colour = png_header(data)
    if (depth, colour) != (8, 0):
        raise ValueError("not an 8-bit grey PNG")
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, moments and a 64-bit difference hash of the samples' coarse histogram."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 2, minlength=64)
    bits = int("".join("1" if a > b else "0" for a, b in zip(bins, np.roll(bins, -1))), 2)
    return f"grey8:{ROW}x{len(samples) // ROW}:{samples.mean():.3f}:{samples.std():.3f}:{bits:016x}"


def tar_header(name: str, size: int) -> bytes:
    head = struct.pack("100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x", name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"%011o\0" % 0, b" " * 8, b"0", b"", b"ustar\0", b"00", b"", b"", b"0000000\0", b"0000000\0", b"")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


class TarShards:
    """Writes members into shards of a bounded size; each shard appears when it is complete."""

    def __init__(self, stem: str, limit: int):
        self.stem, self.limit, self.file, self.n = stem, limit, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.file is not None and self.file.at >= self.limit:
            self.close()
        if self.file is None:
            self.path = f"{self.stem}-{self.n:04d}.tar"
            self.file = AtomicFile(self.path)
        self.file.write(tar_header(name, len(data)))
        offset = self.file.write(data)
        self.file.write(b"\0" * (-len(data) % 512))
        return self.path, offset

    def close(self) -> None:
        if self.file is not None:
            self.file.write(b"\0" * 1024)
            self.file.commit()
            self.file, self.n = None, self.n + 1

    def abandon(self) -> None:
        """After a failure: the open shard goes, a retried task writes all of them again."""
        if self.file is not None:
            self.file.abandon()


def store(rows: DataFrame, out: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Store ``rows`` (id, payload binary) in shards below ``out``; a place for every row."""
    spark = rows.sparkSession

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        shards, known = TarShards(f"{out}/shard-{TaskContext.get().partitionId():06d}", shard_bytes), {}
        try:
            for batch in batches:
                ids, payloads = batch.column(0), batch.column(1)
                for begin, end in slices(pc.fill_null(pc.binary_length(payloads), 0).to_pylist(), 1 << 24):
                    sizes, digests, places = [], [], []
                    for data in payloads.slice(begin, end - begin).to_pylist():
                        padded = pad(data or b"")
                        digest = hashlib.sha256(padded).digest()
                        if digest not in known:
                            media = to_png(padded)
                            known[digest] = (*shards.add(f"{digest.hex()}.png", media), len(media))
                        sizes.append(len(data or b""))
                        digests.append(digest.hex())
                        places.append(known[digest])
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), *(pa.array(x, t) for x, t in zip(zip(*places), (pa.string(), pa.int64(), pa.int64())))], names=["id", "n_bytes", "digest", "path", "offset", "length"])
            shards.close()
        except BaseException:
            shards.abandon()
            raise

    rows.mapInArrow(write, PLACES).write.parquet(f"{out}/places")
    return spark.read.schema(PLACES).parquet(f"{out}/places")


def index_of(places: DataFrame) -> DataFrame:
    """One place for each digest."""
    first = F.min(F.struct("path", "offset", "length")).alias("p")
    return places.groupBy("digest").agg(first).select("digest", "p.*")


def read_headers(index: DataFrame) -> DataFrame:
    """Metadata columns of each member, by range reads of its header only."""
    return _read(index, False).select("digest", "format", "width", "height", "bit_depth", "colour_type")


def read_features(index: DataFrame) -> DataFrame:
    """Metadata and features of each member, from the stored bytes."""
    return _read(index, True)


def _read(index: DataFrame, whole: bool) -> DataFrame:
    region = F.col("offset").bitwiseAND(F.lit(-(64 << 20)))  # members of a part of a shard are read by one task

    def read(batches):
        import pyarrow as pa

        path, file = None, None
        for batch in batches:
            out = []
            for digest, where, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if where != path:
                    if file:
                        file.close()
                    path, file = where, RangeReader(where)
                width, height, depth, colour = png_header(file.read(offset, HEADER))
                row = [digest, "png", width, height, depth, colour]
                if whole:
                    media = file.read(offset, length)
                    payload = from_png(media)
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)]
                else:
                    row += [None] * 6
                out.append(row)
            if out:
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in FEATURES.split(", ")])
        if file:
            file.close()

    dealt = index.repartition(partitions(index.sparkSession), "path", region).sortWithinPartitions("path", "offset")
    return dealt.select("digest", "path", "offset", "length").mapInArrow(read, FEATURES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = store(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload")), work_dir(spark, "media"))
    features = read_features(index_of(places))
    return places.select(F.col("id").alias("doc_id"), "n_bytes", "digest").join(features, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "width", "height"
    )
