"""Shared places and small helpers of the text-preparation operators.

Whatever an operator writes lies below the folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is absent (tests on one
machine) is a folder of our own set.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, uri: str):
    """Hadoop's path and its file system, as the cluster configures them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors can see; without a scheme it is on the cluster's default file system."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        found = context.getCheckpointDir()
    path, system = _path(spark, found)
    return system.makeQualified(path).toString()


_OPEN: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; inside ``temporary`` it goes when that ends."""
    found = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(found)
    return found


def remove(spark: SparkSession, uri: str) -> None:
    path, system = _path(spark, uri)
    system.delete(path, True)


@contextmanager
def temporary(spark: SparkSession):
    """Removes all working folders that were made inside, also after a failure."""
    _OPEN.append([])
    try:
        yield
    finally:
        for uri in _OPEN.pop():
            remove(spark, uri)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores after it until no column has it, whatever its case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_to(df: DataFrame, path: str) -> DataFrame:
    """Write as a table and read it back."""
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as a table in the shared folder and read it back: cuts the lineage durably."""
    return write_to(df, work_dir(df.sparkSession, name))


def discard(df: DataFrame) -> None:
    """Remove the table of ``materialise`` when nothing reads it any more."""
    remove(df.sparkSession, df.written_to)


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Binary file that appears under its name only when complete; a retried task overwrites it."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which the data begins."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)

    def abandon(self) -> None:
        """After a failure: nothing stays."""
        self.out.close()
        self.fs.delete_file(self.temp)


class RangeReader:
    """Reads byte ranges of one file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()


def slices(sizes, limit: int):
    """Cut indexes so that each slice holds about ``limit`` of the summed sizes: (begin, end) pairs."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Returns to the system what a worker process no longer uses, also of tasks that it ran before."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
