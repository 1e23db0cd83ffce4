"""Where the library writes: below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, uri: str):
    """Hadoop's path, its file system and its file context, as the cluster configures them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(conf)
    path = system.makeQualified(path)
    return path, system, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        found = context.getCheckpointDir()
    return f"{hadoop(spark, found)[0].toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, uri: str) -> None:
    path, system, _ = hadoop(spark, uri)
    system.delete(path, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of the block; results don't depend on them."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def children(spark: SparkSession, uri: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what a folder holds; none if there is no such folder."""
    path, system, _ = hadoop(spark, uri)
    if not system.exists(path):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(path)]


def read_text(spark: SparkSession, uri: str) -> str:
    path, system, _ = hadoop(spark, uri)
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, uri: str, text: str) -> bool:
    """Puts a whole small file there by renaming it; False if another writer came first."""
    from py4j.protocol import Py4JJavaError

    path, system, files = hadoop(spark, uri)
    temp, *_ = hadoop(spark, f"{uri}.{uuid.uuid4().hex}.tmp")
    stream = system.create(temp, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        files.rename(temp, path, spark.sparkContext._gateway.new_array(options, 0))
    except Py4JJavaError as e:
        system.delete(temp, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True
