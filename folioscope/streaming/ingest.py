"""Continuous ingest: new files of a folder go through the same parser into the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import EXTENSIONS, parse_files
from ..sources.index import from_parsed, merge

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, ocr=None, version: str = "stream"):
    """A streaming query into the index at ``root``, which ``index.load`` reads.

    Each micro-batch is parsed once and merged: a file that changed replaces
    what it was, and a repeated batch changes nothing. What one listing does not
    show is no sign that a file is gone, so nothing is removed.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).load(folder)
    known = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(EXTENSIONS))

    def write(batch: DataFrame, number: int) -> None:
        staging = f"{root}/_parsed/{version}-{number}"
        parsed = parse_files(batch, ocr)
        parsed.write.mode("overwrite").parquet(staging)
        corpus = from_parsed(spark.read.schema(parsed.schema).parquet(staging), folder)
        merge(corpus, root, f"{version}-{number}", removes=False, stream=(version, number))

    return known.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
