"""What OCR read, by content: a table that only grows by what nobody has read yet.

Results are keyed by the SHA-256 of the content and kept under a log of
snapshots (status ``complete``, ``low_confidence`` or ``failed``). A run asks
the provider for the contents that the table lacks, once each however many
files have them; changed content is another key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots

RESULTS = "content_hash string, text string, confidence double, status string, batch string"
#: Confidence from which a reading counts as complete; fixed value.
SURE = 0.55

Provider = Callable[[bytes], tuple[str, float]]


def cached(spark: SparkSession, root: str) -> DataFrame:
    """All results, each content once."""
    found = snapshots.read(spark, root)
    if found is None:
        return spark.createDataFrame([], RESULTS)
    rows = snapshots.table(spark, root, found, "results")
    newest = F.max_by(F.struct("text", "confidence", "status", "batch"), "__segment")  # two writers may have read one content
    return rows.groupBy("content_hash").agg(newest.alias("r")).select("content_hash", "r.*")


def recognise(files: DataFrame, provider: Provider, root: str, batch: str) -> DataFrame:
    """``files`` (with content) with content_hash, text, confidence, status and the batch that read it; reads what the cache lacks."""
    spark = files.sparkSession
    keyed = files.withColumn("content_hash", F.sha2("content", 256))
    misses = keyed.select("content_hash", "content").join(cached(spark, root).select("content_hash"), "content_hash", "left_anti")
    once = misses.groupBy("content_hash").agg(F.first("content").alias("content"))

    def run(batches):
        import pandas as pd

        for part in batches:
            rows = []
            for key, content in zip(part["content_hash"], part["content"]):
                try:
                    text, confidence = provider(bytes(content))
                    rows.append((key, text, float(confidence), "complete" if confidence >= SURE else "low_confidence", batch))
                except Exception:  # noqa: BLE001  a content that cannot be read must not end the job, nor be read at every run
                    rows.append((key, None, None, "failed", batch))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULTS.split(", ")])

    segment = f"read-{batch}"
    once.mapInPandas(run, RESULTS).write.mode("overwrite").parquet(f"{root}/{segment}/results")
    base = snapshots.read(spark, root)
    if base is None or segment not in base.segments:
        snapshots.commit(spark, root, base, [*(base.segments if base else ()), segment], {"name": segment})
    return keyed.join(cached(spark, root), "content_hash", "left")


def compact(spark: SparkSession, root: str, name: str) -> snapshots.Snapshot:
    """One segment with each content once."""
    cached(spark, root).write.mode("overwrite").parquet(f"{root}/{name}/results")
    return snapshots.commit(spark, root, snapshots.read(spark, root), [name], {"name": name})
