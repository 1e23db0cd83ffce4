"""Identifiers that stand in texts: tokens of letters and digits, stored sorted.

``found`` has each identifier with its documents, range-partitioned and sorted
by identifier, so that an exact one or a prefix reads the row groups where it
can be. ``grams`` has the runs of three characters of each different identifier,
sorted by run, for identifiers that contain something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier, identifier_of
from .snapshots import DOC

#: Letters and digits, in parts joined by single separators; spaces end an identifier.
TOKEN = r"[\p{L}\p{N}]+(?:[-_/.][\p{L}\p{N}]+)*"
GRAM = 3


def extracted(texts: DataFrame) -> DataFrame:
    """(identifier, document_id) of ``texts`` (document_id, content), each once; a token needs a letter and a digit."""
    tokens = F.filter(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(r"\p{L}") & t.rlike(r"\p{N}"))
    each = texts.select(DOC, F.explode(F.array_distinct(tokens)).alias("token"))
    return each.select(identifier_of("token").alias("identifier"), DOC).where("identifier is not null").distinct()


def save(texts: DataFrame, root: str) -> None:
    extracted(texts).repartitionByRange("identifier", DOC).sortWithinPartitions("identifier", DOC).write.mode("overwrite").parquet(f"{root}/found")
    own = texts.sparkSession.read.parquet(f"{root}/found").select("identifier").distinct()
    at = F.sequence(F.lit(1), F.greatest(F.length("identifier") - GRAM + 1, F.lit(1)))
    grams = own.select("identifier", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("identifier", i, F.lit(GRAM))))).alias("gram"))
    grams.repartitionByRange("gram", "identifier").sortWithinPartitions("gram", "identifier").write.mode("overwrite").parquet(f"{root}/grams")


def find(spark: SparkSession, root: str, wanted: str, mode: str = "exact") -> DataFrame:
    """(document_id, score): 140 for the identifier itself, 130 for one that begins with it or contains it."""
    key, rows = identifier(wanted) or "", spark.read.parquet(f"{root}/found")
    if mode in ("exact", "prefix") or len(key) < GRAM:
        hit = {"exact": F.col("identifier") == key, "prefix": F.col("identifier").startswith(key), "contains": F.col("identifier").contains(key)}[mode]
        rows = rows.where(hit if key else F.lit(False))
    else:
        grams = sorted({key[i : i + GRAM] for i in range(len(key) - GRAM + 1)})
        every = spark.read.parquet(f"{root}/grams").where(F.col("gram").isin(grams)).groupBy("identifier").agg(F.count("*").alias("n"))
        rows = rows.join(every.where((F.col("n") == len(grams)) & F.col("identifier").contains(key)), "identifier", "left_semi")
    return rows.groupBy(DOC).agg(F.max(F.when(F.col("identifier") == key, 140).otherwise(130)).alias("score"))
