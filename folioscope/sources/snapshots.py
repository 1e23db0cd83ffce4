"""A log of snapshots over immutable segments.

A segment is a folder with one folder a table, written once. A snapshot names
the segments that count, in order, in one small file of ``_log``; it exists when
that file has its name, so that readers see all of a change or nothing, and a
writer that lost a race is told. Rows are never rewritten: a later segment's
``deletes`` (document_id) end all rows of that document in segments before it.
What no snapshot names is invisible, and ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import places

DOC = "document_id"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    segments: tuple[str, ...]
    #: name, operation, counts, and the last batch of each stream.
    note: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.note.get("name") or (self.segments[-1] if self.segments else "")


def numbers(spark: SparkSession, root: str) -> list[int]:
    """All snapshots, the newest first."""
    return sorted((int(n[:-5]) for n, _ in places.children(spark, f"{root}/_log") if n.endswith(".json")), reverse=True)


def read(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    found = numbers(spark, root)
    if not found or number is not None and number not in found:
        return None
    number = found[0] if number is None else number
    entry = json.loads(places.read_text(spark, f"{root}/_log/{number:012d}.json"))
    return Snapshot(number, tuple(entry["segments"]), entry["note"])


def commit(spark: SparkSession, root: str, base: Snapshot | None, segments, note: dict) -> Snapshot:
    """The snapshot after ``base``, if nobody else has made it."""
    number = base.number + 1 if base else 1
    streams = (base.note.get("streams", {}) if base else {}) | note.get("streams", {})
    note = note | {"streams": streams}
    if not places.write_once(spark, f"{root}/_log/{number:012d}.json", json.dumps({"segments": list(segments), "note": note})):
        raise Conflict(f"snapshot {number} of {root} exists")
    return Snapshot(number, tuple(segments), note)


def table(spark: SparkSession, root: str, snapshot: Snapshot, name: str) -> DataFrame:
    """All rows that the snapshot's segments have, with the place of their segment."""
    parts = [spark.read.parquet(f"{root}/{s}/{name}").withColumn("__segment", F.lit(i)) for i, s in enumerate(snapshot.segments)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def live(spark: SparkSession, root: str, snapshot: Snapshot, name: str, rows: DataFrame | None = None) -> DataFrame:
    """The rows that no later segment has ended."""
    rows = table(spark, root, snapshot, name) if rows is None else rows
    if len(snapshot.segments) > 1:
        ends = table(spark, root, snapshot, "deletes").groupBy(F.col(DOC).alias("__doc")).agg(F.max("__segment").alias("__end"))
        rows = rows.join(ends, (F.col(DOC) == F.col("__doc")) & (F.col("__segment") < F.col("__end")), "left_anti")
    return rows.drop("__segment")


def vacuum(spark: SparkSession, root: str, keep: int = 3, age_s: float = 3600) -> list[str]:
    """Forgets all but the newest ``keep`` snapshots, then removes the segments that none of these names.

    Segments younger than ``age_s`` stay, as a writer may be about to commit them.
    """
    every = numbers(spark, root)
    for n in every[keep:]:
        places.delete(spark, f"{root}/_log/{n:012d}.json")
    named = {s for n in every[:keep] for s in read(spark, root, n).segments}
    before = (time.time() - age_s) * 1000
    gone = [n for n, changed in places.children(spark, root) if not n.startswith("_") and n not in named and changed <= before]
    for n in gone:
        places.delete(spark, f"{root}/{n}")
    return sorted(gone)
