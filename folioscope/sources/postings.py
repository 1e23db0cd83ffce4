"""A stored inverted index: postings in blocks under a log of snapshots.

A segment numbers its chunks in the order of documents and cuts the numbers into
blocks of ``SPAN``. ``blocks`` has a row for each term and block: the places of
its chunks (offsets from the block's first number), how often the term stands in
each, their lengths, and the block's largest count and smallest length, which
bound every score in it. It is sorted and range-partitioned by term, so that a
prefix reads the row groups where it can be. ``spans`` has a row for each block:
documents, ordinals, sizes and hashes of its chunks. ``terms`` is the
dictionary, ``totals`` the number and length of the chunks. No text is kept.

Batches of documents become segments of their own; ``merged`` makes one segment
of all, without the postings of documents that went.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from . import places, snapshots
from .snapshots import DOC

#: Chunks of a block, and the most places of a term in it.
SPAN = 4096
BLOCK = ("segment", "block")


@dataclass
class InvertedIndex:
    """What a query reads; ``ends`` (document_id) are documents that went, None if there are none."""

    blocks: DataFrame
    spans: DataFrame
    terms: DataFrame
    n: int
    length: int
    ends: DataFrame | None

    @property
    def mean(self) -> float:
        return self.length / self.n if self.n else 0.0


def _write(chunks: DataFrame, at: str, segment: str) -> None:
    spark = chunks.sparkSession
    ordered = chunks.select(DOC, "ordinal", "content").repartitionByRange(DOC).sortWithinPartitions(DOC, "ordinal")
    split = ordered.select(DOC, "ordinal", words("content").alias("w"), F.xxhash64("content").alias("hash"), F.length("content").alias("size"), F.monotonically_increasing_id().alias("number"))
    split = split.select(F.expr(f"number div {SPAN}").alias("block"), (F.col("number") % SPAN).cast("int").alias("place"), DOC, "ordinal", "w", "hash", "size")
    kind = {f.name: f.dataType.simpleString() for f in split.schema.fields}
    listed = f"places array<int>, documents array<{kind[DOC]}>, tfs array<int>, lengths array<int>, ordinals array<{kind['ordinal']}>, sizes array<int>, hashes array<bigint>"
    split.mapInArrow(_cut, f"term string, block long, max_tf int, min_length int, n int, length long, {listed}").write.mode("overwrite").parquet(f"{at}/_cut")
    cut = spark.read.parquet(f"{at}/_cut").withColumn("segment", F.lit(segment))

    spans = cut.where("term is null").select(*BLOCK, "places", "documents", "ordinals", "sizes", "hashes", F.col("n").cast("long").alias("n"), "length")
    _edged(spans).write.mode("overwrite").parquet(f"{at}/spans")
    rows = cut.where("term is not null").select("term", *BLOCK, "max_tf", "min_length", "n", "places", "tfs", "lengths", "documents")
    _sorted(rows).write.mode("overwrite").parquet(f"{at}/blocks")
    _dictionary(spark.read.parquet(f"{at}/blocks")).write.mode("overwrite").parquet(f"{at}/terms")
    ordered.select(DOC).limit(0).write.mode("overwrite").parquet(f"{at}/deletes")
    places.delete(spark, f"{at}/_cut")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without term for each block, and one for each term of it. Chunks come in the order of their numbers; a partition begins a block of its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            if held and held[-1].column("block")[0].as_py() != int(block[begin]):
                yield from _block(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield from _block(pa.Table.from_batches(held))


def _block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of one block of chunks."""
    column = lambda name: rows.column(name).combine_chunks()
    place, document, w = column("place"), column(DOC), column("w")
    length = pc.fill_null(pc.list_value_length(w), 0).cast(pa.int32())
    coded = w.flatten().dictionary_encode()
    lengths = length.to_numpy()
    key = coded.indices.to_numpy().astype("int64") * len(w) + np.repeat(np.arange(len(w)), lengths)
    key, tf = np.unique(key, return_counts=True)
    code, at = key // len(w), pa.array(key % len(w))
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(begin, len(code))
    tf = tf.astype("int32")
    starts = lambda n: pa.array(n.astype("int32"))
    lists = lambda x, n: pa.ListArray.from_arrays(starts(n), x)
    none = lambda n, kind: pa.nulls(n, kind)
    whole, number = np.array([0, len(w)]), rows.column("block")[0].as_py()
    own = {"ordinals": column("ordinal"), "sizes": column("size").cast(pa.int32()), "hashes": column("hash")}
    i32 = pa.int32()
    spans = [none(1, pa.string()), pa.array([number]), none(1, i32), none(1, i32), pa.array([len(w)], i32), pa.array([int(lengths.sum())])]
    spans += [lists(place, whole), lists(document, whole), none(1, pa.list_(i32)), none(1, pa.list_(i32)), *[lists(x, whole) for x in own.values()]]
    names = ["term", "block", "max_tf", "min_length", "n", "length", "places", "documents", "tfs", "lengths", *own]
    yield pa.RecordBatch.from_arrays(spans, names)
    if len(begin):
        n, long = len(begin), length.take(at)
        terms = [coded.dictionary.take(pa.array(code[begin])).cast(pa.string()), pa.array(np.full(n, number)), pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(long.to_numpy(), begin)), starts(np.diff(ends)), none(n, pa.int64())]
        terms += [lists(place.take(at), ends), lists(document.take(at), ends), lists(pa.array(tf), ends), lists(long, ends), *[none(n, pa.list_(x.type)) for x in own.values()]]
        yield pa.RecordBatch.from_arrays(terms, names)


def _edged(spans: DataFrame) -> DataFrame:
    """A document stands in several blocks only as the last of one and the first of the next."""
    return spans.withColumns({"first_document": F.col("documents")[0], "last_document": F.element_at("documents", -1)})


def _sorted(blocks: DataFrame) -> DataFrame:
    return blocks.repartitionByRange("term", *BLOCK).sortWithinPartitions("term", *BLOCK)


def _dictionary(blocks: DataFrame) -> DataFrame:
    """(term, tf, df, n_documents): occurrences, chunks and documents of each term.

    Only a term's first and last document in a block can stand in another block too, see ``_edged``; the others are counted where they are.
    """
    ends = F.array_distinct(F.array(F.element_at("documents", 1), F.element_at("documents", -1)))
    inner = F.when(F.col("n") > 2, F.size(F.array_distinct("documents")) - F.size(ends)).otherwise(0)
    total = F.when(F.col("max_tf") == 1, F.col("n").cast("long")).otherwise(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))
    counts = blocks.groupBy("term").agg(F.sum(total).alias("tf"), F.sum(F.col("n").cast("long")).alias("df"), F.sum(inner).alias("__inner"))
    edges = blocks.select("term", F.explode(ends).alias("d")).groupBy("term").agg(F.count_distinct("d").alias("__edges"))
    whole = counts.join(edges, "term").select("term", "tf", "df", (F.col("__inner") + F.col("__edges")).alias("n_documents"))
    return whole.repartitionByRange("term").sortWithinPartitions("term")


def _totals(spans: DataFrame) -> dict:
    t = spans.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return {"n": t.n or 0, "length": t.length or 0}


def add(chunks: DataFrame, root: str, segment: str) -> snapshots.Snapshot:
    """Index chunks (document_id, ordinal, content) of new documents as a segment."""
    spark = chunks.sparkSession
    base = snapshots.read(spark, root)
    if base and segment in base.segments:
        raise ValueError(f"segment {segment} exists")
    _write(chunks, f"{root}/{segment}", segment)
    totals = _totals(spark.read.parquet(f"{root}/{segment}/spans"))
    before = base.note if base else {"n": 0, "length": 0}
    return snapshots.commit(spark, root, base, [*(base.segments if base else ()), segment], {"name": segment, "ends": before.get("ends", False)} | {k: before[k] + totals[k] for k in totals})


def remove(spark: SparkSession, root: str, documents: DataFrame, segment: str) -> snapshots.Snapshot:
    """Documents (document_id) go: from every answer now, from the postings when segments are merged."""
    base = snapshots.read(spark, root)
    at = f"{root}/{segment}"
    for name in ("blocks", "spans", "terms"):
        snapshots.table(spark, root, base, name).drop("__segment").limit(0).write.mode("overwrite").parquet(f"{at}/{name}")
    documents.select(DOC).distinct().write.mode("overwrite").parquet(f"{at}/deletes")
    gone = _chunks(snapshots.table(spark, root, base, "spans")).join(spark.read.parquet(f"{at}/deletes"), DOC, "left_semi")
    lost = _live_places(spark, root, base, gone).select(*BLOCK, "place")
    length = snapshots.table(spark, root, base, "blocks").select(*BLOCK, F.explode(F.arrays_zip("places", "lengths")).alias("p")).select(*BLOCK, F.col("p.places").alias("place"), F.col("p.lengths").alias("length")).distinct()
    t = lost.join(length, [*BLOCK, "place"], "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    note = {"name": segment, "ends": True, "n": base.note["n"] - t.n, "length": base.note["length"] - t.length}
    return snapshots.commit(spark, root, base, [*base.segments, segment], note)


def _chunks(spans: DataFrame) -> DataFrame:
    """(segment, block, place, document_id, and __segment if there) of all chunks."""
    kept = [c for c in ("__segment",) if c in spans.columns]
    return spans.select(*BLOCK, *kept, F.explode(F.arrays_zip("places", "documents")).alias("p")).select(*BLOCK, *kept, F.col("p.places").alias("place"), F.col("p.documents").alias(DOC))


def _live_places(spark: SparkSession, root: str, base: snapshots.Snapshot, chunks: DataFrame) -> DataFrame:
    return snapshots.live(spark, root, base, "spans", chunks)


def merged(spark: SparkSession, root: str, segment: str) -> snapshots.Snapshot:
    """One segment of all, in which the postings of documents that went are gone. Blocks keep their numbers, so that no text is read."""
    base = snapshots.read(spark, root)
    at = f"{root}/{segment}"
    spans, blocks = (snapshots.table(spark, root, base, n) for n in ("spans", "blocks"))
    if base.note["ends"]:
        kept = _live_places(spark, root, base, _chunks(spans)).groupBy(*BLOCK).agg(F.collect_set("place").alias("kept"))
        spans, blocks = (t.join(kept, [*BLOCK]) for t in (spans, blocks))
        own = lambda *names: F.filter(F.arrays_zip(*names), lambda p: F.array_contains(F.col("kept"), p["places"]))
        blocks = blocks.withColumn("p", own("places", "tfs", "lengths", "documents")).where(F.size("p") > 0)
        blocks = blocks.select("term", *BLOCK, F.array_max("p.tfs").alias("max_tf"), F.array_min("p.lengths").alias("min_length"), F.size("p").alias("n"), *[F.col(f"p.{c}").alias(c) for c in ("places", "tfs", "lengths", "documents")])
        spans = spans.withColumn("p", own("places", "documents", "ordinals", "sizes", "hashes"))
        spans = spans.select(*BLOCK, *[F.col(f"p.{c}").alias(c) for c in ("places", "documents", "ordinals", "sizes", "hashes")], F.size("p").cast("long").alias("n"), "length").where("n > 0")
    _edged(spans.drop("__segment")).write.mode("overwrite").parquet(f"{at}/spans")
    _sorted(blocks.drop("__segment")).write.mode("overwrite").parquet(f"{at}/blocks")
    _dictionary(spark.read.parquet(f"{at}/blocks")).write.mode("overwrite").parquet(f"{at}/terms")
    snapshots.table(spark, root, base, "deletes").drop("__segment").limit(0).write.mode("overwrite").parquet(f"{at}/deletes")
    return snapshots.commit(spark, root, base, [segment], {"name": segment, "ends": False, "n": base.note["n"], "length": base.note["length"]})


def open_index(spark: SparkSession, root: str) -> InvertedIndex:
    """The current state; what is added later is not seen."""
    found = snapshots.read(spark, root)
    rows = lambda name: snapshots.table(spark, root, found, name)
    terms = rows("terms").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("tf", "df", "n_documents")]) if len(found.segments) > 1 else rows("terms").drop("__segment")
    ends = rows("deletes").groupBy(DOC).agg(F.max("__segment").alias("__end")) if found.note["ends"] else None
    return InvertedIndex(rows("blocks"), rows("spans"), terms, found.note["n"], found.note["length"], ends)
