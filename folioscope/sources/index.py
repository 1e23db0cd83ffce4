"""The index: files as documents, values, chunks and unread files, in segments under a log of snapshots.

A new run is merged by content hash: only files that are new or changed are
written, into a segment of their own, and documents that changed or went are
ended by the segment's ``deletes``. How labels were read is counted in each
segment (``readings``), with negative counts for what went, so that fields,
their names and their kinds follow from the sums of small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as val
from ..functions.text import canonical_key_of, fold_any
from . import concepts, covers, snapshots
from .files import discover, parse_cached, parse_files
from .snapshots import Snapshot
from .tables import Corpus

TABLES = ("documents", "values", "unindexed", "chunks")
DOC = "document_id"


def origin_of(path: Column, folder: str) -> Column:
    """Folder below the source, or the source's own name at its root."""
    inside = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^\\Q" + folder.rstrip("/") + "\\E/", "")
    parent = F.regexp_replace(inside, "/?[^/]*$", "")
    return F.when(parent == "", F.lit(folder.rstrip("/").rpartition("/")[2])).otherwise(parent)


def build(spark: SparkSession, folder: str, ocr=None, staging: str | None = None, cache: tuple[str, str] | None = None) -> Corpus:
    """Parse a folder. Ids are hashes of paths, so they survive a new run.

    With ``staging`` the parsed files are written there once, so that the four
    tables don't parse (and read by OCR) every file again. ``cache`` is the
    folder of the OCR cache and the name of this run in it.
    """
    if ocr is not None and cache is not None:
        parsed = parse_cached(discover(spark, folder), ocr, *cache, f"{staging}-ocr")
    else:
        parsed = parse_files(discover(spark, folder), ocr)
    if staging is not None:
        parsed.write.mode("overwrite").parquet(staging)
        parsed = spark.read.schema(parsed.schema).parquet(staging)
    return from_parsed(parsed, folder)


def typed(records: DataFrame) -> DataFrame:
    """Values of records (document_id, ocr_status, ordinal, label, value, location, record_scope)."""
    x = F.col("value")
    kind = val.kind_of(F.col("label"), x)
    number = F.when(kind == "money", val.money_amount(x)).when(kind == "percentage", val.exact_amount(F.regexp_replace(x, r"\s*%$", ""))).when(kind == "number", val.exact_amount(x))
    return records.select(
        "document_id", F.col("label").alias("concept"), "label", canonical_key_of(fold_any("label")).alias("key"), "ordinal", kind.alias("value_type"), x.alias("text_value"), fold_any(x).alias("literal_value"),
        number.alias("numeric"), F.when(kind == "money", val.money_currency(x)).alias("currency"), val.date_value(x).alias("date_value"), "record_scope", "location",
        F.col("ocr_status").isin("not_required", "complete").alias("reliable"),
    )


def from_parsed(parsed: DataFrame, folder: str) -> Corpus:
    rows = parsed.withColumn("document_id", F.xxhash64("path")).withColumn("origin", origin_of(F.col("path"), folder))
    read = rows.where("reason is null")
    documents = read.select("document_id", "path", F.element_at(F.split("path", "/"), -1).alias("title"), "origin", "extension", "parser", "content_hash", "size_bytes", "ocr_status", F.lit(None).cast("double").alias("ocr_confidence"), F.col("mismatch").alias("declared_format_mismatch"))
    records = read.select("document_id", "ocr_status", F.posexplode("records").alias("ordinal", "r")).select("document_id", "ocr_status", "ordinal", "r.*")
    unindexed = rows.where("reason is not null").select("path", "origin", "extension", "reason")
    chunks = read.select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.ordinal", "c.location", "c.content")
    return Corpus(documents, typed(records), unindexed, chunks)


def with_covers(corpus: Corpus) -> Corpus:
    """Adds what the cover pass finds in PDF documents without any record, by the labels of the others."""
    bare = corpus.documents.where("parser = 'pdf'").join(corpus.values.select(DOC), DOC, "left_anti").select(DOC, "ocr_status")
    pairs = covers.cover_lines(corpus.chunks.join(bare, DOC, "left_semi"), covers.vocabulary(corpus.values))
    records = pairs.join(bare, DOC).select(DOC, "ocr_status", F.col("line").alias("ordinal"), "label", "value", F.lit("carátula").alias("location"), F.lit(None).cast("string").alias("record_scope"))
    return Corpus(corpus.documents, corpus.values.unionByName(typed(records)), corpus.unindexed, corpus.chunks)


def index_folder(spark: SparkSession, folder: str, root: str, version: str, ocr=None) -> dict[str, int]:
    """Merge an authorised folder into the index as a new version, and say what was found."""
    if folder.rstrip("/") not in authorised_folders(spark, root):
        raise PermissionError(f"{folder} is not authorised")
    corpus = with_covers(build(spark, folder, ocr, f"{root}/_parsed/{version}", (f"{root}/_ocr", version)))
    made = merge(corpus, root, version)
    done = load(spark, root)
    return {
        "indexed": done.documents.count(),
        "unindexed": done.unindexed.count(),
        "values": done.values.count(),
        "disguised": done.documents.where("declared_format_mismatch is not null").count(),
    } | {k: made.note[k] for k in ("added", "modified", "removed", "unchanged")}


def _note(spark: SparkSession, root: str, folder: str, event: str) -> None:
    spark.createDataFrame([(folder.rstrip("/"), event)], "folder string, event string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_sources")


def authorize(spark: SparkSession, root: str, folder: str) -> None:
    """Allow a folder to be indexed; sources are a log of events, of which the last one counts."""
    _note(spark, root, folder, "authorized")


def revoke(spark: SparkSession, root: str, folder: str) -> None:
    _note(spark, root, folder, "revoked")


def authorised_folders(spark: SparkSession, root: str) -> list[str]:
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.parquet(f"{root}/_sources")
    except AnalysisException:
        return []
    last = log.groupBy("folder").agg(F.max_by("event", "at").alias("event")).where("event = 'authorized'")
    return [r.folder for r in last.orderBy("folder").collect()]


def intact(spark: SparkSession, root: str, version: str | int | None = None) -> bool:
    """All tables can be read, and every value and chunk belongs to a document."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        corpus = load(spark, root, version)
        ids = corpus.documents.select(DOC)
        return not any(t.join(ids, DOC, "left_anti").limit(1).count() for t in (corpus.values, corpus.chunks))
    except (PySparkException, Py4JError):
        return False


def recover(spark: SparkSession, root: str) -> tuple[str | None, list[str]]:
    """The newest intact version, made the current one, and the newer ones that are not."""
    broken: list[str] = []
    newest = snapshots.read(spark, root)
    for number in snapshots.numbers(spark, root):
        found = snapshots.read(spark, root, number)
        if intact(spark, root, number):
            if broken:
                snapshots.commit(spark, root, newest, found.segments, {"name": found.name, "operation": "recover"})
            return found.name, broken
        broken.append(found.name)
    return None, broken


def entities(values: DataFrame) -> DataFrame:
    """Names in text values: two capitalised words or a legal form, at most 14 words; owners by their label."""
    words = F.split("text_value", r"\s+")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}\p{L}+")))
    legal = F.col("text_value").rlike(r"S\.A\.|S\.C\.")
    owner = F.lower("concept").contains("propietari")
    return values.where((F.col("value_type") == "text") & (F.size(words) <= 14) & ((capitals >= 2) | legal)).select("document_id", "concept", F.col("text_value").alias("name"), F.when(owner, "owner").otherwise("mention").alias("relationship_kind"))


def save(corpus: Corpus, root: str, version: str) -> None:
    """Write a whole corpus as a segment; readers see it when ``publish`` names it."""
    values = corpus.values
    if "key" not in values.columns:
        values = concepts.keyed(values.withColumn("label", F.col("concept")))
    values.write.mode("overwrite").parquet(f"{root}/{version}/values")
    for name in ("documents", "unindexed", "chunks"):
        getattr(corpus, name).write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark = values.sparkSession
    concepts.readings(spark.read.parquet(f"{root}/{version}/values")).write.mode("overwrite").parquet(f"{root}/{version}/readings")
    corpus.documents.select(DOC).limit(0).write.mode("overwrite").parquet(f"{root}/{version}/deletes")


def publish(spark: SparkSession, root: str, version: str) -> Snapshot:
    """Make a saved corpus the current version, in one atomic step."""
    return snapshots.commit(spark, root, snapshots.read(spark, root), [version], {"name": version, "operation": "publish"})


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions, the current one first."""
    found = [snapshots.read(spark, root, n).name for n in snapshots.numbers(spark, root)]
    return list(dict.fromkeys(found))


def _snapshot(spark: SparkSession, root: str, version: str | int | None) -> Snapshot:
    for n in snapshots.numbers(spark, root):
        found = snapshots.read(spark, root, n)
        if version is None or version in (n, found.name):
            return found
    raise LookupError(f"no version {version or ''} at {root}")


def load(spark: SparkSession, root: str, version: str | int | None = None) -> Corpus:
    """A version by name or number, the current one by default; fields have the names that the version's readings elect."""
    found = _snapshot(spark, root, version)
    rows = lambda name: snapshots.live(spark, root, found, name)
    values = concepts.encoded(rows("values"), concepts.dictionary(snapshots.table(spark, root, found, "readings")))
    last = Snapshot(found.number, found.segments[-1:])
    return Corpus(rows("documents"), values, snapshots.live(spark, root, last, "unindexed"), rows("chunks"))


def catalogue(spark: SparkSession, root: str, version: str | int | None = None) -> DataFrame:
    """Fields with kind and counts, from the readings alone."""
    return concepts.dictionary(snapshots.table(spark, root, _snapshot(spark, root, version), "readings"))


def _change(spark: SparkSession, root: str, base: Snapshot, segment: str, gone: DataFrame, note: dict) -> Snapshot:
    """Writes the ends of documents and the readings that go with them, then commits the segment, whose own rows are there already."""
    at = f"{root}/{segment}"
    gone.write.mode("overwrite").parquet(f"{at}/deletes")
    ended = spark.read.parquet(f"{at}/deletes")
    lost = concepts.readings(snapshots.live(spark, root, base, "values").join(ended, DOC, "left_semi")).withColumn("n", -F.col("n"))
    concepts.readings(spark.read.parquet(f"{at}/values")).unionByName(lost).write.mode("overwrite").parquet(f"{at}/readings")
    return snapshots.commit(spark, root, base, [*base.segments, segment], note)


def merge(corpus: Corpus, root: str, version: str, removes: bool = True, stream: tuple[str, int] | None = None) -> Snapshot:
    """Bring the index to the state of ``corpus`` as version ``version``, by content hash.

    Files whose hash is unchanged are not written again. With ``removes`` files
    that the corpus lacks go. A batch of a stream that was merged before changes
    nothing. Until the last step, readers see the version before.
    """
    spark = corpus.documents.sparkSession
    base = snapshots.read(spark, root)
    streams = {} if stream is None else {stream[0]: stream[1]}
    if base is None:
        save(corpus, root, version)
        n = spark.read.parquet(f"{root}/{version}/documents").count()
        return snapshots.commit(spark, root, None, [version], {"name": version, "operation": "merge", "added": n, "modified": 0, "removed": 0, "unchanged": 0, "streams": streams})
    if stream is not None and base.note["streams"].get(stream[0], -1) >= stream[1]:
        return base
    if version in base.segments:
        raise ValueError(f"version {version} exists")
    at, old = f"{root}/{version}", snapshots.live(spark, root, base, "documents")
    changed(old, corpus.documents).write.mode("overwrite").parquet(f"{at}/changes")
    states = spark.read.parquet(f"{at}/changes")
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    written = corpus.documents.join(states.where("state in ('added', 'modified')"), "path", "left_semi")
    written.write.mode("overwrite").parquet(f"{at}/documents")
    fresh = spark.read.parquet(f"{at}/documents").select(DOC)
    values = corpus.values if "key" in corpus.values.columns else concepts.keyed(corpus.values.withColumn("label", F.col("concept")))
    for name, rows in (("values", values), ("chunks", corpus.chunks)):
        rows.join(fresh, DOC, "left_semi").write.mode("overwrite").parquet(f"{at}/{name}")
    unread = corpus.unindexed
    if not removes:
        unread = unread.unionByName(snapshots.live(spark, root, Snapshot(0, base.segments[-1:]), "unindexed").join(unread.select("path"), "path", "left_anti"))
    unread.write.mode("overwrite").parquet(f"{at}/unindexed")
    gone = old.join(states.where(F.col("state").isin("modified", *["removed"] * removes)), "path", "left_semi").select(DOC)
    if not removes:
        counts["unchanged"], counts["removed"] = counts.get("unchanged", 0) + counts.get("removed", 0), 0
    note = {"name": version, "operation": "merge", "streams": streams} | {k: counts.get(k, 0) for k in ("added", "modified", "removed", "unchanged")}
    return _change(spark, root, base, version, gone, note)


def purge_origin(spark: SparkSession, root: str, origin: str, version: str) -> Snapshot:
    """Remove one folder's documents: nothing is rewritten, and fields without values go with their last reading."""
    base = _snapshot(spark, root, None)
    for name in ("documents", "values", "chunks"):
        snapshots.table(spark, root, base, name).drop("__segment").limit(0).write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    unread = snapshots.live(spark, root, Snapshot(0, base.segments[-1:]), "unindexed")
    unread.where(~F.col("origin").eqNullSafe(origin)).write.mode("overwrite").parquet(f"{root}/{version}/unindexed")
    gone = snapshots.live(spark, root, base, "documents").where(F.col("origin") == origin).select(DOC)
    return _change(spark, root, base, version, gone, {"name": version, "operation": "purge"})


def compact(spark: SparkSession, root: str, version: str) -> Snapshot:
    """One segment of the rows that are live, in place of all segments; older versions can still be read until ``vacuum``."""
    base = _snapshot(spark, root, None)
    for name in ("documents", "values", "chunks"):
        snapshots.live(spark, root, base, name).write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    snapshots.live(spark, root, Snapshot(0, base.segments[-1:]), "unindexed").write.mode("overwrite").parquet(f"{root}/{version}/unindexed")
    snapshots.table(spark, root, base, "deletes").drop("__segment").limit(0).write.mode("overwrite").parquet(f"{root}/{version}/deletes")
    counts = snapshots.table(spark, root, base, "readings").groupBy("key", "label", "value_type", "reliable").agg(F.sum("n").alias("n"))
    counts.where("n <> 0").write.mode("overwrite").parquet(f"{root}/{version}/readings")
    return snapshots.commit(spark, root, base, [version], {"name": version, "operation": "compact"})


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, modified, removed and unchanged files of a new run, by content hash."""
    a, b = old.select("path", F.col("content_hash").alias("before")), new.select("path", F.col("content_hash").alias("after"))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def purge(corpus: Corpus, origin: str) -> Corpus:
    """Without one folder; fields that no document has any more go with it."""
    gone = corpus.documents.where(F.col("origin") == origin).select("document_id")
    without = lambda df: df.join(gone, "document_id", "left_anti")
    return Corpus(without(corpus.documents), without(corpus.values), corpus.unindexed.where(F.col("origin") != origin), without(corpus.chunks))
