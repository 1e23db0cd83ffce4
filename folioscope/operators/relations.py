"""Groups, periods, shared keys, duplicates and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_of, kind_of_path
from ..functions.values import exact_ratio
from ..sources.places import delete, settings, work_dir
from .aggregate import DOC, compute

#: Rounds in which documents and keys are dealt out where all of them are; each shuffles its share.
ROUNDS = 3
#: Documents above which a key's are dealt out by value.
HOT = 4096
#: While rounds are written: a shuffle's files go when its write is complete, tasks are small, and rows that were sorted once are not sorted again.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.execution.useObjectHashAggregateExec": "false"}


def rank(rows: DataFrame, group: str, op: str = "sum", descending: bool = True) -> DataFrame:
    """Groups by their value, ties by name."""
    out = compute(rows, op, [group])
    return out.orderBy(F.desc("value") if descending else F.asc("value"), group)


def changes(table: DataFrame) -> DataFrame:
    """difference and percent of ``left_value`` and ``right_value``; no percent of a zero base."""
    left, right = F.col("left_value"), F.col("right_value")
    return table.withColumns({"difference": (right - left).cast("decimal(38,4)"), "percent": exact_ratio((right - left).cast("decimal(24,4)"), left.cast("decimal(24,4)"), 100)})


def compare(left: DataFrame, right: DataFrame, op: str = "sum") -> DataFrame:
    """Two sets of operands, currency by currency."""
    a = compute(left, op).select(F.col("currency").alias("lc"), F.col("value").alias("left_value"))
    b = compute(right, op).select(F.col("currency").alias("rc"), F.col("value").alias("right_value"))
    both = a.join(b, F.col("lc").eqNullSafe(F.col("rc")), "full").select(F.coalesce("lc", "rc").alias("currency"), "left_value", "right_value")
    return changes(both)


def compare_periods(values: DataFrame, concept: str, by: str, period, op: str = "sum") -> DataFrame:
    """The period before (left) and the period (right), by the document's date; every currency."""
    before = period.previous()

    def rows(p):
        inside = values.where((F.col("concept") == by) & F.col("date_value").between(p.first, p.last)).select(DOC)
        return values.where(F.col("concept") == concept).join(inside, DOC, "left_semi")

    return compare(rows(before), rows(period), op)


def compare_documents(values: DataFrame, concept: str, first: int, second: int) -> DataFrame:
    """One field in two documents: what each says, how many values, and whether they agree."""
    own = values.where((F.col("concept") == concept) & F.col(DOC).isin(first, second))
    side = lambda d: F.array_sort(F.collect_set(F.when(F.col(DOC) == d, F.col("literal_value"))))
    both = own.agg(side(first).alias("a"), side(second).alias("b"))
    reason = F.when((F.size("a") == 0) | (F.size("b") == 0), "campo_ausente_en_un_documento").when((F.size("a") > 1) | (F.size("b") > 1), "campo_multiple_en_documento").when(F.col("a") != F.col("b"), "valores_discrepantes").otherwise("coinciden")
    return both.select(F.array_join("a", "; ").alias("first"), F.array_join("b", "; ").alias("second"), reason.alias("outcome"))


def stable_key(values: DataFrame, concept: str) -> DataFrame:
    """Documents by the canonical form of an identifier field."""
    return values.where(F.col("concept") == concept).select(DOC, identifier_of("text_value").alias("key")).where("key is not null").distinct()


def sharing(values: DataFrame, concept: str) -> DataFrame:
    """Keys that several documents share; the documents themselves are joined back, not gathered."""
    keys = stable_key(values, concept)
    counts = keys.groupBy("key").agg(F.count("*").alias("n_documents")).where("n_documents > 1")
    return keys.join(counts, "key")


def singletons(values: DataFrame, concept: str) -> DataFrame:
    """The value of a field in documents where it has just one."""
    return values.where(F.col("concept") == concept).groupBy(DOC).agg(F.min("literal_value").alias("value"), F.max("literal_value").alias("__last"), F.bool_and("reliable").alias("reliable")).where("value = __last").drop("__last")


def contradictions(values: DataFrame, key: str, concept: str) -> DataFrame:
    """Shared keys whose documents state different values of the field."""
    rows = sharing(values, key).join(singletons(values, concept), DOC)
    return rows.groupBy("key").agg(F.count_distinct("value").alias("n_values"), F.count(DOC).alias("n_documents"), F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and("reliable").alias("reliable")).where("n_values >= 2")


def dossier(values: DataFrame, key_concept: str, key: str, concepts: list[str]) -> DataFrame:
    """For one key, each field: documents that state it, how many values, conflicts and gaps."""
    own = stable_key(values, key_concept).where(F.col("key") == key).select(DOC)
    n = own.agg(F.count("*").alias("n_linked"))
    stated = values.where(F.col("concept").isin(*concepts)).join(own, DOC, "left_semi").groupBy("concept").agg(F.count_distinct(DOC).alias("n_documents"), F.count_distinct("literal_value").alias("n_values"))
    grid = values.sparkSession.createDataFrame([(c,) for c in concepts], "concept string")
    filled = grid.join(stated, "concept", "left").crossJoin(F.broadcast(n))
    return filled.select("concept", F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"), F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"), (F.col("n_linked") - F.coalesce("n_documents", F.lit(0))).alias("n_gaps"), (F.coalesce("n_values", F.lit(0)) > 1).alias("conflict"))


def keyed_documents(values: DataFrame) -> DataFrame:
    """(key_field, key, document_id): every identifier that any field states, each once."""
    keys = values.select(F.col("concept").alias("key_field"), identifier_of("text_value").alias("key"), DOC)
    return keys.where("key is not null").distinct()


def stated_fields(values: DataFrame) -> DataFrame:
    """(document_id, concept, value, reliable): each field of each document; value is null where it has several."""
    each = values.groupBy(DOC, "concept").agg(F.min("literal_value").alias("low"), F.max("literal_value").alias("high"), F.bool_and("reliable").alias("reliable"))
    return each.select(DOC, "concept", F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"), "reliable")


def _linked(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of keys that several share, and how many share each; the values are read for it once."""
    spark, at = values.sparkSession, work_dir(values.sparkSession, "keys")
    keyed_documents(values).write.parquet(at)
    keys = spark.read.parquet(at)
    shared = keys.groupBy("key_field", "key").agg(F.count("*").alias("n_linked")).where("n_linked > 1")
    return keys.join(shared.drop("n_linked"), ["key_field", "key"], "left_semi"), shared


def _by_value(values: DataFrame, linked: DataFrame) -> DataFrame:
    """Linked documents counted by key, field and value: a hot key is dealt out by the values of its documents before it comes together."""
    return linked.join(stated_fields(values), DOC).groupBy("key_field", "key", "concept", "value").agg(F.count("*").alias("n"), F.bool_and("reliable").alias("reliable"))


def all_contradictions(values: DataFrame) -> DataFrame:
    """Every key of every identifier field, and every field in which documents that share it state different single values."""
    each = _by_value(values, _linked(values)[0]).where(F.col("value").isNotNull() & (F.col("concept") != F.col("key_field")))
    out = each.groupBy("key_field", "key", "concept").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_documents"), F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and("reliable").alias("reliable"))
    return out.where("n_values >= 2")


def _merged(fields: Column) -> Column:
    """Fields of a document of which some stand there in parts, one for each identifier they state."""

    def one(name: Column) -> Column:
        own = F.filter(fields, lambda f: f["concept"] == name)
        said = F.array_compact(F.array_distinct(F.transform(own, lambda f: f["value"])))
        several = F.exists(own, lambda f: f["several"]) | (F.size(said) > 1)
        return F.struct(name.alias("concept"), F.when(~several, F.get(said, F.lit(0))).alias("value"), F.forall(own, lambda f: f["reliable"]).alias("reliable"), several.alias("several"))

    names = F.array_distinct(fields["concept"])
    return F.when(F.size(names) < F.size(fields), F.transform(names, one)).otherwise(fields)


def _write_documents(values: DataFrame, at: str) -> None:
    """One row a document: ``fields``, what each says of it as ``stated_fields`` has it, and ``keys``, the identifiers that its fields state."""
    facts = values.select(DOC, "concept", "literal_value", "reliable", identifier_of("text_value").alias("key"))
    alike = F.col("low") == F.col("high")
    field = F.struct("concept", "value", "reliable", "several")
    key = F.when(F.col("key").isNotNull(), F.struct(F.col("concept").alias("key_field"), "key"))
    for number in range(ROUNDS):
        own = facts.where(F.pmod(F.xxhash64(DOC), F.lit(ROUNDS)) == number)
        # Counted by field before the document's rows come together, so that a document of very many rows is no one task's.
        each = own.groupBy(DOC, "concept", "key").agg(F.min("literal_value").alias("low"), F.max("literal_value").alias("high"), F.bool_and("reliable").alias("reliable"))
        each = each.select(DOC, "concept", "key", F.when(alike, F.col("low")).alias("value"), "reliable", F.coalesce(~alike, F.lit(False)).alias("several"))
        docs = each.repartition(DOC).groupBy(DOC).agg(F.collect_list(field).alias("fields"), F.collect_list(key).alias("keys"))
        # In one order, since documents that look alike take less room.
        docs.select(F.sort_array(_merged(F.col("fields"))).alias("fields"), "keys").write.mode("append").parquet(at)


def _dossiers(keyed: DataFrame, concepts: Column) -> DataFrame:
    """Dossiers of keys from their documents' fields, without those of one document only. A document that has a key of a field states that field."""
    by = ["mark", "key_field", "key"]
    each = keyed.select(*by, F.inline("fields")).groupBy(*by, "concept", "value").agg(F.count("*").alias("n"), F.bool_and("reliable").alias("reliable"))
    cells = each.groupBy(*by, "concept").agg(F.sum("n").alias("n_documents"), F.count("value").alias("n_values"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_several"), F.bool_and("reliable").alias("reliable"))
    stated = F.collect_list(F.struct("concept", "n_documents", "n_values", "n_several", "reliable")).alias("stated")
    whole = cells.groupBy(*by).agg(F.max(F.when(F.col("concept") == F.col("key_field"), F.col("n_documents"))).alias("n_linked"), stated).where("n_linked > 1")
    zero = F.lit(0).cast("long")
    gaps = F.transform(F.array_except(concepts, F.col("stated.concept")), lambda c: F.struct(c.alias("concept"), zero.alias("n_documents"), zero.alias("n_values"), zero.alias("n_several"), F.lit(True).alias("reliable")))
    rows = whole.select("key_field", "key", "n_linked", F.inline(F.concat("stated", gaps)))
    return rows.select("key_field", "key", "concept", "n_linked", "n_documents", "n_values", "n_several", (F.col("n_linked") - F.col("n_documents")).alias("n_gaps"), (F.col("n_values") > 1).alias("conflict"), "reliable")


def all_dossiers(values: DataFrame) -> DataFrame:
    """For every shared key, every field of the collection: documents that state it, different single values, conflicts and gaps.

    The documents, then the keys are dealt out in rounds, each written before the
    next one begins. Documents meet at a shared key as rows of all their fields;
    those of a hot key are counted by value before. Marks of keys only say which
    keys may be shared or hot; keys themselves are what is grouped.
    """
    spark = values.sparkSession
    at, marks_at, out = (work_dir(spark, f"dossiers-{x}") for x in ("documents", "marks", "result"))
    try:
        with settings(spark, WRITING):
            _write_documents(values, at)
            docs = spark.read.parquet(at)
            names = docs.select(F.explode("fields.concept").alias("concept")).distinct().orderBy("concept").collect()
            concepts = F.array(*[F.lit(r.concept) for r in names]).cast("array<string>")
            keyed = docs.select(F.explode("keys").alias("k"), "fields").select(F.xxhash64("k.key_field", "k.key").alias("mark"), "k.key_field", "k.key", "fields")
            keyed.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").write.parquet(marks_at)
            marks = spark.read.parquet(marks_at)
            hot = F.broadcast(marks.where(F.col("n") > HOT).select("mark"))
            some = not marks.where(F.col("n") > HOT).isEmpty()
            for number in range(ROUNDS):
                own, shared = (x.where(F.pmod("mark", F.lit(ROUNDS)) == number) for x in (keyed, marks.select("mark")))
                cold = own.join(hot, "mark", "left_anti") if some else own
                found = _dossiers(cold.repartition("mark").join(shared.hint("shuffle_hash"), "mark", "left_semi"), concepts)
                if some:
                    found = found.unionByName(_dossiers(own.join(hot, "mark", "left_semi"), concepts))
                found.write.mode("append").parquet(out)
    finally:
        delete(spark, at)
        delete(spark, marks_at)
    return spark.read.parquet(out)


def identifier_candidates(values: DataFrame, concept: str, wanted: str, most: int = 6) -> DataFrame:
    """The key itself if it exists, else the first ones that begin so."""
    from ..functions.text import identifier

    key = identifier(wanted) or ""
    keys = stable_key(values, concept).select("key").distinct()
    same = keys.where(F.col("key") == key)
    near = keys.where(F.col("key").startswith(key) & (F.col("key") != key)).orderBy("key").limit(most)
    none = same.agg((F.count("*") == 0).alias("none"))
    return same.unionByName(near.crossJoin(F.broadcast(none)).where("none").select("key"))


def mentions(values: DataFrame, key_concept: str, literal: Column, most: int = 20) -> DataFrame:
    """Documents that state the literal but have no key: links that are never verified."""
    keyed = stable_key(values, key_concept).select(DOC)
    return values.where(literal).select(DOC).distinct().join(keyed, DOC, "left_anti").orderBy(DOC).limit(most)


def duplicates(documents: DataFrame) -> DataFrame:
    """Documents with the same content: one row a hash."""
    return documents.groupBy("content_hash").agg(F.count("*").alias("n_documents"), F.min(DOC).alias("first")).where("n_documents > 1")


def duplicates_of(documents: DataFrame, document_id: int) -> DataFrame:
    own = documents.where(F.col(DOC) == document_id).select("content_hash")
    return documents.join(own, "content_hash", "left_semi").where(F.col(DOC) != document_id).select(DOC)


def census(documents: DataFrame, unindexed: DataFrame, by: list[str]) -> DataFrame:
    """Discovered, indexed and unread files by origin and/or kind of file."""
    have = documents.select("path", "origin", F.lit(1).alias("indexed")).unionByName(unindexed.select("path", "origin", F.lit(0).alias("indexed")))
    have = have.withColumn("kind", F.coalesce(kind_of_path("path"), F.lit("sin tipo")))
    return have.groupBy(*by).agg(F.count("*").alias("discovered"), F.sum("indexed").alias("indexed"), F.count_if(F.expr("indexed = 0")).alias("unindexed"))


def by_format(documents: DataFrame, unindexed: DataFrame) -> DataFrame:
    """Documents by extension: with a text layer, read by OCR, and unread ones beside."""
    scanned = F.col("ocr_status") != "not_required"
    read = documents.groupBy("extension").agg(F.count("*").alias("n_documents"), F.count_if(scanned).alias("n_scanned"), F.count_if(~scanned).alias("n_text"))
    lost = unindexed.groupBy("extension").agg(F.count("*").alias("n_unindexed"))
    zero = F.lit(0).cast("long")
    return read.join(lost, "extension", "full").select("extension", *[F.coalesce(c, zero).alias(c) for c in ("n_documents", "n_scanned", "n_text", "n_unindexed")])


def inventory(documents: DataFrame) -> DataFrame:
    return documents.groupBy("origin").agg(F.count("*").alias("n_documents"), F.min(DOC).alias("first"))


def names_folder(documents: DataFrame, values: DataFrame, concept: str) -> DataFrame:
    """Values that stand for a folder: all their documents are there, and all of it has them."""
    pairs = values.where(F.col("concept") == concept).select(DOC, "literal_value").distinct().join(documents.select(DOC, "origin"), DOC)
    of_value = pairs.groupBy("literal_value").agg(F.count_distinct(DOC).alias("n_value"), F.count_distinct("origin").alias("n_origins"), F.min("origin").alias("origin"))
    of_folder = documents.groupBy("origin").agg(F.count("*").alias("n_folder"))
    joined = of_value.join(of_folder, "origin")
    return joined.select("literal_value", "origin", "n_value", "n_folder", ((F.col("n_origins") == 1) & (F.col("n_value") == F.col("n_folder"))).alias("equivalent"))


def with_counts(left: DataFrame, right: DataFrame, on: str, group: str, what: str) -> DataFrame:
    """Groups of the left side with how many of the right side they have, none included; counted before the join."""
    counts = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(what).alias("__n"))
    return left.join(counts, on, "left").groupBy(group).agg(F.coalesce(F.sum("__n"), F.lit(0).cast("long")).alias("n"))


def copies_of_each(documents: DataFrame) -> DataFrame:
    """Documents whose content others have too, with how many have it; the counts are joined, not gathered."""
    return documents.join(duplicates(documents).select("content_hash", F.col("n_documents").alias("n")), "content_hash").select(DOC, "n")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each table has."""
    from functools import reduce

    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, t in tables.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in tables])


def related(values: DataFrame, key: str, document_id: int, most: int = 12) -> DataFrame:
    """The first documents that share a key with this one."""
    keys = stable_key(values, key)
    own = keys.where(F.col(DOC) == document_id).select("key")
    return keys.join(own, "key", "left_semi").where(F.col(DOC) != document_id).select(DOC).distinct().orderBy(DOC).limit(most)


def unreliable(documents: DataFrame) -> DataFrame:
    """Documents read with doubt: by OCR of low or unknown confidence, or of another format than their extension says."""
    doubt = ~F.col("ocr_status").isin("not_required", "complete") | (F.col("ocr_confidence") < 0.55)
    disguised = F.col("declared_format_mismatch").isNotNull() if "declared_format_mismatch" in documents.columns else F.lit(False)
    reason = F.when(disguised, "extension_enganosa").when(doubt, "lectura_dudosa")
    return documents.select(DOC, reason.alias("reason")).where("reason is not null")
