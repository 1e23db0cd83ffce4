"""Which documents a question is about."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact, fold, identifier, identifier_of
from ..functions.values import filter_key
from .near import near
from .phrases import mentioned

DOC = "document_id"


def having(documents: DataFrame, values: DataFrame, condition: Column) -> DataFrame:
    """Documents with a value that meets the condition: a semi join, driven by the matching values."""
    return documents.join(values.where(condition).select(DOC), DOC, "left_semi")


def equals(concept: str, value: str, kind: str | None = None) -> Column:
    """The field has this value; numbers and percentages compare by kind and number."""
    of = F.col("concept") == concept
    if kind is None:
        return of & (F.col("literal_value") == fold(value))
    return of & (filter_key(F.col("value_type"), F.col("text_value")) == filter_key(F.lit(kind), F.lit(value)))


def meeting_all(values: DataFrame, conditions: list[Column]) -> DataFrame:
    """Documents that meet each condition by some value: one pass over the values, not a join a condition."""
    if len(conditions) == 1:
        return values.where(conditions[0]).select(DOC)
    found = values.where(reduce(Column.__or__, conditions)).groupBy(DOC).agg(*[F.max(c.cast("int")).alias(f"__c{i}") for i, c in enumerate(conditions)])
    return found.where(reduce(Column.__and__, [F.col(f"__c{i}") == 1 for i in range(len(conditions))])).select(DOC)


def with_filters(documents: DataFrame, values: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    if not filters:
        return documents
    return documents.join(meeting_all(values, [equals(c, v) for c, v in filters]), DOC, "left_semi")


def from_origin(documents: DataFrame, origin: str) -> DataFrame:
    return documents.where(F.col("origin") == origin)


def dated(documents: DataFrame, values: DataFrame, concept: str, first: date, last: date) -> DataFrame:
    """Both bounds hold for the same value of one field."""
    return having(documents, values, (F.col("concept") == concept) & F.col("date_value").between(first, last))


def dated_anywhere(documents: DataFrame, values: DataFrame, first: date | None, last: date | None) -> DataFrame:
    """Each bound holds for some date of the document, not necessarily the same."""
    if first is not None:
        documents = having(documents, values, F.col("date_value") >= F.lit(first))
    if last is not None:
        documents = having(documents, values, F.col("date_value") <= F.lit(last))
    return documents


def resolve(documents: DataFrame, values: DataFrame, filters=(), origin: str | None = None, dates: tuple[str, date, date] | None = None) -> DataFrame:
    """Ids of the documents in scope, in order."""
    conditions = [equals(c, v) for c, v in filters]
    if dates is not None:
        concept, first, last = dates
        conditions.append((F.col("concept") == concept) & F.col("date_value").between(first, last))
    found = documents if origin is None else from_origin(documents, origin)
    if conditions:
        found = found.join(meeting_all(values, conditions), DOC, "left_semi")
    return found.select(DOC).orderBy(DOC)


def satisfies(documents: DataFrame, values: DataFrame, document_id: int, filters: list[tuple[str, str]]) -> DataFrame:
    """One row: does this document meet all filters?"""
    one = with_filters(documents.where(F.col(DOC) == document_id), values.where(F.col(DOC) == document_id), filters)
    return one.agg((F.count("*") > 0).alias("satisfies"))


def in_currency(values: DataFrame, currency: str) -> DataFrame:
    return values.where(F.upper("currency") == currency.upper())


def by_identifier(values: DataFrame, wanted: str, mode: str = "exact") -> DataFrame:
    """Documents whose fields hold the identifier; best score of each."""
    key = identifier(wanted)
    if key is None:
        return values.where("false").select(DOC, F.lit(0).alias("score"))
    own = identifier_of("text_value")
    hit = {"exact": own == key, "prefix": own.startswith(key), "contains": own.contains(key)}[mode]
    return values.where(hit).groupBy(DOC).agg(F.max(F.when(own == key, 140).otherwise(130)).alias("score"))


def by_path(documents: DataFrame, suffix: str) -> DataFrame:
    """Documents whose path ends so, at a folder boundary."""
    return documents.where((F.col("path") == suffix) | F.col("path").endswith(f"/{suffix}"))


def by_hash(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose content has one of the hashes of ``wanted`` (content_hash)."""
    return documents.join(wanted.select("content_hash"), "content_hash", "left_semi")


def members_stating(members: DataFrame, values: DataFrame, concept: str) -> DataFrame:
    """Of these documents those that state the field at all; their records are one row before they meet."""
    return members.join(values.where(F.col("concept") == concept).select(DOC).distinct(), DOC, "left_semi")


def mentioned_values(values: DataFrame, question: str, most_words: int = 8) -> DataFrame:
    """Text and state values of few words that the question spells out as a phrase."""
    asked = values.sparkSession.createDataFrame([(0, question)], "question_id int, text string")
    return mentioned(asked, values, most_words).select("concept", "literal_value").distinct()


def near_values(values: DataFrame, concept: str, wanted: str, most: int = 6) -> DataFrame:
    """Values of the field closest to one that does not exist: from those within two edits, if there are enough, else from all."""
    known = values.where(F.col("concept") == concept).select("text_value", "literal_value").distinct()
    asked = values.sparkSession.createDataFrame([(fold(wanted),)], "text string")
    close = near(asked, known.select(F.col("literal_value").alias("text")), [], 2, "broadcast")
    found = known.join(close.select(F.col("text").alias("literal_value"), "distance"), "literal_value").select("text_value", "literal_value", "distance")
    if found.limit(most).count() < most:
        found = known.withColumn("distance", F.levenshtein("literal_value", F.lit(fold(wanted))))
    return found.orderBy("distance", "literal_value", "text_value").limit(most)


def reliable_ocr(status: Column, confidence: Column) -> Column:
    return status.isin("not_required", "complete") & F.coalesce(confidence >= 0.55, F.lit(True))


def authorised(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of sources that are not revoked."""
    return documents.join(sources.where("revoked_at is null").select("source_id"), "source_id", "left_semi")


def pinned(values: DataFrame, anchors: list[str], most: int = 120) -> DataFrame:
    """The one document that covers most of the different anchor phrases: 1001 a phrase plus how specific it is; none on a tie."""
    literal, anchors = F.col("literal_value"), list(dict.fromkeys(map(fold, anchors)))
    hits = reduce(DataFrame.unionByName, [values.where(literal.contains(a)).select(DOC, F.lit(i).alias("anchor"), F.lit(len(a.split())).alias("words")).distinct() for i, a in enumerate(anchors)])
    scored = hits.groupBy(DOC).agg((F.count("*") * 1001 + F.sum("words")).alias("score"))
    best = scored.orderBy(F.desc("score"), DOC).limit(most)
    top = best.agg(F.max("score").alias("score"))
    winners = best.join(F.broadcast(top), "score")
    return winners.join(winners.groupBy("score").agg(F.count("*").alias("n")).where("n = 1").select("score"), "score", "left_semi").select(DOC, "score")


def by_currency(values: DataFrame, currency: str) -> tuple[DataFrame, DataFrame]:
    """Values in the currency, and the documents that have the field in others only."""
    kept = in_currency(values, currency)
    return kept, values.select(DOC).distinct().join(kept.select(DOC), DOC, "left_anti")


def without(documents: DataFrame, values: DataFrame, condition: Column) -> DataFrame:
    """Documents without any value that meets the condition."""
    return documents.join(values.where(condition).select(DOC), DOC, "left_anti")


def flagged(documents: DataFrame, values: DataFrame, condition: Column, name: str) -> DataFrame:
    """All documents, and whether one of their values meets the condition."""
    found = values.where(condition).select(DOC).distinct().withColumn("__flag", F.lit(True))
    return documents.join(found, DOC, "left").withColumn(name, F.col("__flag").isNotNull()).drop("__flag")


def substantive(values: DataFrame) -> DataFrame:
    """Values that say something: numbers, and what doesn't stand in a file's metadata."""
    return values.where(F.col("numeric").isNotNull() | ~F.col("location").like("metadato:%"))


def projection(values: DataFrame, document_id: int, concepts: list[str]) -> DataFrame:
    """Some fields of one document, in its order."""
    return values.where((F.col(DOC) == document_id) & F.col("concept").isin(*concepts)).orderBy("ordinal").select("concept", "text_value")


def usual_fields(values: DataFrame, literal: str) -> DataFrame:
    """Fields in which documents state the literal, by how many; the first is what the value means when no field is named."""
    return values.where(F.col("literal_value") == fold(literal)).groupBy("concept").agg(F.count_distinct(DOC).alias("n_documents")).orderBy(F.desc("n_documents"), "concept")
