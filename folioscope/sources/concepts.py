"""Fields and their spellings: a dictionary of concepts by canonical key.

``readings`` (key, label, value_type, reliable, n) counts how labels were read;
counts of separate batches add up, and those of removed documents are negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key_of, exactly
from ..operators.aggregate import kind_rank

#: What an alias needs not be for a lookup to follow it.
REJECTED = "rejected"


def keyed(values: DataFrame, label: str = "label") -> DataFrame:
    """Values with the key of their label, which is found once for each different label: these are few, as fields are."""
    keys = values.select(F.col(label).alias("__label")).distinct().select("__label", canonical_key_of("__label").alias("__key"))
    found = values.join(F.broadcast(keys), F.col(label) == F.col("__label"), "left")
    return found.withColumn("key", F.col("__key")).drop("__label", "__key")


def readings(values: DataFrame) -> DataFrame:
    """Of values with key, label, value_type and reliable."""
    return values.groupBy("key", "label", "value_type", "reliable").agg(F.count("*").alias("n"))


def dictionary(counts: DataFrame) -> DataFrame:
    """(concept_id, key, concept, kind, n_values, n_labels): each field that has values left.

    The name shown is the label read most often where reading is reliable; a
    doubtful reading names a field only if there is no other. The kind is that
    of most values, ties by the fixed order of kinds; so both depend on what the
    collection holds, not on the order in which it was read.
    """
    each = counts.groupBy("key", "label", "value_type", "reliable").agg(F.sum("n").alias("n")).where("n > 0")
    labels = each.groupBy("key", "label").agg(F.sum(F.when(F.col("reliable"), F.col("n")).otherwise(0)).alias("sure"), F.sum("n").alias("n"))
    names = labels.groupBy("key").agg(F.min_by("label", F.struct(-F.col("sure"), -F.col("n"), "label")).alias("concept"), F.count("*").alias("n_labels"))
    votes = each.groupBy("key", "value_type").agg(F.sum("n").alias("n"))
    kinds = votes.groupBy("key").agg(F.sum("n").alias("n_values"), F.min_by("value_type", F.struct(-F.col("n"), kind_rank(F.col("value_type")))).alias("kind"))
    return names.join(kinds, "key").select(F.xxhash64("key").alias("concept_id"), "key", "concept", "kind", "n_values", "n_labels")


def encoded(values: DataFrame, concepts: DataFrame) -> DataFrame:
    """Values with the id and the name of their field, in place of the label that they had."""
    return values.drop("concept").join(concepts.select("key", "concept_id", "concept"), "key")


def aliases(pairs: DataFrame) -> DataFrame:
    """(alias, key, status) of pairs (label, other, status): other names of the field with this label."""
    return pairs.select(exactly("other").alias("alias"), canonical_key_of("label").alias("key"), "status")


def lookup(asked: DataFrame, concepts: DataFrame, known: DataFrame) -> DataFrame:
    """Each asked name with the field that it means: by its own key, else by an alias that is not rejected, the smallest key first."""
    names = asked.select("name").distinct().select("name", canonical_key_of("name").alias("own"), exactly("name").alias("alias"))
    own = names.join(concepts.select("key"), F.col("own") == F.col("key"), "left_semi").select("name", F.col("own").alias("key"), F.lit(0).alias("way"))
    usable = known.where(F.col("status") != REJECTED).select("alias", "key").join(concepts.select("key"), "key", "left_semi")
    other = names.join(usable, "alias").select("name", "key", F.lit(1).alias("way"))
    first = own.unionByName(other).groupBy("name").agg(F.min_by("key", F.struct("way", "key")).alias("key"))
    return first.join(concepts, "key")
