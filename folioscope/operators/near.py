"""Values within a few edits of others, by an equi-join instead of comparing all.

Two texts at most ``most`` edits apart share a key. Short texts: both without
some ``most`` letters are equal, so the keys are hashes of a text with up to so
many letters deleted. Long ones, whose deletions would be too many: of
``most`` + 1 pieces of one text, one stands unchanged in the other, moved by at
most ``most`` places. A pair is compared exactly once, whatever keys it shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters up to which a text has deletions as keys.
SHORT = 24


def _without(text: Column, at: Column) -> Column:
    """The text without the letter at this place; a place of 0 leaves it whole."""
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))).otherwise(text)


def _piece(length: Column, number: Column, most: int, asking: bool) -> tuple[Column, Column, Column, Column]:
    """Of the piece with this number: the length of the text it is cut for, its place there, where it begins here and its size."""
    n, i, moved = length, number, F.lit(0)
    if asking:
        wide = 2 * most + 1
        i, moved = number % (most + 1), F.floor(number / (most + 1)).cast("int") % wide - most
        n = length + F.floor(number / ((most + 1) * wide)).cast("int") - most
    cut = lambda k: F.floor(n * k / (most + 1)).cast("int")
    return n, i, cut(i) + 1 + moved, cut(i + 1) - cut(i)


def keyed(texts: DataFrame, name: str, most: int, asking: bool) -> DataFrame:
    """Rows with a known text, or with one that asks for its neighbours, once for each ``__key`` of it; none for null.

    Keys are numbered and each is found from its number in a row of its own, so
    that no text's keys are held as an array: places of a deleted letter from 1,
    0 for none, pieces below. Of equal letters in a row only the last goes first.
    """
    text, length, at = F.col(name), F.length(name), F.col("__at1")
    pieces = (most + 1) * (2 * most + 1) ** 2 if asking else most + 1
    first = F.when(length > SHORT, F.lit(-pieces)).otherwise(0)
    last = F.when(length <= SHORT + most, length).when(length > SHORT + most, F.lit(-1))
    n, i, begin, size = _piece(length, -at - 1, most, asking)
    other = F.substring(text, at, F.lit(1)) != F.substring(text, at + 1, F.lit(1))
    inside = (begin >= 1) & (begin + size - 1 <= length)
    rows = texts.select("*", F.explode(F.sequence(first, last)).alias("__at1")).where(F.when(at > 0, other).when(at < 0, inside).otherwise(True))
    rest = _without(text, at)
    for k in range(2, most + 1):
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col(f"__at{k - 1}") - 1, F.lit(0)))).alias(f"__at{k}"))
        rest = _without(rest, F.col(f"__at{k}"))
    key = F.when(at >= 0, F.xxhash64(F.lit("deletion"), rest)).otherwise(F.xxhash64(F.lit("piece"), n, i, F.substring(text, begin, size)))
    return rows.select(*texts.columns, key.alias("__key"))


def near(asked: DataFrame, known: DataFrame, by: list[str], most: int = 1, hint: str = "shuffle_hash") -> DataFrame:
    """Each ``asked`` text with the texts of ``known`` that agree in the columns ``by`` and are at most so many edits away.

    Both have ``text``; the result has ``asked``, ``text`` and ``distance``, a
    pair once. Nulls have no neighbours; equal texts are at distance 0. Known
    keys pass by the asked ones of their partition, which it holds in memory.
    """
    left = keyed(asked.select(*by, F.col("text").alias("asked")).distinct(), "asked", most, True)
    right = keyed(known.select(*by, "text").distinct(), "text", most, False)
    pairs = left.hint(hint).join(right, ["__key", *by]).select(*by, "asked", "text").distinct()
    return pairs.withColumn("distance", F.levenshtein("asked", "text", most)).where(F.col("distance") >= 0)


def spelling_variants(values: DataFrame, most: int = 1) -> DataFrame:
    """(concept, variant, literal_value): values of every field that were only read with doubt, and the nearest sure one of the field; ties go to the more frequent, then the smaller."""
    seen = values.groupBy("concept", "literal_value").agg(F.bool_or("reliable").alias("sure"), F.count("*").alias("n"))
    odd = seen.where("not sure").select("concept", F.col("literal_value").alias("text"))
    sure = seen.where("sure").select("concept", F.col("literal_value").alias("text"), "n")
    pairs = near(odd, sure, ["concept"], most).join(sure, ["concept", "text"])
    best = F.min_by("text", F.struct("distance", -F.col("n"), "text"))
    return pairs.groupBy("concept", F.col("asked").alias("variant")).agg(best.alias("literal_value"))


def respelled(values: DataFrame, most: int = 1) -> DataFrame:
    """Values with ``literal_value`` as the sure value that a doubtful reading stands for."""
    variants = spelling_variants(values, most).select("concept", F.col("variant").alias("__own"), F.col("literal_value").alias("__sure"))
    joined = values.withColumnRenamed("literal_value", "__own").join(variants, ["concept", "__own"], "left")
    return joined.withColumn("literal_value", F.coalesce("__sure", "__own")).select(*values.columns)
