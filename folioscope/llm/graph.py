"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the component's smallest node.

    Alternates the large-star and small-star steps of the published algorithm:
    every node's larger neighbours, then its smaller ones, are linked to its
    smallest. Neighbour lists are never gathered; a node of many edges is only
    a hot join key. Ends when a round changes nothing: then all are stars.
    Self-loops and nulls are dropped; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    pairs = materialise(pairs, name)
    seen = None
    while True:
        # large-star
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: large holds (u, v) with v < u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = least.select("u", F.col("m").alias("v"))
        before, pairs = pairs, materialise(small.unionByName(links).where("u <> v").distinct(), name)
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
