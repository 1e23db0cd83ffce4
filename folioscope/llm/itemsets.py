"""Closed itemsets of baskets and their rules: close-by-one over the iceberg lattice.

Items are ordered by support, the rarest first. A closed set belongs to the
subtree of its rarest item, whose context are the baskets with that item, cut to
the items after it; equal rows of a context are one row with a weight.

Breadth phase: the contexts of all frequent items are made by Spark. A context
of more than ``cells`` cells is closed by aggregation and split into the
contexts of its extensions, as often as it takes; whatever its size, nothing of
it is gathered. Depth phase: each remaining context, bounded by ``cells``, is a
task of its own that runs close-by-one depth first. An extension whose closure
would hold an item before it, outside of the present set, is not canonical; such
failures are handed down, and a failure that still speaks against an extension
saves the closure.

A context lacks the items before its own, so what is closed in it may not be
closed at all. Sets with the same baskets have the same support and the same
128-bit exclusive or of basket hashes, and the largest of them is their closure:
the others go. (Two different extents are confused with a chance below
n^2 / 2^128 for n sets.)

Rows without basket or item are left out; repeated rows count once; baskets of
any length go whole; ties between items go by the item; an empty table gives no
rows. Extra columns are not read. The frequent items of a basket stand in one
row: with N incidences in B baskets there are at most N / (least share * B) of
them, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

FOUND = "items array<long>, support long, f1 long, f2 long"


@dataclass(frozen=True)
class Parameters:
    #: A set is frequent with support >= least and support * share >= baskets.
    least: int = 8
    share: int = 5000
    #: Confidence of a rule in percent, at least; its lift is above 1.
    confidence: int = 10
    #: Cells of a context that one task takes.
    cells: int = 1 << 20


class Context:
    """Weighted rows of items, by row and by item; items are their places in ``attributes``."""

    def __init__(self, lengths: np.ndarray, items: np.ndarray, weights: np.ndarray, marks: np.ndarray, least: int):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        self.weights, self.marks = weights, marks
        names, place = np.unique(items, return_inverse=True)
        support = np.bincount(place, weights=weights[rows], minlength=len(names))
        frequent = support >= least
        keep = frequent[place] if len(place) else np.empty(0, bool)
        self.attributes = names[frequent]
        self.m = len(self.attributes)
        self.cell, rows = (np.cumsum(frequent) - 1)[place[keep]] if len(place) else place, rows[keep] if len(place) else rows
        self.length = np.bincount(rows, minlength=len(lengths))
        self.start = np.cumsum(self.length) - self.length
        by_item = np.argsort(self.cell, kind="stable")
        self.column = np.split(rows[by_item], np.cumsum(np.bincount(self.cell, minlength=self.m))[:-1]) if self.m else []

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Weight of the rows with each item."""
        n = self.length[rows]
        at = np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.cell[at], weights=np.repeat(self.weights[rows], n), minlength=self.m)


def _set(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def close_by_one(context: Context, least: int):
    """(attributes as a set of bits, rows) of every frequent closed set of the context, the closure of nothing first."""
    every = np.arange(len(context.weights))
    counts = context.counts(every)
    inside = np.zeros(len(every), bool)
    stack = [(every, _set(counts == context.weights.sum()), 0, {}, counts)]
    while stack:
        rows, closed, first, failed, counts = stack.pop()
        yield closed, rows
        inside[rows] = True
        children, handed = [], failed
        for y in (np.flatnonzero(counts[first:] >= least) + first).tolist():
            before = (1 << y) - 1
            if closed >> y & 1 or failed.get(y, 0) & before & ~closed:
                continue
            own = context.column[y][inside[context.column[y]]]
            below = context.counts(own)
            closure = _set(below == counts[y])
            if closure & before == closed & before:
                children.append((own, closure, y + 1, below))
            else:
                handed = dict(handed) if handed is failed else handed
                handed[y] = closure
        inside[rows] = False
        stack += [(own, closure, start, handed, below) for own, closure, start, below in children]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _mine(least: int):
    def run(key, table):
        import pyarrow as pa

        prefix = key[0].as_py()
        lengths, items = _lists(table.column("suffix"))
        weights = table.column("w").to_numpy().astype(np.int64)
        marks = np.vstack([table.column("f1").to_numpy(), table.column("f2").to_numpy()]).astype(np.int64)
        context = Context(lengths, items, weights, marks, least)
        sets, support, seals = [], [], []
        for closed, rows in close_by_one(context, least):
            own = [int(context.attributes[j]) for j in range(context.m) if closed >> j & 1] if closed else []
            sets.append(sorted([*prefix, *own]))
            support.append(int(weights[rows].sum()))
            seals.append(np.bitwise_xor.reduce(marks[:, rows], axis=1))
        f1, f2 = np.array(seals).T
        return pa.table({"items": pa.array(sets, pa.list_(pa.int64())), "support": pa.array(support, pa.int64()), "f1": f1, "f2": f2})

    return run


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Equal rows as one: their weights added up, their marks combined."""
    return rows.groupBy(*keys).agg(F.sum("w").alias("w"), F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"))


def _extended(rows: DataFrame, before, items) -> DataFrame:
    """A context for each item of each row: what stands after it."""
    each = rows.select(before, items.alias("own"), "w", "f1", "f2").select("*", F.posexplode("own").alias("place", "item"))
    suffix = F.slice("own", F.col("place") + 2, F.greatest(F.size("own") - F.col("place") - 1, F.lit(0)))
    return _gathered(each.select(F.array_sort(F.concat("before", F.array("item"))).alias("prefix"), suffix.alias("suffix"), "w", "f1", "f2"), "prefix", "suffix")


def _split(big: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The closures of large contexts, and the contexts of their extensions."""
    whole = _gathered(big, "prefix")
    counts = big.select("prefix", F.explode("suffix").alias("item"), "w").groupBy("prefix", "item").agg(F.sum("w").alias("n")).where(F.col("n") >= least)
    always = F.collect_list(F.when(F.col("n") == F.col("w"), F.col("item")))
    sometimes = F.collect_list(F.when(F.col("n") < F.col("w"), F.col("item")))
    items = counts.join(whole.select("prefix", "w"), "prefix").groupBy("prefix").agg(always.alias("always"), sometimes.alias("sometimes"))
    none = F.array().cast("array<long>")
    closures = whole.join(items, "prefix", "left").select(F.array_sort(F.concat("prefix", F.coalesce("always", none))).alias("items"), F.col("w").alias("support"), "f1", "f2")
    rows = big.join(items, "prefix").withColumn("before", F.concat("prefix", "always"))
    return closures, _extended(rows, F.col("before"), F.array_intersect("suffix", "sometimes"))


def _sized(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("prefix").agg(F.sum(F.size("suffix") + 1).alias("cells"))


def candidates(first: DataFrame, least: int, cells: int) -> DataFrame:
    """Sets with support and marks: all closed ones, and some that only their context holds for closed."""
    parts, contexts = [], first
    while True:
        sizes = materialise(_sized(contexts), "itemsets-sizes")
        large = sizes.where(F.col("cells") > cells)
        small = contexts.join(sizes.where(F.col("cells") <= cells), "prefix", "left_semi")
        parts.append(small.groupBy("prefix").applyInArrow(_mine(least), FOUND))
        if large.isEmpty():
            break
        closures, deeper = _split(contexts.join(large, "prefix", "left_semi"), least)
        parts.append(closures)
        contexts = materialise(deeper, "itemsets-contexts")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _supports(wanted: DataFrame, contexts: DataFrame, cells: int) -> DataFrame:
    """(items, a): how many baskets hold all items of each wanted set, counted in the context of its first item, piece by piece."""

    def run(key, sets, rows):
        import pyarrow as pa

        schema = pa.schema([("items", pa.list_(pa.int64())), ("a", pa.int64())])
        if not sets.num_rows or not rows.num_rows:
            return schema.empty_table()
        lengths, items = _lists(rows.column("suffix"))
        weights, at = rows.column("w").to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(items, kind="stable")
        names, begin = np.unique(items[order], return_index=True)
        column = dict(zip(names.tolist(), np.split(at[order], begin[1:])))
        out = []
        for own in sets.column("items").to_pylist():
            found = None
            for item in own[1:]:
                rows_of = column.get(item, np.empty(0, np.int64))
                found = rows_of if found is None else np.intersect1d(found, rows_of, assume_unique=True)
            out.append(int(weights.sum() if found is None else weights[found].sum()))
        return pa.table({"items": sets.column("items"), "a": out}, schema=schema)

    pieces = _sized(contexts).select("prefix", F.ceil(F.col("cells") / cells).cast("int").alias("pieces"))
    asked = wanted.withColumn("prefix", F.slice("items", 1, 1)).join(pieces, "prefix").select("items", "prefix", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    rows = contexts.join(pieces, "prefix").join(asked.select("prefix").distinct(), "prefix", "left_semi").withColumn("piece", F.pmod(F.xxhash64("suffix"), "pieces").cast("int"))
    rows = rows.select(F.col("prefix").alias("of_prefix"), F.col("piece").alias("of_piece"), "suffix", "w")
    counted = asked.groupBy("prefix", "piece").cogroup(rows.groupBy("of_prefix", "of_piece")).applyInArrow(run, "items array<long>, a long")
    return counted.groupBy("items").agg(F.sum("a").alias("a"))


def closed_itemsets(incidences: DataFrame, how: Parameters = Parameters()) -> DataFrame:
    """``incidences`` (basket, item): each frequent closed set with its rules, one item from all others."""
    pairs = materialise(incidences.where("basket is not null and item is not null").select("basket", "item").distinct(), "itemsets-pairs")
    baskets = pairs.select("basket").distinct().count()
    least = max(how.least, -(-baskets // how.share), 1)
    frequent = pairs.groupBy("item").agg(F.count("*").alias("s")).where(F.col("s") >= least).orderBy("s", "item")
    frequent = materialise(frequent.withColumn("rank", F.monotonically_increasing_id()), "itemsets-frequent")  # rising in this order
    whole = pairs.join(frequent.select("item", "rank"), "item").groupBy("basket").agg(F.array_sort(F.collect_list("rank")).alias("items"))
    whole = whole.select("items", F.lit(1).cast("long").alias("w"), F.xxhash64("basket").alias("f1"), F.xxhash64("basket", F.lit(1)).alias("f2"))
    first = materialise(_extended(_gathered(whole, "items").withColumn("before", F.array().cast("array<long>")), F.col("before"), F.col("items")), "itemsets-contexts")
    found = materialise(candidates(first, least, how.cells), "itemsets-found")
    largest = F.max_by("items", F.struct(F.size("items"), "items"))
    closed = materialise(found.groupBy("support", "f1", "f2").agg(largest.alias("items")).select("items", "support"), "itemsets-closed")

    each = closed.select("items", "support", F.explode("items").alias("rank")).join(frequent, "rank")
    each = each.withColumn("rest", F.array_except("items", F.array("rank")))
    rests = each.where(F.size("items") > 1).select(F.col("rest").alias("items")).distinct()
    known = found.select("items", F.col("support").alias("a")).distinct()
    counted = _supports(rests.join(known, "items", "left_anti"), first, how.cells)
    supports = rests.join(known, "items").unionByName(counted).select(F.col("items").alias("rest"), "a")
    judged = each.join(supports, "rest", "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    is_rule = (wide("support") * 100 >= wide("a") * how.confidence) & (wide("support") * baskets > wide("a") * wide("s"))
    rule = F.when(is_rule, F.struct(F.col("item").alias("c"), "a", "s"))
    sets = judged.groupBy("items", "support").agg(F.array_sort(F.collect_list("item")).alias("names"), F.array_sort(F.collect_list(rule)).alias("rules"), F.min(F.when(is_rule, F.struct("a", F.col("item").alias("c")))).alias("best"))
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r.c, r.a, r.s)), ";")
    return sets.select(
        F.array_join(F.col("names").cast("array<string>"), ",").alias("items"), F.size("names").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), F.col("best.c").alias("best_item"), F.sha2(text, 256).alias("rules_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    return closed_itemsets(lines.select(F.col("sale_id").alias("basket"), F.col("item_id").alias("item")))
