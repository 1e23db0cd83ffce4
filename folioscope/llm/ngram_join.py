"""Jaccard self-join on word n-grams by a MinHash LSH forest with exact verification.

Every document has a MinHash signature cut into trees; a tree's values, in
order, are a path in that tree's prefix trie. All paths are sorted over the
cluster by ranges of (path, document), so that no prefix, however common, lies
in one task; the lengths of the prefixes that sorted neighbours share are the
trie. Neighbours that share a prefix of the current depth are linked; what
these links connect is a candidate group.

The candidate groups are verified exactly, all pairs of different texts, in
blocks of bounded size: a large group is dealt as pairs of blocks, whose
intersections are counted by matrix products. What leaves a block is the number
of links of each text, a spanning forest of them, never the pairs, and the sum
over links of 1 / the probability that a pair so similar shares a prefix. Links
found by that sum estimate the recall on the data. While it is below the
target, and while there are no links to estimate it from and a pair exactly at
the threshold would be found too rarely, the matched prefixes are shortened by
one value and verification is repeated; at the shortest that is allowed the estimate
is returned with the result, and warned of. Equal word sequences are collapsed
before all that.

Words are lower-cased runs of letters and digits. A document shorter than n
words has one shingle, its whole sequence; one without words has none, and no
links; equal sequences (also empty ones, null text included) are one class.
Different texts under one doc_id are joined each on its own. Null doc_ids get an
id below zero from their text, and give way to every other id. Extra columns are
ignored. An empty table gives an empty result.

A word sequence goes by 64 bits of its digest: among n different ones a
collision is expected once in n^2 / 3.7e19.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, partitions, slices
from .graph import components

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
STEP_INVERSE = U64(pow(int(STEP), -1, 1 << 64))


@dataclass(frozen=True)
class Parameters:
    n: int = 5
    threshold: float = 0.8
    trees: int = 32
    #: Values of a path; matching starts with all of them and ends with the fewest.
    max_depth: int = 8
    min_depth: int = 4
    target_recall: float = 0.999
    seed: int = 7
    #: Documents and shingles of a block, about.
    block_docs: int = 1024
    block_shingles: int = 1_000_000

    def found(self, similarity, depth: int):
        """Probability that a pair shares a prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees


BITS = 14  # of a value in a path: a tree's number and four values fill the first word, four more the second
PER_WORD = 4


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, size: int) -> np.ndarray:
    """Letters and digits of Unicode, or powers of the hash's base and of its inverse, grown as needed."""
    if name not in _TABLES or len(_TABLES[name]) < size:
        if name == "word":
            _TABLES[name] = np.fromiter((chr(i).isalnum() for i in range(size)), bool, size)
        else:
            powers = np.full(max(size, 1 << 21), STEP if name == "power" else STEP_INVERSE, np.uint64)
            powers[0] = 1
            _TABLES[name] = np.cumprod(powers, dtype=np.uint64)
    return _TABLES[name]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the index of the text of each."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4") if texts else np.empty(0, np.uint32)
    word = _table("word", 0x110000)[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + U64(1)) * _table("power", len(codes))[: len(codes)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * _table("inverse", len(codes) + 1)[begin] + (end - begin).astype(np.uint64))
    last = np.cumsum([len(x) + 1 for x in lowered])
    return hashes, np.searchsorted(last, begin, side="right")


def shingle_sets(texts: list[str], n: int) -> list[tuple[bytes, np.ndarray]]:
    """For each text the digest of its word sequence, and its sorted distinct shingle hashes."""
    hashes, owner = word_hashes(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled += hashes[k : k + len(rolled)] * U64(((2 * k + 1) * int(STEP) | 1) % (1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        words = hashes[a:b]
        digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
        if b - a >= n:
            own = np.unique(rolled[a : b - n + 1])
        elif b > a:
            own = np.frombuffer(digest[:8], np.uint64)
        else:
            own = np.empty(0, np.uint64)
        out.append((digest, own))
    return out


def paths(sets: list[np.ndarray], how: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty shingle set its path in each tree, as two words: sets x trees each."""
    rng = np.random.default_rng(how.seed)
    n = how.trees * how.max_depth
    xor, factor = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    values = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    begin = np.cumsum([0, *(len(x) for x in sets[:-1])])
    first, second = np.empty((len(sets), how.trees), np.uint64), np.zeros((len(sets), how.trees), np.uint64)
    scratch = np.empty_like(values)
    for tree in range(how.trees):
        words = [np.full(len(sets), tree << 56, np.uint64), np.zeros(len(sets), np.uint64)]
        for level in range(how.max_depth):
            i = tree * how.max_depth + level
            np.bitwise_xor(values, xor[i], out=scratch)
            np.multiply(scratch, factor[i], out=scratch)
            value = mix(np.minimum.reduceat(scratch, begin).astype(np.uint64)) >> U64(64 - BITS)
            words[level // PER_WORD] |= value << U64(BITS * (PER_WORD - 1 - level % PER_WORD))
        first[:, tree], second[:, tree] = words
    return first, second


def shared_depth(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """How many leading values two rows of paths share; -1 in different trees."""
    depth = np.where((a1 ^ b1) >> U64(56) == 0, 0, -1)
    same = depth == 0
    for x, y in ((a1, b1), (a2, b2)):
        for k in range(PER_WORD):
            same &= (x ^ y) >> U64(BITS * (PER_WORD - 1 - k)) == 0
            depth += same
    return depth


def identity() -> Column:
    """doc_id, or for a null one a number below zero from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), -2 - F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))


def text_hash() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64("text")


def first_of(*more: str) -> Column:
    """The smallest id, ids of null doc_ids last, with ``more`` columns."""
    return F.min(F.struct((F.col("id") < 0).alias("unnamed"), "id", *more))


def signatures(docs: DataFrame, how: Parameters) -> DataFrame:
    """(id, text_hash, hi, lo, n_shingles, first, second) for each row: digest of the word sequence, and the paths."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for begin, end in slices([len(x) for x in texts], 1 << 19):
                sets = shingle_sets(texts[begin:end], how.n)
                full = [i for i, (_, x) in enumerate(sets) if len(x)]
                firsts: list = [[]] * len(sets)
                seconds: list = [[]] * len(sets)
                if full:
                    for i, x, y in zip(full, *(x.view(np.int64) for x in paths([sets[i][1] for i in full], how))):
                        firsts[i], seconds[i] = x, y
                digest = np.frombuffer(b"".join(x for x, _ in sets), "<i8").reshape(-1, 2)
                words = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(begin, end - begin).cast(pa.int64()), "text_hash": batch.column(1).slice(begin, end - begin), "hi": digest[:, 0], "lo": digest[:, 1], "n_shingles": pa.array([len(x) for _, x in sets], pa.int64()), "first": pa.array(firsts, words), "second": pa.array(seconds, words)})

    return docs.select(identity(), text_hash(), "text").mapInArrow(run, "id long, text_hash long, hi long, lo long, n_shingles long, first array<long>, second array<long>")


def trie(members: DataFrame, how: Parameters) -> DataFrame:
    """(a, b, depth) of documents that are sorted neighbours in some tree, with the longest prefix that they share.

    ``members`` has node, first and second. Two neighbours in different tasks
    are compared on the driver, which gets two rows a task.
    """
    rows = members.select("node", F.explode(F.arrays_zip("first", "second")).alias("p")).select(F.col("p.first").alias("x"), F.col("p.second").alias("y"), "node")
    sorted_rows = rows.repartitionByRange(partitions(members.sparkSession), "x", "y", "node").sortWithinPartitions("x", "y", "node")
    least = how.min_depth

    def neighbours(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, last = TaskContext.get().partitionId(), None

        def ends(place, row):
            return pa.RecordBatch.from_pydict({"a": pa.array([row[2]], pa.int64()), "b": pa.array([None], pa.int64()), "depth": pa.array([0], pa.int32()), "place": pa.array([place], pa.int32()), "task": pa.array([task], pa.int32()), "x": pa.array([row[0]], pa.int64()), "y": pa.array([row[1]], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, node = (batch.column(i).to_numpy() for i in range(3))
            if last is None:
                yield ends(0, (x[0], y[0], node[0]))
            else:
                x, y, node = (np.append(np.int64(v), w) for v, w in zip(last, (x, y, node)))
            last = x[-1], y[-1], node[-1]
            u, v = x.view(np.uint64), y.view(np.uint64)
            depth = shared_depth(u[:-1], v[:-1], u[1:], v[1:])
            at = np.flatnonzero((depth >= least) & (node[:-1] != node[1:]))
            none = pa.nulls(len(at), pa.int64())
            small = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[at], node[at + 1])), pa.array(np.maximum(node[at], node[at + 1])), pa.array(depth[at].astype(np.int32)), small, small, none, none], names=["a", "b", "depth", "place", "task", "x", "y"])
        if last is not None:
            yield ends(1, last)

    found = materialise(sorted_rows.mapInArrow(neighbours, "a long, b long, depth int, place int, task int, x long, y long"), "trie")
    edges = found.where("place is null").select("a", "b", "depth")
    spots = sorted((r.task, r.place, r.x, r.y, r.a) for r in found.where("place is not null").collect())
    joints = []
    for (_, _, x, y, node), (_, _, x2, y2, node2) in zip(spots[1::2], spots[2::2]):
        depth = int(shared_depth(*(np.array([w], np.int64).view(np.uint64) for w in (x, y, x2, y2)))[0])
        if depth >= least and node != node2:
            joints.append((min(node, node2), max(node, node2), depth))
    if joints:
        edges = edges.unionByName(members.sparkSession.createDataFrame(joints, "a long, b long, depth int"))
    return edges.groupBy("a", "b").agg(F.max("depth").alias("depth"))


def _reached(linked: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric adjacency matrix the smallest vertex that it reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets have a Jaccard similarity of at least the threshold, exactly, and the similarities; right None: left with itself."""
    share = Fraction(str(threshold))
    every = left if right is None else left + right
    sizes = np.array([len(x) for x in every], np.int64)
    owner = np.repeat(np.arange(len(every)), sizes)
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # what only one set has meets nothing
    keep = times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n_left, width = len(left), 2048
    both = np.zeros((n_left, len(every) - n_left if right is not None else n_left), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(every), width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        both += block[:n_left] @ (block[n_left:] if right is not None else block).T
    both = both.astype(np.int64)
    total = sizes[:n_left, None] + (sizes[n_left:] if right is not None else sizes)[None, :]
    return both * (share.numerator + share.denominator) >= share.numerator * total, both / (total - both)


def _verify(table, how: Parameters, depth: int):
    """Links of a block or between two blocks: (node, other, links, expected); other is filled in forest edges."""
    import pyarrow as pa

    seen, nodes, side, sets = set(), [], [], []
    for node, block, data in zip(table["node"].to_pylist(), table["block"].to_pylist(), table["shingles"]):
        if (node, block) not in seen:
            seen.add((node, block))
            nodes.append(node)
            side.append(block)
            sets.append(np.frombuffer(data.as_py(), np.uint64))
    first, second = table["i"][0].as_py(), table["j"][0].as_py()
    order = sorted(range(len(nodes)), key=lambda k: (side[k], nodes[k]))
    nodes, sets, side = [nodes[k] for k in order], [sets[k] for k in order], [side[k] for k in order]
    n = sum(x == first for x in side)
    m = len(nodes)
    linked, similar = np.zeros((m, m), bool), np.zeros((m, m))
    if first == second:
        linked[:], similar[:] = links_between(sets, None, how.threshold)
        np.fill_diagonal(linked, False)
    elif 0 < n < m:
        linked[:n, n:], similar[:n, n:] = links_between(sets[:n], sets[n:], how.threshold)
        linked |= linked.T
        similar = np.maximum(similar, similar.T)
    expected = np.where(linked, 1 / how.found(np.maximum(similar, how.threshold), depth), 0).sum(axis=1)
    label = _reached(linked)
    degree = linked.sum(axis=1)
    rows = [k for k in range(m) if degree[k]]
    return pa.table({"node": pa.array([nodes[k] for k in rows], pa.int64()), "other": pa.array([nodes[label[k]] for k in rows], pa.int64()), "links": pa.array(degree[rows], pa.int64()), "expected": pa.array(expected[rows], pa.float64())})


def _joined(docs: DataFrame, how: Parameters) -> DataFrame:
    """As ``join``, with text_hash and class_node, the number of the class."""
    rows = materialise(signatures(docs, how), "signatures")
    # The copies are a table of their own, so that a join with a hot one can be split.
    copies = materialise(rows.groupBy("hi", "lo").agg(first_of("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "n", "least"), "copies")
    both = rows.join(copies, ["hi", "lo"], "left")
    is_first = F.col("n").isNull() | ((F.col("id") == F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash")))
    members = materialise(both.select("id", "text_hash", F.col("hi").alias("node"), F.coalesce("n", F.lit(1).cast("long")).alias("n_copies"), "n_shingles", F.coalesce("least.id", "id").alias("copy_id"), is_first.alias("is_first"), F.when(is_first, F.col("first")).alias("first"), F.when(is_first, F.col("second")).alias("second")), "members")
    discard(rows)
    discard(copies)
    neighbours = materialise(trie(members.where("is_first"), how), "neighbours")
    depth = how.max_depth
    while True:
        verified = materialise(_links(docs, members, neighbours.where(F.col("depth") >= depth), how, depth), "links")
        links, expected = verified.agg(F.sum("links"), F.sum("expected")).first()
        recall = links / expected if links else how.found(how.threshold, depth)
        if recall >= how.target_recall or depth <= how.min_depth:
            break
        discard(verified)
        depth -= 1
    if recall < how.target_recall:
        warnings.warn(f"estimated recall {recall:.4f} at the least depth {depth}, below the target {how.target_recall}", stacklevel=3)
    out = _classes(members, verified)
    out.estimated_recall = recall
    return out


def _links(docs: DataFrame, members: DataFrame, neighbours: DataFrame, how: Parameters, depth: int) -> DataFrame:
    """Exact links within what ``neighbours`` connect."""
    candidates = components(neighbours.select("a", "b"), "candidates")

    # Blocks of the candidate groups.
    sizes = members.where("is_first").groupBy("node").agg(F.max("n_shingles").alias("n"), F.first("id").alias("id"), F.first("text_hash").alias("text_hash"), (F.count("*") > 1).alias("repeated"))
    groups = candidates.join(sizes, "node")
    blocks = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / how.block_docs), F.ceil(F.sum("n") / how.block_shingles)).cast("int").alias("n_blocks"))
    placed = groups.join(blocks, "root").select("id", "text_hash", "node", "root", "n_blocks", "repeated", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"))
    texts = docs.select(identity().alias("id"), text_hash().alias("text_hash"), "text")

    def shingle(batches):
        import pyarrow as pa

        seen: set[int] = set()  # of a row that is repeated a task sends one, however many it reads
        for batch in batches:
            fresh_rows = []
            for at, (node, repeated) in enumerate(zip(batch.column("node").to_pylist(), batch.column("repeated").to_pylist())):
                if not repeated or node not in seen:
                    fresh_rows.append(at)
                    if repeated:
                        seen.add(node)
            batch = batch.take(pa.array(fresh_rows, pa.int64())) if len(fresh_rows) < batch.num_rows else batch
            batch = batch.select(["text", "node", "root", "n_blocks", "block"])
            values = batch.column(0).to_pylist()
            for begin, end in slices([len(x or "") for x in values], 1 << 19):
                sets = shingle_sets([x or "" for x in values[begin:end]], how.n)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([x.tobytes() for _, x in sets], pa.binary())], names=["node", "root", "n_blocks", "block", "shingles"])

    sets = texts.join(placed, ["id", "text_hash"]).select("text", "node", "root", "n_blocks", "block", "repeated").mapInArrow(shingle, "node long, root long, n_blocks int, block int, shingles binary")
    dealt = sets.select("root", "node", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("k")).select("root", "node", "block", "shingles", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    return dealt.groupBy("root", "i", "j").applyInArrow(lambda table: _verify(table, how, depth), "node long, other long, links long, expected double")


def _classes(members: DataFrame, verified: DataFrame) -> DataFrame:
    classes = components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")), "classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = classes.join(members.where("is_first").select("node", "id").distinct(), "node")
    names = named.groupBy("root").agg(first_of().alias("least")).select("root", F.col("least.id").alias("least"))
    classes = classes.join(names, "root")
    return (
        members.drop("first", "second")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("least", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies", "copy_id", "text_hash", F.coalesce("root", "node").alias("class_node"))
    )


def join(docs: DataFrame, how: Parameters = Parameters()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of all documents that links connect;
    n_links counts the *different* texts at or above the threshold; n_copies
    the rows with the same word sequence, this one included. The result's
    ``estimated_recall`` is the share of links that were found, as estimated;
    one below the target is also a warning.
    """
    found = _joined(docs, how)
    out = found.drop("text_hash", "class_node")
    out.estimated_recall = found.estimated_recall
    return out


def one_of_each(docs: DataFrame, how: Parameters = Parameters()) -> DataFrame:
    """One row of ``docs`` for each class: of its smallest doc_id, and of several texts or rows of that just one.

    Of rows with one doc_id and text that stay the first by their other columns does.
    """
    own, own_hash, place = (fresh(c, docs.columns) for c in ("__id", "__text_hash", "__place"))
    kept = _joined(docs, how).withColumnRenamed("doc_id", "id").groupBy("class_node").agg(first_of("text_hash").alias("k")).select(F.col("k.id").alias(own), F.col("k.text_hash").alias(own_hash))
    rows = docs.withColumns({own: identity(), own_hash: text_hash()}).join(kept, [own, own_hash], "left_semi")
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"]))
    number = F.row_number().over(Window.partitionBy(own, own_hash).orderBy(others))
    return rows.withColumn(place, number).where(F.col(place) == 1).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
