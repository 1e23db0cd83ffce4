"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Rows are dealt to the nearest of at most ``pivots`` pivots (means of a bounded
sample), and the rows of a pivot to as many shards as ``shard_rows`` asks for.
Each shard has one ball tree, written as a row. A query visits shards in waves:
first that with the highest upper bound of its inner products, then the next
few, then all others that the score which is then its k-th does not rule out.
The k-th scores travel with the queries, so that what one shard has found prunes
whole shards before anything is sent to them, and nodes within the others.

Every row with a vector takes part, repeated rows with each repetition. Rows
without vec_id, with a null vector or with a null or non-finite component take
no part. Vectors of different length are never compared; an empty vector scores
0 with others. A query never finds rows of its own vec_id; several query rows
with one vec_id and vector are one query. Ties go to the smaller vec_id. An
empty table gives no rows. Extra columns are not read. Scaled components of 2^53
or more, and scores beyond a long, are an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import balltree
from .common import materialise

NONE = -(2**63 - 1)
LAST = 2**63 - 1
SHARD = ("dim", "pivot", "sub")


@dataclass(frozen=True)
class Parameters:
    k: int = 5
    scale: int = 256
    #: Rows whose smallest hashes choose the pivots: a bound, whatever the table's size.
    sample: int = 2048
    pivots: int = 256
    shard_rows: int = 4096
    leaf: int = 64
    #: Queries that visit a shard together.
    block: int = 4096
    #: A query's first shards, by their bounds: the waves before the last.
    waves: tuple[int, ...] = (1, 4)


def pivots_of(points: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """At most n means of the points, by a few rounds of the usual iteration from evenly spaced starts."""
    means = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(points, means)[0]
        for j in np.unique(own):
            means[j] = points[own == j].mean(axis=0)
    return means


def nearest(points: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest mean of each point, and the distance to it."""
    points = points.astype(np.float64)
    own = ((means**2).sum(axis=1)[None, :] - 2 * points @ means.T).argmin(axis=1)
    return own, balltree.norms(points - means[own])


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No point of a ball has a larger inner product with the query than this."""
    length = balltree.norms(queries)
    products = queries @ centres.T
    reach = length[:, None] * (radii + balltree.norms(centres))[None, :]
    return products + length[:, None] * radii[None, :] + reach * 1e-9 + 1e-6


def search(tree: dict, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the k best of each query in this tree that reach its floor.

    Nodes are taken by their largest bound; a node keeps only the queries whose
    current k-th score it can still reach.
    """
    ids, points = tree["ids"], tree["points"]
    values = queries.astype(np.float64)
    scores, found = np.full((len(queries), k), NONE), np.full((len(queries), k), LAST)
    kth = floors.copy()
    heap = [(-np.inf, 0, np.arange(len(queries)), np.full(len(queries), np.inf))]
    while heap:
        _, node, active, bound = heapq.heappop(heap)
        active = active[bound >= kth[active]]
        if not len(active):
            continue
        if tree["left"][node] < 0:
            begin, end = tree["begin"][node], tree["end"][node]
            new = balltree.products(queries[active], points[begin:end])
            new[ids[None, begin:end] == query_ids[active][:, None]] = NONE
            better = (new >= np.maximum(kth[active], NONE + 1)[:, None]).any(axis=1)
            active, new = active[better], new[better]
            s = np.hstack([scores[active], new])
            i = np.hstack([found[active], np.broadcast_to(ids[begin:end], new.shape)])
            best = np.lexsort((i, -s), axis=1)[:, :k]
            scores[active], found[active] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[active] = np.maximum(kth[active], scores[active, k - 1])
            continue
        for child in (tree["left"][node], tree["right"][node]):
            own = bounds(values[active], tree["centre"][child : child + 1], tree["radius"][child : child + 1])[:, 0]
            heapq.heappush(heap, (-float(own.max()), int(child), active, own))
    q, place = np.nonzero((scores > NONE) & (scores >= floors[:, None]))
    return q, found[q, place], scores[q, place]


def _place(rows: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, dim, pivot, far, v) with the nearest pivot of each row; without a pivot of its length -1."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64) if batch.num_rows else np.empty(0, np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = batch.take(pa.array(at))
                points = balltree.matrix(part.column(1)).reshape(len(at), dim)
                own, far = nearest(points, means[dim]) if dim in means else (np.full(len(at), -1), balltree.norms(points))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(at), dim), pa.int32()), pa.array(own, pa.int32()), pa.array(far), pa.array([x.tobytes() for x in points.astype("<i8")], pa.binary())], names=["vec_id", "dim", "pivot", "far", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, dim int, pivot int, far double, v binary")


def _points(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _shards(placed: DataFrame, sizes: DataFrame, how: Parameters) -> DataFrame:
    """(dim, pivot, sub, tree): a ball tree of each shard."""

    def grow(key, table):
        import pyarrow as pa

        dim = key[0].as_py()
        tree = balltree.build(_points(table.column("v"), dim), how.leaf)
        ids = table.column("vec_id").to_numpy()[tree.pop("order")]
        tree.pop("sums")
        return pa.table({"dim": pa.array([dim], pa.int32()), "pivot": [key[1].as_py()], "sub": [key[2].as_py()], "tree": [balltree.pack(ids=ids, **tree)]}, schema=pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("sub", pa.int32()), ("tree", pa.binary())]))

    dealt = placed.join(sizes, ["dim", "pivot"]).withColumn("sub", F.pmod("deal", "n_subs").cast("int"))
    return dealt.select(*SHARD, "vec_id", "v").groupBy(*SHARD).applyInArrow(grow, "dim int, pivot int, sub int, tree binary")


def _route(asked: DataFrame, balls: dict, low: int, high: int | None, n_blocks: int) -> DataFrame:
    """Each query with the shards of this wave that may hold a score of its k-th or more.

    A pivot's first shard has the pivot's place in the query's order of bounds;
    the last wave (high is None) takes all other shards of the pivots too.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in balls:
                    continue
                names, centres, radii, subs = balls[dim]
                bound = bounds(_points(part.column("v"), dim).astype(np.float64), centres, radii)
                place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
                open_ = bound >= part.column("kth").to_numpy(zero_copy_only=False)[:, None]
                first = open_ & (place >= low) & (place < (high if high is not None else len(names)))
                q, p = np.nonzero(first)
                s = np.zeros(len(q), np.int64)
                if high is None:
                    q2, p2 = np.nonzero(open_ & (subs[None, :] > 1))
                    more = subs[p2] - 1
                    q, p = np.concatenate([q, np.repeat(q2, more)]), np.concatenate([p, np.repeat(p2, more)])
                    s = np.concatenate([s, np.concatenate([np.arange(1, n + 1) for n in more.tolist()]) if len(more) else np.empty(0, np.int64)])
                for begin in range(0, len(q), 8192):
                    at = slice(begin, begin + 8192)
                    rows = part.take(pa.array(q[at]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("q", "query_id", "dim", "v", "kth")), pa.array(names[p[at]], pa.int32()), pa.array(s[at], pa.int32())], names=["q", "query_id", "dim", "v", "kth", "pivot", "sub"])

    sent = asked.select("q", "query_id", "dim", "v", "kth").mapInArrow(run, "q long, query_id long, dim int, v binary, kth long, pivot int, sub int")
    return sent.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int"))


def _visit(sent: DataFrame, shards: DataFrame, how: Parameters) -> DataFrame:
    """(q, query_id, vec_id, score) of what blocks of queries find in their shards."""

    def run(key, asked, tree):
        import pyarrow as pa

        schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not tree.num_rows:
            return schema.empty_table()
        own = balltree.unpack(tree.column("tree")[0].as_py())
        number, name = asked.column("q").to_numpy(), asked.column("query_id").to_numpy()
        at, ids, scores = search(own, _points(asked.column("v"), key[0].as_py()), name, asked.column("kth").to_numpy(), how.k)
        return pa.table({"q": number[at], "query_id": name[at], "vec_id": ids, "score": scores}, schema=schema)

    keys = [*SHARD, "block"]
    needed = sent.select(*keys).distinct().join(shards, [*SHARD]).select(*[F.col(c).alias(f"of_{c}") for c in keys], "tree")
    return sent.groupBy(*keys).cogroup(needed.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(run, "q long, query_id long, vec_id long, score long")


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, how: Parameters = Parameters()) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding) for the rows that ``is_query`` takes as queries."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & balltree.usable(F.col("embedding"))).select("vec_id", balltree.scaled(F.col("embedding"), how.scale).alias("v"))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(how.sample).select("v").collect()
    by_length: dict[int, list] = {}
    for r in drawn:
        by_length.setdefault(len(r.v), []).append(r.v)
    wanted = min(how.pivots, -(-n // how.shard_rows))
    means = {d: pivots_of(np.array(v, np.int64).reshape(len(v), d), wanted) for d, v in by_length.items() if d}
    placed = materialise(_place(rows, means).withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id())), "topk-placed")
    sizes = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).withColumn("n_subs", F.ceil(F.col("n") / how.shard_rows).cast("int"))
    known = sizes.orderBy("dim", "pivot").collect()  # one a pivot, and one a length without a pivot
    balls = {}
    for dim in {r.dim for r in known}:
        own = [r for r in known if r.dim == dim]
        centres = np.vstack([means[dim][r.pivot] if r.pivot >= 0 else np.zeros(dim) for r in own])
        balls[dim] = (np.array([r.pivot for r in own]), centres, np.array([r.far for r in own]), np.array([r.n_subs for r in own]))
    small = spark.createDataFrame([(r.dim, r.pivot, r.n_subs) for r in known], "dim int, pivot int, n_subs int")
    shards = materialise(_shards(placed, small, how), "topk-shards")
    asked = materialise(placed.where(is_query).select(F.col("vec_id").alias("query_id"), "dim", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "topk-asked")
    n_blocks = max(1, -(-asked.count() // how.block))
    hits = None
    for low, high in zip((0, *how.waves), (*how.waves, None)):
        if hits is None:
            now = asked.withColumn("kth", F.lit(NONE))
        else:
            kth = hits.groupBy("q").agg(F.when(F.count("*") >= how.k, F.min("score")).alias("kth"))
            now = asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))
        new = _visit(_route(now, balls, low, high, n_blocks), shards, how)
        hits = materialise(best(new if hits is None else new.unionByName(hits.drop("rank")), how.k), "topk-hits")
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select query_id, rank::int as rank, vec_id, score from (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_inner_product(q.v, c.v) desc, c.vec_id) as rank
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0)
where rank <= 5"""
