"""Centroid clustering in integers, filtered through ball trees of the partitions.

Vectors are gathered into trees of ``tree_rows`` where they lie, and the trees
are written once. A round walks each tree from its root: a ball that by the
triangle inequality lies nearer to one centroid than to all others goes to it
whole, by its count and integer sum; else its halves are tried with the
centroids that remain possible, and leaves are compared exactly. Only sums per
centroid leave a task. New centroids are the exact floor(sum / count).

Kept are vectors of exactly ``dim`` components, none null or non-finite, also
those with a null vec_id, which are assigned but never start a centroid unless
there are too few others. Repeated rows count each; ties between starts go by
the components. Fewer vectors than centroids give fewer centroids; an empty
table gives no rows. Extra columns are not read. Scaled components of 2^53 or
more, and distances beyond a long, are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree
from .common import materialise


@dataclass(frozen=True)
class Parameters:
    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    tree_rows: int = 4096
    leaf: int = 32


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances as int64; an error beyond its range."""
    reach = balltree.largest(points) + balltree.largest(centroids)
    if points.shape[1] * reach * reach < balltree.EXACT:
        a, b = points.astype(np.float64), centroids.astype(np.float64)
    else:
        a, b = points.astype(object), centroids.astype(object)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def walk(tree: dict, centroids: np.ndarray):
    """(begin, end, node, owners): ranges of the tree's points with their centroid; node is -1 where points were compared one by one."""
    values = centroids.astype(np.float64)
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        node, open_ = stack.pop()
        radius = tree["radius"][node]
        away = balltree.norms(values[open_] - tree["centre"][node])
        slack = 1e-9 * (1 + away + radius)
        least = int(away.argmin())
        nearer = away - radius - slack <= away[least] + radius + slack[least]
        begin, end = int(tree["begin"][node]), int(tree["end"][node])
        if nearer.sum() == 1:
            yield begin, end, node, open_[least]
        elif tree["left"][node] < 0:
            open_ = open_[nearer]
            yield begin, end, -1, open_[distances(tree["points"][begin:end], centroids[open_]).argmin(axis=1)]
        else:
            stack += [(int(tree["left"][node]), open_[nearer]), (int(tree["right"][node]), open_[nearer])]


def trees(vectors: DataFrame, how: Parameters) -> DataFrame:
    """(tree): one ball tree of every ``tree_rows`` vectors of a partition, with vec_ids."""

    def run(batches):
        import pyarrow as pa

        def grow(parts):
            table = pa.Table.from_batches(parts)
            tree = balltree.build(balltree.matrix(table.column(1)).reshape(table.num_rows, how.dim), how.leaf)
            order, ids = tree.pop("order"), table.column(0)
            known = ids.is_valid().to_numpy()[order]
            return pa.RecordBatch.from_arrays([pa.array([balltree.pack(ids=ids.fill_null(0).to_numpy()[order], known=known, **tree)], pa.binary())], names=["tree"])

        kept, n = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, how.tree_rows):
                part = batch.slice(begin, how.tree_rows)
                if n and n + part.num_rows > how.tree_rows:
                    yield grow(kept)
                    kept, n = [], 0
                kept.append(part)
                n += part.num_rows
        if n:
            yield grow(kept)

    return vectors.select("vec_id", "v").mapInArrow(run, "tree binary")


def _sums(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): counts and componentwise sums of each centroid's vectors, added up by Spark."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
            for data in batch.column(0).to_pylist():
                tree = balltree.unpack(data)
                for begin, end, node, owners in walk(tree, centroids):
                    if node >= 0:
                        counts[owners] += end - begin
                        sums[owners] += tree["sums"][node]
                    else:
                        for j in np.unique(owners):
                            own = tree["points"][begin:end][owners == j]
                            counts[j] += len(own)
                            sums[j] += own.sum(axis=0)
            rows = [(j, i, int(counts[j]), int(sums[j][i])) for j in np.flatnonzero(counts) for i in range(centroids.shape[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["cluster", "i", "n", "total"])

    parts = grown.mapInArrow(run, "cluster int, i int, n long, total long")
    return parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def starts(vectors: DataFrame, how: Parameters) -> np.ndarray:
    rows = vectors.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(how.k).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), how.dim)


def refine(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: k x dim sums reach the driver, whatever the table's size."""
    out = centroids.copy()
    for r in _sums(grown, centroids).collect():
        out[r.cluster, r.i] = int(r.total) // r.n
    return out


def assigned(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                tree = balltree.unpack(data)
                own = np.empty(len(tree["ids"]), np.int64)
                for begin, end, _, owners in walk(tree, centroids):
                    own[begin:end] = owners
                away = np.empty(len(own), np.int64)
                for j in np.unique(own):
                    at = np.flatnonzero(own == j)
                    away[at] = distances(tree["points"][at], centroids[j : j + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64(), mask=~tree["known"]), pa.array(own, pa.int32()), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return grown.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, how: Parameters = Parameters()) -> tuple[DataFrame, np.ndarray]:
    """The assignment of ``vectors`` (vec_id, embedding) after all rounds, and the final centroids."""
    fits = balltree.usable(F.col("embedding")) & (F.size("embedding") == how.dim)
    rows = vectors.where(fits).select("vec_id", balltree.scaled(F.col("embedding"), how.scale).alias("v"))
    grown = materialise(trees(rows, how), "centroid-trees")
    centroids = starts(rows, how)
    if not len(centroids):
        return assigned(grown, centroids), centroids
    for _ in range(how.rounds):
        centroids = refine(grown, centroids)
    return materialise(assigned(grown, centroids), "centroid-result"), centroids


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # one row a centroid
    text = [",".join(map(str, c.tolist())) for c in centroids]
    whole = sum(int(r.own) for r in inertia)
    known = spark.createDataFrame([(r.cluster, int(r.own), whole, text[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, __text string")
    return rows.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("__text", 256).alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    near = "select vec_id, v, min_by(c, [d, c]) as c, min(d) as d from (select vec_id, v, c, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, z{i}) group by 1, 2"
    parts = [
        "v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"z0 as (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as c, v as z from v order by sha256('1:' || vec_id) limit {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} as ({near.format(i=i)})",
            f"s{i} as (select c, i, floor(sum(x) / count(*))::bigint as x, sum(x)::hugeint as t, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by 1, 2)",
            f"m{i} as (select c, list((t - ((t % n) + n) % n) // n order by i)::bigint[] as z from s{i} group by 1)",
            f"z{i + 1} as (select z{i}.c, coalesce(m{i}.z, z{i}.z) as z from z{i} left join m{i} using (c))",
        ]
    parts.append(f"f as ({near.format(i=rounds)})")
    return "with " + ", ".join(parts) + f" select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(z, ',')) as centroid_sha256 from f join z{rounds} using (c)"


SQL = _sql()
