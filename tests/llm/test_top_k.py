import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import balltree
from folioscope.llm.top_k import Parameters, op11, top_k

SCHEMA = "vec_id long, embedding array<float>"
SMALL = Parameters(k=5, shard_rows=40, leaf=4, pivots=7, sample=64, block=3)


def brute(rows, every, k=5, scale=256):
    """(query_id, rank, vec_id, score) by all products."""
    fits = [(i, [int(scale * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = set()
    for q, a in {(q, tuple(a)) for q, a in fits if q % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fits if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def vectors(n=400, seed=1, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [float(F32(c + r.gauss(0, 0.2))) for c in r.choice(centres)]) for i in range(n)]


def F32(x):
    import numpy as np

    return np.float32(x)


def found(spark, rows, every=10, how=SMALL, schema=SCHEMA):
    got = top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0, how).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in got}


def test_equals_all_products(spark):
    rows = vectors()
    assert found(spark, rows) == brute(rows, 10)


def test_many_equal_vectors_fill_several_shards_and_ties_go_by_id(spark):
    rows = vectors(150) + [(1000 + i, rows_v) for i, rows_v in enumerate([[0.9, -0.3, 0.5, 0.1, 2.0, -1.0]] * 160)]
    assert found(spark, rows) == brute(rows, 10)


def test_nulls_lengths_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [1.0, -2.0]), (3, [0.5]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [9.0, 9.0]), (20, [0.25]), (30, []), (31, [])]
    got = found(spark, rows)
    assert got == brute(rows, 10) and (0, 1, 10, -256 * 256 * 3) in got and (20, 1, 3, 128 * 64) in got and (30, 1, 31, 0) in got


def test_repeated_rows_count_each_and_a_repeated_query_once(spark):
    rows = [(0, [1.0, 1.0])] * 2 + [(1, [2.0, 2.0])] * 3 + [(2, [1.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, SMALL).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 2)]


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6 + 1, 1.0]), (1, [3e6, 7.0]), (2, [3e6 + 2, -9.0]), (3, [-3e6, 4.0])]
    assert found(spark, rows, schema="vec_id long, embedding array<double>") == brute(rows, 10)
    with pytest.raises(Exception, match="beyond 2"):
        found(spark, [(0, [1e300]), (1, [1.0])], schema="vec_id long, embedding array<double>")


def test_empty(spark):
    assert found(spark, []) == set()


def test_query_takes_extra_columns_and_all_rows(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in op11(spark, tables).collect()} == brute(rows, 50)


def test_balls_hold_their_points():
    import numpy as np

    points = np.random.default_rng(3).integers(-50, 50, (500, 5))
    points[100:300] = 7
    tree = balltree.build(points, 8)
    assert sorted(tree["order"].tolist()) == list(range(500)) and (points[tree["order"]] == tree["points"]).all()
    for b, e, c, r, s, left in zip(tree["begin"], tree["end"], tree["centre"], tree["radius"], tree["sums"], tree["left"]):
        own = tree["points"][b:e]
        assert (np.linalg.norm(own - c, axis=1) <= r + 1e-9).all() and (own.sum(axis=0) == s).all()
        assert left >= 0 or e - b <= 8 or (own == own[0]).all()
