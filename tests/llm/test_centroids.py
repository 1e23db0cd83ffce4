import hashlib
import random

import numpy as np

from folioscope.llm import balltree
from folioscope.llm.centroids import Parameters, cluster, distances, op12, walk

SCHEMA = "vec_id long, embedding array<float>"
SMALL = Parameters(k=5, rounds=3, dim=3, scale=64, tree_rows=30, leaf=3)


def brute(rows, how):
    """(vec_id, cluster, distance) in order, and the centroids, by comparing all."""
    fits = [(i, [int(how.scale * x // 1) for x in v]) for i, v in rows if v is not None and len(v) == how.dim and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    order = sorted(fits, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[: how.k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(how.rounds):
        own = [near(v)[1] for _, v in fits]
        for j in set(own):
            mine = [v for (_, v), o in zip(fits, own) if o == j]
            centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in fits), key=repr), centres


def check(spark, rows, how=SMALL):
    got, centres = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), how)
    want, expected = brute(rows, how)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert centres.tolist() == expected


def vectors(n, seed):
    r = random.Random(seed)
    middles = [[r.uniform(-2, 2) for _ in range(3)] for _ in range(4)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.1))) for c in r.choice(middles)]) for i in range(n)]


def test_equals_comparing_all(spark):
    for seed in (1, 2):
        check(spark, vectors(300, seed))


def test_equal_vectors_ties_nulls_and_other_lengths(spark):
    nan = float("nan")
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [nan, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.75])]
    check(spark, vectors(60, 3) + [(100 + i, [1.0, 1.0, 1.0]) for i in range(90)] + [(5, [1.0, -1.0, 0.0])] * 4 + odd)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [-1.0, 2.0, 3.0])])
    got, centres = cluster(spark.createDataFrame([], SCHEMA), SMALL)
    assert got.count() == 0 and len(centres) == 0


def test_query_over_the_table(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    want, centres = brute(rows, Parameters())
    got = op12(spark, tables).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    totals = {}
    for _, c, d in want:
        totals[c] = totals.get(c, 0) + d
    for r in got:
        assert r.cluster_inertia == totals[r.cluster] and r.inertia == sum(totals.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_whole_balls_are_assigned():
    r = np.random.default_rng(5)
    points = np.vstack([r.integers(0, 20, (400, 4)), r.integers(1000, 1020, (400, 4))])
    centres = np.array([[10, 10, 10, 10], [1010, 1010, 1010, 1010], [5000, 0, 0, 0]])
    tree = balltree.build(points, 16)
    ranges = list(walk(tree, centres))
    assert len(ranges) == 2 and all(node >= 0 for *_, node, _ in ranges)  # neither leaf nor single point was looked at
    big = np.array([[10**9, -(10**9)], [10**9 + 1, 3]])
    assert distances(big, big).tolist() == [[0, (10**9 + 3) ** 2 + 1], [(10**9 + 3) ** 2 + 1, 0]]
