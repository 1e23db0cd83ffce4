import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from folioscope.llm.itemsets import Context, Parameters, close_by_one, closed_itemsets, op13

SCHEMA = "basket long, item long"


def brute(rows, how):
    """All frequent itemsets level by level, then the closed ones and their rules."""
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)
    least = max(how.least, -(-n // how.share), 1)
    tids = {}
    for b, items in baskets.items():
        for i in items:
            tids.setdefault((i,), set()).add(b)
    level = {k: v for k, v in tids.items() if len(v) >= least}
    support, single = {}, level
    while level:
        support |= {k: len(v) for k, v in level.items()}
        level = {(*k, i): both for k, v in level.items() for (i,), w in single.items() if i > k[-1] and len(both := v & w) >= least}
    has_equal = {k[:j] + k[j + 1 :] for k in support for j in range(len(k)) if support.get(k[:j] + k[j + 1 :]) == support[k]}
    out = {}
    for k, x in support.items():
        if k in has_equal:
            continue
        rules = []
        for c in k if len(k) > 1 else ():
            a, s = support[tuple(i for i in k if i != c)], support[c,]
            if 100 * x >= how.confidence * a and x * n > a * s:
                rules.append((c, a, s))
        text = ";".join(f"{c}:{a}:{s}" for c, a, s in sorted(rules))
        best = min(((a, c) for c, a, _ in rules), default=(None, None))[1]
        out[",".join(map(str, k))] = (len(k), x, len(rules), best, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    assert len({r["items"] for r in rows}) == len(rows)
    return {r["items"]: (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) for r in rows}


def baskets(seed, n=400, items=14):
    r = random.Random(seed)
    bundles = [r.sample(range(items), r.randrange(2, 6)) for _ in range(5)]
    rows = []
    for b in range(n):
        own = set(r.choice(bundles)) if r.random() < 0.6 else set()
        own |= {min(int(r.paretovariate(0.8)), items) - 1 for _ in range(r.randrange(1, 5))}
        rows += [(b, i) for i in own for _ in range(r.choice([1, 1, 2]))]
    return rows


@pytest.mark.parametrize("cells", [1 << 20, 60, 1])
def test_equals_all_frequent_sets(spark, cells):
    """Also where every context, or all but the smallest, is split by Spark."""
    for seed in (1, 2) if cells > 60 else (1,):
        rows = baskets(seed)
        how = Parameters(least=8, share=5000, cells=cells)
        want = brute(rows, how)
        assert found(closed_itemsets(spark.createDataFrame(rows, SCHEMA), how)) == want and max(v[0] for v in want.values()) > 3


def test_share_decides_where_it_is_the_stricter(spark):
    rows, how = baskets(4), Parameters(least=2, share=20)
    assert found(closed_itemsets(spark.createDataFrame(rows, SCHEMA), how)) == brute(rows, how)


def test_hot_item_and_hot_basket(spark):
    rows = [(b, 7) for b in range(300)] + [(9999, i) for i in range(500)] + baskets(6, 120)
    how = Parameters()
    assert found(closed_itemsets(spark.createDataFrame(rows, SCHEMA).repartition(5), how)) == brute(rows, how)


def test_items_that_always_go_together_nulls_and_ties(spark):
    rows = [(b, i) for b in range(10) for i in (30, 4, 200)] + [(b, 5) for b in range(20, 30)] + [(None, 4)] * 50 + [(3, None)] * 50
    got = found(closed_itemsets(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, Parameters()) and set(got) == {"4,30,200", "5"}


def test_every_basket_holds_the_item(spark):
    rows = [(b, 1) for b in range(12)] + [(b, 2) for b in range(9)]
    assert found(closed_itemsets(spark.createDataFrame(rows, SCHEMA))) == brute(rows, Parameters())


def test_empty_and_none_frequent(spark):
    assert found(closed_itemsets(spark.createDataFrame([], SCHEMA))) == {}
    assert found(closed_itemsets(spark.createDataFrame([(1, 1), (2, 1)], SCHEMA))) == {}


def test_query_over_the_table(spark, tables):
    rows = [(r.sale_id, r.item_id) for r in spark.read.parquet(f"{tables}/sale_lines.parquet").collect()]
    assert found(op13(spark, tables)) == brute(rows, Parameters())


def test_inherited_failures_save_closures():
    """A staircase of nested columns: nearly every extension fails, and the failures are handed down."""
    rows = [list(range(i, 12)) + [20 + j for j in range(4) if i >> j & 1] for i in range(12) for _ in range(3)]
    context = Context(np.array([len(r) for r in rows]), np.array([i for r in rows for i in r]), np.ones(len(rows), np.int64), np.zeros((2, len(rows)), np.int64), 3)
    asked = Counter()
    plain = context.counts

    def counted(own):
        asked["closures"] += 1
        return plain(own)

    context.counts = counted
    sets = [s for s, _ in close_by_one(context, 3)]
    assert len(sets) == len(set(sets))
    every = {frozenset(i for i in set.intersection(*map(set, group))) for k in (1, 2, 3) for group in combinations([tuple(r) for r in rows[::3]], k)}
    assert len(sets) >= len(every) - 1 and asked["closures"] < len(sets) * context.m / 2
