import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm.mixing import SQL, TARGET, Parameters, budgets, default_levels, mix, op10


def fill(budget, kids):
    """Reference water-filling: kids is [(weight, capacity)]."""
    left, out, todo = budget, {}, dict(enumerate(kids))
    while todo:
        total = sum(w for w, _ in todo.values())
        full = {i: c for i, (w, c) in todo.items() if left * w >= c * total}
        if not full:
            return [out[i] if i in out else left * kids[i][0] // total for i in range(len(kids))]
        least = min(full, key=lambda i: kids[i][1] / kids[i][0])
        out[least] = kids[least][1]
        left -= kids[least][1]
        del todo[least]
    return [out[i] for i in range(len(kids))]


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 5), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in budgets(leaves, ["domain", "lang", "source"], Parameters(budget_percent=40, max_epochs=1)).collect()}
    # 806 tokens, 403 a domain; y can use 5 of its 201, x takes the rest; source 1 only 10, source 2 the rest of x
    assert got == {"1": 10, "2": 388, "3": 5, "4": 403}
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 20), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in budgets(leaves, ["domain", "lang", "source"], Parameters(budget_percent=50, max_epochs=2)).collect()}
    assert got == {"1": 20, "2": 40, "4": 455}


@pytest.mark.parametrize("budget", [7, 60, 99])
def test_flat_budgets_against_reference(spark, budget):
    caps = [3, 500, 41, 41, 77, 1, 0, 260]
    weights = {str(i): 1 + i % 3 for i in range(8)}
    leaves = spark.createDataFrame([("a", "x", str(i), c) for i, c in enumerate(caps)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in budgets(leaves, ["domain", "lang", "source"], Parameters(({}, {}, weights), budget, 2)).collect()}
    want = fill(sum(caps) * budget // 100, [(weights[str(i)], 2 * c) for i, c in enumerate(caps)])
    assert [got[str(i)] for i in range(8)] == want


def test_prefix_of_each_epoch(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s1" if i % 3 else "s2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = Parameters(({}, {}, {"s2": 9}), 70, 3, 5)
    got = mix(docs, default_levels(docs), how).collect()
    for source in ("s1", "s2"):
        own = [r for r in got if r.source == source]
        total, taken = sum(r.n_tokens for r in own), sum(r.n_tokens * r.epochs for r in own)
        whole = min(r.epochs for r in own)
        order = sorted(own, key=lambda r: hashlib.md5(f"5|{whole}|{r.doc_id}".encode()).hexdigest())
        flags = [r.epochs - whole for r in order]
        assert flags == sorted(flags, reverse=True) and set(flags) <= {0, 1} and taken <= 3 * total
    assert max(r.epochs for r in got if r.source == "s2") >= 1


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (2, "", "en", "a1", 5), (None, "x y", "en", "a1", 5), (3, "x y", "en", "a1", 5), (3, "x y", "en", "a1", 5), (4, "w " * 9000, "en", "a1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epochs int")
    got = mix(docs, default_levels(docs), TARGET)
    assert got.columns.count("epochs") == 1 and got.count() == 6
    assert len({r.epochs for r in got.collect() if r.doc_id == 3}) == 1
    assert mix(docs.limit(0), default_levels(docs)).count() == 0


def test_query_equals_sql(spark, tables):
    got = op10(spark, tables)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tables}/documents.parquet'")
    want = db.execute(SQL).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs").collect())) == sorted(want)
    assert got.agg(F.max("epochs")).first()[0] > 1


@pytest.mark.parametrize("digits", [1, 3])
def test_one_leaf_has_all_rows(spark, monkeypatch, digits):
    """The prefix ends in a bucket of a bucket; brute force over the drawn order."""
    monkeypatch.setattr("folioscope.llm.mixing.HEX", digits)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 3 as int))").alias("text"), F.lit("en").alias("lang"))
    how = Parameters(weights=({},), budget_percent=170, max_epochs=3)
    got = {r.doc_id: r.epochs for r in mix(docs, {"lang": docs["lang"]}, how).collect()}
    total = sum(1 + i % 3 for i in range(30_000))
    whole, left = divmod(total * 170 // 100, total)
    want = dict.fromkeys(range(30_000), whole)
    for i in sorted(want, key=lambda i: hashlib.md5(f"{how.seed}|{whole}|{i}".encode()).hexdigest()):
        left -= 1 + i % 3
        if left < 0:
            break
        want[i] += 1
    assert got == want
