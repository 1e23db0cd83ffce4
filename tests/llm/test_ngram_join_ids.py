"""Repeated and null doc_ids: no text is lost, and one row of each class stays."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import ngram_join
from folioscope.llm.ngram_join import Parameters, join, one_of_each

SCHEMA = "doc_id long, text string"


def words(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def near(text, i):
    out = list(text)
    out[-1] = f"x{i}"
    return " ".join(out)


def test_texts_of_one_id_keep_their_links(spark):
    a, b = words(1), words(2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (7, near(a, 7)), (8, near(b, 8)), (9, near(b, 9))]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in join(spark.createDataFrame(order, SCHEMA)).collect())
        assert got == [(1, 1, 1, 1), (1, 1, 2, 1), (7, 1, 1, 1), (8, 1, 2, 1), (9, 1, 2, 1)]
        kept = sorted((r.doc_id, r.text) for r in one_of_each(spark.createDataFrame(order, SCHEMA)).collect())
        assert kept == sorted(rows[:2])


def test_one_row_of_each_class(spark):
    a, b, c = " ".join(words(3)), " ".join(words(4)), " ".join(words(5))
    rows = [(5, a), (5, a), (5, a), (6, a), (None, b), (None, b), (None, c), (2**40, c), (3, a.upper()), (None, None), (4, "")]
    got = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(3, a.upper()), (None, b), (2**40, c), (4, "")], key=str)


def test_near_texts_of_one_id(spark):
    a = words(6)
    rows = [(5, near(a, 1)), (5, near(a, 2)), (6, near(a, 3)), (5, near(a, 2).upper())]
    assert [r.doc_id for r in one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()] == [5]


def test_a_row_repeated_ten_thousand_times_is_one_text_of_its_block(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "x")
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, near), (9, "other words altogether")], "doc_id long, text string")).repartition(4)
    sizes, plain = [], type(rows).groupBy

    def watched(df, *keys):
        if keys == ("root", "i", "j"):
            sizes.append(df.count())
        return plain(df, *keys)

    monkeypatch.setattr(type(rows), "groupBy", watched)
    out = ngram_join.join(rows)
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in out.collect()}
    assert got == {(7, 7, 1, 10_000), (8, 7, 1, 1), (9, 9, 0, 1)} and out.estimated_recall >= 0.999
    assert sizes and max(sizes) <= 2 + 4  # rows of the blocks: two texts, and one a task at most of the repeated one


def test_rows_of_one_id_and_text_give_way_by_their_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, s) for s in ("b", "a", "c")]
    for part in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if part == 3 else rows, "doc_id long, text string, source string").repartition(part)
        assert [r.source for r in one_of_each(docs).collect()] == ["a"]


def test_a_recall_below_the_target_is_said(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w39", "x"))], "doc_id long, text string")
    with pytest.warns(UserWarning, match="estimated recall"):
        out = join(docs, Parameters(max_depth=8, min_depth=8, target_recall=1.0))
    assert 0 < out.estimated_recall < 1
