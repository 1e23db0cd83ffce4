"""Ranking from the stored index against ranking from the text."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ranked, search
from folioscope.sources import postings, snapshots

SCHEMA = "document_id long, ordinal int, content string"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 8)


def chunks(first, n, seed):
    r = random.Random(seed)
    vocabulary = ["casa", "casas", "casado", "Pérez", "perezoso", "luz", "mesa", "río", "de", "la", "el", "y"] + [f"w{i}" for i in range(60)]
    rows = []
    for d in range(first, first + n):
        for o in range(r.choice([1, 1, 2, 3, 20])):
            rows.append((d, o, " ".join(r.choices(vocabulary, weights=[3, 1, 1, 1, 1, 1, 1, 1, 9, 9, 9, 9] + [1] * 60, k=r.randrange(0, 30)))))
        if r.random() < 0.2 and rows:
            rows.append((d, 90, r.choice(rows)[2]))
    return rows


def same(spark, root, rows, question):
    index, text = postings.open_index(spark, root), spark.createDataFrame(rows, SCHEMA)
    for a, b in ((ranked.all_terms, search.all_terms), (ranked.free_text, search.free_text)):
        got, want = ([(r.document_id, r.ordinal, round(r.score, 9)) for r in f(x, question).collect()] for f, x in ((a, index), (b, text)))
        assert got == want
    return got


QUESTIONS = ["casa", "casa perez", "cas per w1 w2 w3", "nada"]


def test_segments_and_their_merge_give_what_the_text_gives(spark, tmp_path, small_blocks):
    root, rows = str(tmp_path), chunks(0, 80, 1)
    postings.add(spark.createDataFrame(rows, SCHEMA), root, "s1")
    for q in QUESTIONS[::3]:
        same(spark, root, rows, q)
    more = chunks(200, 40, 2)
    postings.add(spark.createDataFrame(more, SCHEMA), root, "s2")
    before = [same(spark, root, rows + more, q) for q in QUESTIONS[1:3]]
    postings.merged(spark, root, "whole")
    assert [same(spark, root, rows + more, q) for q in QUESTIONS[1:3]] == before and any(before)
    assert snapshots.read(spark, root).segments == ("whole",)
    with pytest.raises(ValueError):
        postings.add(spark.createDataFrame(more, SCHEMA), root, "whole")


def test_removed_documents_leave_answers_and_counts(spark, tmp_path, small_blocks):
    root, rows = str(tmp_path), chunks(0, 50, 3)
    postings.add(spark.createDataFrame(rows, SCHEMA), root, "s1")
    gone = set(range(0, 50, 3))
    postings.remove(spark, root, spark.createDataFrame([(i,) for i in sorted(gone)], "document_id long"), "gone")
    left = [r for r in rows if r[0] not in gone]
    same(spark, root, left, QUESTIONS[1])
    again = [(0, 0, "casa nueva de pérez")]
    postings.add(spark.createDataFrame(again, SCHEMA), root, "again")
    same(spark, root, left + again, QUESTIONS[1])
    postings.merged(spark, root, "whole")
    same(spark, root, left + again, QUESTIONS[2])
    index = postings.open_index(spark, root)
    stored = {r.term: (r.tf, r.df, r.n_documents) for r in index.terms.collect()}
    want = {r.term: (r.tf, r.df, r.n) for r in search.postings(spark.createDataFrame(left + again, SCHEMA)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.count_distinct("document_id").alias("n")).collect()}
    assert stored == want and index.n == len(left + again)


def test_bounds_hold_and_spare_blocks(spark, tmp_path, small_blocks):
    rows = chunks(0, 400, 5) + [(9000 + i, 0, "w7 " * 6 + "w8") for i in range(20)]
    postings.add(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "s1")
    index = postings.open_index(spark, str(tmp_path))
    terms = ["w7", "w8"]
    idf = ranked._idf(index, ranked.frequencies(index, terms))
    blocks = ranked.bounds(index, terms, idf)
    exact = ranked.scored(index, terms, idf, blocks)
    assert exact.join(blocks, ["segment", "block"]).where("score > impact + 1e-9").count() == 0
    bounded = blocks.where("has0 + has1 = 2").withColumn("bound", 20 + F.col("impact"))
    read = []

    def rank(chosen):
        read.append(chosen.count())
        hits = ranked.scored(index, terms, idf, chosen).where("tf0 > 0 and tf1 > 0")
        return search.best_per_document(hits.withColumn("score", 20 + F.col("score")), [F.desc("score")]).orderBy(F.desc("score"), "document_id").limit(12)

    ranked._best(index, bounded, rank, 12).collect()
    assert read[0] == ranked.PROBE and read[1] < bounded.count()


def test_questions_read_no_text(spark, tmp_path):
    rows = chunks(0, 30, 7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "text"))
    postings.add(spark.read.parquet(str(tmp_path / "text")), str(tmp_path / "index"), "s1")
    index = postings.open_index(spark, str(tmp_path / "index"))
    for answer in (ranked.all_terms(index, "casa de"), ranked.free_text(index, "casa de la mesa")):
        assert answer.inputFiles() and not any("/text/" in f for f in answer.inputFiles())
        plan = answer._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan and "StringStartsWith(term,casa)" in plan.replace(" ", "")


def test_empty_texts_and_an_empty_collection(spark, tmp_path):
    postings.add(spark.createDataFrame([(1, 0, ""), (2, 0, None), (3, 0, "luz")], SCHEMA), str(tmp_path / "a"), "s1")
    index = postings.open_index(spark, str(tmp_path / "a"))
    assert [r.document_id for r in ranked.free_text(index, "luz").collect()] == [3] and index.n == 3
    postings.add(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"), "s1")
    assert ranked.all_terms(postings.open_index(spark, str(tmp_path / "b")), "luz").count() == 0


def test_no_row_a_word_and_documents_over_many_blocks(spark, tmp_path, small_blocks):
    from .test_vocabulary import rows_made

    r = random.Random(4)
    rows = [(d, o, " ".join(f"x{r.randrange(9)}" for _ in range(60))) for d, n in ((1, 30), (2, 1), (3, 3), (4, 17)) for o in range(n)] + [(5, 0, None), (6, 0, "")]
    made = rows_made(spark, lambda: postings.add(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "s1"))
    assert made < 51 * 9
    stored = {x.term: (x.tf, x.df, x.n_documents) for x in postings.open_index(spark, str(tmp_path)).terms.collect()}
    held = {t: [(d, c.split().count(t)) for d, _, c in rows if c and t in c.split()] for t in (f"x{i}" for i in range(9))}
    assert stored == {t: (sum(n for _, n in hits), len(hits), len({d for d, _ in hits})) for t, hits in held.items()}
