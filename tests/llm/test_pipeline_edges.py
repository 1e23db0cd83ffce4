"""Each stage, and all of them, on nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epochs long, class_id string, lang_pred string, n_tokens string, __id string, __place long, whole string, bucket string, epoch string"
ENGLISH = "the river runs through old villages where people gather every morning before work and trade bread cheese fruit news stories about weather children".split()
SPANISH = "el rio pasa por pueblos viejos donde la gente se junta cada mañana antes del trabajo para cambiar pan queso fruta noticias cuentos sobre lluvia".split()


def words(seed, vocabulary, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def edges(spark):
    copy, long = words(1, ENGLISH, 80), words(2, ENGLISH, 120_000) + " write to jane.doe@example.org"
    rows = [
        (1, copy, "en", "a"),
        (1, copy, "en", "a"),
        (2, copy, "en", "b"),
        (3, None, "en", "a"),
        (4, "", "es", "a"),
        (5, long, "en", "a"),
        (6, words(3, SPANISH, 80), None, None),
        (None, words(4, SPANISH, 90), "es", "b"),
        (8, words(5, SPANISH, 70) + " escriba a jane.doe@example.org", "es", "a"),
    ]
    extra = (7, "x", "y", "z", "w", 9, "a", "b", "c")
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *extra) for i, t, la, s in rows], SCHEMA)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_edges(spark, edges, tmp_path):
    steps = dict(pipeline.STAGES)
    sf = str(tmp_path)

    kept = steps["language_id"](spark, edges, sf)
    assert kept.columns == edges.columns
    assert ids(kept) == [1, 1, 2, 5, 6, 8, None]  # texts without a letter go

    single = steps["ngram_join"](spark, edges, sf)
    assert single.columns == edges.columns
    found = ids(single)
    assert found.count(1) == 1 and 2 not in found and {5, 6, 8, None} <= set(found)

    private = steps["pii"](spark, edges, sf)
    assert private.columns == edges.columns and ids(private) == ids(edges)
    texts = {}
    for r in private.collect():
        texts.setdefault(r.doc_id, r)
        assert (r.n_chars is None) == (r.text is None) and (r.text is None or r.n_chars == len(r.text))
    assert texts[3].text is None and texts[4].text == ""
    assert "jane.doe" not in texts[5].text and "jane.doe" not in texts[8].text
    assert texts[5].text.split()[-1] == texts[8].text.split()[-1]  # one entity, one surrogate

    mixed = steps["mixing"](spark, edges, sf)
    assert {r.whole + r.bucket + r.epoch for r in mixed.collect()} <= {"abc"}
    assert mixed.columns == edges.columns and set(ids(mixed)) <= set(ids(edges))

    coded = {r.doc_id: r.n_tokens for r in steps["bpe"](spark, edges, sf).collect()}
    assert coded[3] == coded[4] == 0 and coded[5] > 120_000 and set(coded) == set(ids(edges))


def test_run_on_edges_and_on_nothing(spark, edges, tmp_path):
    edges.write.parquet(f"{tmp_path}/some/documents.parquet")
    out = ids(pipeline.run(spark, f"{tmp_path}/some"))
    assert set(out) <= {1, 5, 6, 8, None} and out.count(1) <= 2

    edges.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, edges.where("false"), f"{tmp_path}/none").count() == 0
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
