"""The whole pipeline against its stages by brute force, on a small fixture."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

from folioscope.llm import language_id, pii  # noqa: E402

from .test_ngram_join import brute  # noqa: E402


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !", "en", "src0", 7), (10**6 + 1, None, "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(junk)
    assert [len(x) for x in pipeline.STAGES] == [2] * 5
    steps = dict(pipeline.STAGES)

    model = language_id.train(docs)
    kept = steps["language_id"](spark, docs, tables)
    fit = {}
    for r in docs.collect():  # one text at a time
        shares = language_id.infer(model, [r.text or ""])
        fit[r.doc_id] = language_id.fits(model, shares, language_id._counts([r.text or ""]))[0] if shares.any() else -1.0
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in fit.items() if x >= pipeline.LEAST_FIT}
    assert docs.count() - kept.count() == 2

    single = steps["ngram_join"](spark, kept, tables)
    classes = brute([(r.doc_id, r.text) for r in kept.collect()])
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for c, _, _ in classes.values()})

    private = steps["pii"](spark, single, tables)
    assert private.columns == docs.columns and private.count() == single.count()
    old = {r.doc_id: r.text for r in single.collect()}
    for r in private.collect():
        found = pii.entities(old[r.doc_id])
        assert r.n_chars == len(r.text) and (found or r.text == old[r.doc_id])
        assert all(old[r.doc_id][e.begin : e.end] not in r.text for e in found)

    mixed = steps["mixing"](spark, private, tables)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total, taken = private.agg(F.sum(words)).first()[0], mixed.agg(F.sum(words)).first()[0]
    leaves = private.withColumn("n", words).groupBy("lang", "source").agg(F.max("n").alias("longest"))
    short = leaves.agg(F.sum("longest")).first()[0]  # a leaf's prefix ends less than one document before its budget
    assert mixed.columns == docs.columns and 0.6 * total - short < taken <= 0.6 * total

    out = steps["bpe"](spark, mixed, tables).collect()
    ref, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == mixed.count()
    for r in out:
        ids = ref.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark, tables):
    assert pipeline.run(spark, tables).count() > 0
