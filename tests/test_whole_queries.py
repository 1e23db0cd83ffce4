"""Queries over whole texts and all rows, against brute force."""

import unicodedata

from folioscope.queries import QUERIES


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def texts_of(spark, tables):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}


def test_fold_reaches_all_rows_and_characters(spark, tables):
    texts = texts_of(spark, tables)
    got = {r.doc_id: r.folded for r in QUERIES["X1_fold"](spark, tables).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}
    assert max(map(len, got.values())) > 4000


def test_excerpt_reaches_deep_matches(spark, tables):
    texts = texts_of(spark, tables)
    got = {r.document_id: r.excerpt for r in QUERIES["F24_excerpt"](spark, tables).collect()}
    at = {i: plain(t).find("license") for i, t in texts.items()}
    assert got == {i: t[max(0, at[i] - 176) :][:360] for i, t in texts.items()}
    deep = [i for i, x in at.items() if x > 360]
    assert deep and all("license" in plain(got[i]) for i in deep)
