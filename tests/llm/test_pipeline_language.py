"""The language stage: what fits no learned language goes, mixtures of learned ones stay."""

import random

import corpus_pipeline as pipeline
from folioscope.llm import language_id


def test_fit_decides(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {}
    for r in docs.where("length(text) > 400").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alien = [
        "天气今天很好我们去公园散步然后回家吃饭看书学习",
        "Сегодня хорошая погода, и мы пошли гулять в парк, а потом вернулись домой",
        "Ο καιρός σήμερα είναι καλός και πήγαμε βόλτα στο πάρκο",
        "Dzisiaj jest bardzo ładna pogoda, więc poszliśmy na spacer do parku, a potem wróciliśmy do domu",
        " ".join("".join(r.choices(letters, k=r.randrange(2, 10))) for _ in range(80)),
        "".join(r.choices(letters + letters.upper() + "0123456789+/", k=600)),
    ]
    mixed = [" ".join(own[i][:300] for own in texts.values()) for i in range(5)]
    mixed += [" ".join(texts[k][i][:300] for k in ("de", "en", "fr")) for i in range(5)]
    rows = [(10**6 + i, t, "en", "src0", len(t)) for i, t in enumerate(alien + mixed)]
    added = spark.createDataFrame(rows, docs.schema)
    model = language_id.train(docs)
    shares = language_id.infer(model, alien + mixed).max(axis=1)
    share = 0.35  # no such rule: the leading share would keep alien texts and drop mixed ones
    assert (shares[: len(alien)] >= share).any() and (shares[len(alien) :] < share).any()
    kept = pipeline.identify_languages(spark, docs.unionByName(added), tables)
    assert {x.doc_id for x in kept.where("doc_id >= 1000000").collect()} == {10**6 + len(alien) + i for i in range(len(mixed))}
    assert kept.where("doc_id < 1000000").count() == docs.count()


def test_short_and_odd_texts(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12"), (4, "the")], "doc_id long, text string")
    got = {r.doc_id: r.fit for r in language_id.identify(odd, model, fit="fit").collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] > pipeline.LEAST_FIT
