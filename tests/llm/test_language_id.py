import numpy as np
from pyspark.sql import functions as F

from folioscope.llm.language_id import Parameters, identify, infer, op2, train, trigrams

EN, FR, DE = ("the weather in this town is often rather pleasant and the people like to walk", "le temps dans cette ville est souvent plutôt agréable et les gens aiment marcher", "das wetter in dieser stadt ist oft recht angenehm und die leute gehen gerne spazieren")


def labelled(spark):
    rows = [(i * 3 + k, f"{t} {i}", lang) for i in range(30) for k, (t, lang) in enumerate(((EN, "en"), (FR, "fr"), (DE, "de")))]
    return spark.createDataFrame([*rows, (None, EN, "xx"), (998, None, "en"), (999, EN, None)], "doc_id long, text string, lang string")


def test_trigrams_stay_in_their_text():
    a, _ = trigrams(["one two"])
    b, owner = trigrams(["zz", "One, two!", "", "İx"])
    assert sorted(a) == sorted(b[owner == 1]) and set(owner) == {0, 1, 3}


def test_mixtures_and_odd_texts(spark):
    model = train(labelled(spark))
    assert model.languages == ["de", "en", "fr"]
    shares = infer(model, [EN, FR, f"{EN} {DE}", "", "123 !?", EN * 900])
    assert np.allclose(shares[[0, 1, 5]], [[0, 1, 0], [0, 0, 1], [0, 1, 0]])
    assert shares[2, 2] == 0 and 0.3 < shares[2, 0] < 0.7 and not shares[3:5].any()
    rows = [(1, None, "a"), (2, "", "b"), (None, "12", "c"), (3, FR, "d"), (3, FR, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = identify(docs, model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0), (3, "fr", 1.0), (3, "fr", 1.0)]
    assert identify(docs.limit(0), model).count() == 0
    empty = train(labelled(spark).limit(0))
    assert [r.lang_pred for r in identify(docs, empty).collect()] == ["und"] * 5


def test_thinning_keeps_every_language(spark):
    model = train(labelled(spark), Parameters(train_docs_per_language=12))
    assert len(model.languages) == 3 and infer(model, [DE]).argmax() == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    rows = op2(spark, path).join(docs, "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


def test_predictions_depend_on_the_text_alone(spark):
    model = train(labelled(spark))
    texts = ["a", "b", "I", "zz", "", EN, "ñ", FR[:9], "ab. c", f"{FR} {DE}", "a"]
    alone = np.concatenate([infer(model, [x]) for x in texts])
    assert np.array_equal(alone, infer(model, texts)) and np.array_equal(alone[::-1], infer(model, texts[::-1]))
    assert all(row.any() == any(c.isalpha() for c in x) for x, row in zip(texts, alone))
    assert [len(trigrams([x])[0]) for x in texts] == [sum(c.isalpha() for c in x) for x in texts]


def brute_force(training, text, how=Parameters()):
    """The documented model in plain Python: hashed trigrams, EM, nested sets by penalised likelihood."""
    from collections import Counter
    from math import exp, log

    def features(x):
        x = f" {''.join(c if c.isalpha() else ' ' for c in x.lower())} "
        found = Counter()
        for i in range(1, len(x) - 1):
            if x[i] != " ":
                a, b, c = (ord(y) for y in x[i - 1 : i + 2])
                h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                found[h >> 16] += 1
        return found

    counts = {}
    for x, lang in training:
        counts.setdefault(lang, Counter()).update(features(x))
    names = sorted(counts)
    sizes = {k: sum(counts[k].values()) + how.smoothing * 65_536 for k in names}
    seen = features(text)
    n = sum(seen.values())
    p = {f: {k: (counts[k][f] + how.smoothing) / sizes[k] for k in names} for f in seen}

    def em(share, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(share, 0.0)
            for f, times in seen.items():
                mass = sum(p[f][k] * share[k] for k in share)
                for k in share:
                    new[k] += times * p[f][k] * share[k] / mass / n
            share = new
        return share, sum(times * log(sum(p[f][k] * share[k] for k in share)) for f, times in seen.items())

    first, _ = em(dict.fromkeys(names, 1 / len(names)), how.iterations)
    ranked = sorted(names, key=lambda k: (-first[k], k))
    best, fit = {ranked[0]: 1.0}, sum(times * log(p[f][ranked[0]]) for f, times in seen.items())
    for size in range(2, sum(first[k] >= how.least_share for k in names) + 1):
        start = {k: first[k] + 1e-6 for k in ranked[:size]}
        share, new = em({k: v / sum(start.values()) for k, v in start.items()}, 5)
        new -= how.penalty * (size - 1) * log(n + 1) / 2
        if new > fit:
            best, fit = share, new
    return [best.get(k, 0.0) for k in names]


def test_against_brute_force(spark):
    rows = [(f"{t} {i}", lang) for i in range(30) for t, lang in ((EN, "en"), (FR, "fr"), (DE, "de"))]
    model = train(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string"))
    texts = [EN, FR[:20], f"{EN} {DE}", f"{DE} {FR} {EN}", "a", "the le das", "xyzzy qqq"]
    assert np.allclose(infer(model, texts), [brute_force(rows, x) for x in texts], atol=1e-4)


def test_too_many_labels(spark):
    docs = spark.createDataFrame([(i, "text", str(i)) for i in range(20)], "doc_id long, text string, lang string")
    try:
        train(docs, Parameters(most_languages=19))
    except ValueError:
        return
    raise AssertionError("twenty labels passed a bound of nineteen")
