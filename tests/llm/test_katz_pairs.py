"""Frequent pairs are evaluated where they occur; no bucket gets them."""

import random
import struct

import numpy as np
import pytest

from folioscope.llm import katz
from folioscope.llm.katz import Parameters, score
from folioscope.llm.ngram_join import U64

from .test_katz import Brute


def corpus(n=300, trained=True):
    r = random.Random(3)
    return [(i, " ".join(["of the"] * r.randrange(0, 12) + r.choices("abcdefgh", k=r.randrange(0, 6))), trained and i % 4 != 1) for i in range(n)] + [(n, None, False), (n + 1, "", True)]


@pytest.mark.parametrize("trained", [True, False])
def test_against_brute_force(spark, tmp_path, trained):
    rows = corpus(trained=trained) + [(1000, "of the " * 30_000, False)]
    model = Brute([t for _, t, train in rows if train])
    got = score(spark.createDataFrame(rows, "id long, text string, trains boolean"), Parameters(hot_share=0.05, slice_bytes=300), keep_bigrams=True, out=f"{tmp_path}/out").collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        s, b, n, known = model.score(texts[r.id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.score == pytest.approx(s, rel=1e-9, abs=1e-6) and r.base_score == pytest.approx(b, rel=1e-9, abs=1e-6)
    table = spark.read.parquet(f"{tmp_path}/out")
    bigrams = table.where("kind = 'bigram'").select("key", "history", "n").collect()
    assert sorted(r.n for r in bigrams) == sorted(model.bi.values()) and len({r[:2] for r in bigrams}) == len(bigrams)
    common = table.where("kind = 'common'").collect()
    assert len({(r.key, r.history) for r in common}) == len(common) and max(r.n_known for r in common) > 30_000


def test_no_bucket_has_them(spark):
    how = Parameters(slice_bytes=300)
    docs = spark.createDataFrame(corpus(), "id long, text string, trains boolean").selectExpr("id", "cast(coalesce(text, '') as binary) as text", "trains")
    of, the = katz.tokens([b"of the"])[0][:2]
    hot = np.sort(np.array([of, the], np.uint64))
    history, word = np.array([of, the, katz.BEGIN], np.uint64), np.array([the, of, of], np.uint64)
    route = katz.route_of(word, history)
    by = np.argsort(route)
    known = katz.Pairs(route[by], word[by], history[by], np.array([9, 9, 9]), np.array([9, 9, 9]))
    bounds, found, dealt = katz.turns(0.5, how.rounds), [], 0
    for turn in range(how.rounds):
        for r in katz.deal(docs, hot, 4, turn, how, bounds, known if turn else None).collect():
            _, mark, n_words, n_pairs, n_docs = struct.unpack_from("<QIIII", r.blob)
            assert 0 <= r.bucket < 4
            if n_docs:
                words, runs = np.frombuffer(r.blob, "<u8", n_words, 24), np.frombuffer(r.blob, "<u4", n_words, 24 + 8 * (n_words + n_pairs))
                found += zip(np.repeat(words, runs).tolist(), np.frombuffer(r.blob, "<u8", n_pairs, 24 + 8 * n_words).tolist())
                dealt += n_docs
    assert found and not set(found) & set(zip(word.tolist(), history.tolist()))
    texts = [(t or "").split() for _, t, _ in corpus()]
    frequent = sum(pair in {("of", "the"), ("the", "of"), ("", "of")} for t in texts for pair in zip(["", *t], t))
    assert dealt == sum(len(t) + 1 for t in texts) - frequent


def test_turns_cover_the_range():
    for rounds in (1, 2, 3, 7):
        for part in (0.0, 0.3, 0.9, 1.0):
            common, rest = katz.turns(part, rounds)
            assert rest[0] == 0 and rest[-1] == 1 << 64 and rest == sorted(rest) and len(rest) == rounds + 1 == len(common)
            assert rounds == 1 or (common[:2] == [0, 0] and common[-1] == 1 << 64 and common == sorted(common))
    assert U64(katz.turns(0.0, 3)[1][1]) // U64(1 << 32) == (1 << 64) // 3 // (1 << 32)
