import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import katz
from folioscope.llm.katz import Parameters, op3, score


def discounts(n):
    """Good-Turing by its formula, n[0] being the number of bigrams that occur once; half an occurrence off where that gives no share."""
    cut = (len(n) * n[-1] / n[0]) if n[0] else 1
    found = []
    for r, (here, above) in enumerate(zip(n, n[1:]), 1):
        ratio = ((r + 1) * above / here / r - cut) / (1 - cut) if here and cut < 1 else 0
        found.append(ratio if 0 < ratio < 1 else 1 - 0.5 / r)
    return found


class Brute:
    """The model by plain dictionaries."""

    def __init__(self, texts, k=5, delta=0.05):
        self.uni, self.bi, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            words = self.words(t)
            self.uni.update(words)
            for h, w in zip(["<s>", *words], words):
                self.bi[h, w] += 1
                self.after[h].add(w)
        self.hist = Counter()
        for (h, _), n in self.bi.items():
            self.hist[h] += n
        self.whole = sum(self.uni.values()) + len(self.uni) + 1
        of = Counter(self.bi.values())
        self.d = discounts([of[r] for r in range(1, k + 2)])
        self.k, self.delta = k, delta

    @staticmethod
    def words(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return [*re.findall("[^\x20\x09-\x0d]+", low), "</s>"]

    def p1(self, w):
        return (self.uni[w] + 1) / self.whole

    def star(self, h, w):
        r = self.bi[h, w]
        return (r * self.d[r - 1] if r <= self.k else r - self.delta) / self.hist[h]

    def p(self, h, w):
        if not self.hist[h]:
            return self.p1(w)
        if self.bi[h, w]:
            return self.star(h, w)
        missing = 1 - sum(self.star(h, v) for v in self.after[h])
        return missing / (1 - sum(self.p1(v) for v in self.after[h])) * self.p1(w)

    def score(self, text):
        words = self.words(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *words], words)), sum(math.log10(self.p1(w)) for w in words), len(words), sum(self.uni[w] > 0 for w in words)


TEXTS = ["the cat sat on the mat", "The cat ate the rat .", "a b a b a b a b a b a b a b", "on the mat the cat sat", None, "", "xx yy", "xx yy", "x" * 70_000 + " the cat", "É été the cat\x0bsat"]


@pytest.mark.parametrize("share", [1 / 2000, 0.02])
def test_against_brute_force(spark, share):
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(TEXTS * 3)] + [(None, "the rat sat xx zz", False), (50, "zz qq", False), (50, "zz qq", False)]
    model = Brute([t for _, t, train in rows if train])
    got = score(spark.createDataFrame(rows, "id long, text string, trains boolean"), Parameters(hot_share=share, slice_bytes=200)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t, train in rows:
        want[i, train].append(model.score(t))
    for r in got:
        s, b, n, known = want[r.id, r.trains][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, sum(model.uni.values()))
        assert r.score == pytest.approx(s, abs=1e-6) and r.base_score == pytest.approx(b, abs=1e-6)


@pytest.mark.parametrize("rounds, each", [(1, 1), (1, 3), (5, 2)])
def test_rounds_do_not_matter(spark, rounds, each):
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "id long, text string, trains boolean")
    few = {r.id: r for r in score(docs, Parameters(rounds=rounds, buckets_each=each, slice_bytes=100)).collect()}
    for r in score(docs).collect():
        assert (few[r.id].n_tokens, few[r.id].n_known) == (r.n_tokens, r.n_known)
        assert few[r.id].score == pytest.approx(r.score, abs=1e-9) and few[r.id].base_score == pytest.approx(r.base_score, abs=1e-9)


def test_rows_that_move_between_rounds_are_an_error(spark):
    other = F.udf(lambda i: " ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 200))), "string").asNondeterministic()
    docs = spark.range(40).select("id", other("id").alias("text"), F.lit(True).alias("trains"))
    assert score(docs).count() == 40
    with pytest.raises(Exception, match="read alike"):
        score(docs, stable=True).collect()


def test_blocks_do_not_matter(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] * 2
    want = katz.tokens(texts)
    for size in (1, 7, 100):
        monkeypatch.setattr(katz, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(katz.tokens(texts), want))
    assert katz.tokens([])[0].size == 0 and katz.tokens([b"", b" "])[0].tolist() == [int(katz.END)] * 2


def test_probabilities_sum_to_one():
    model = Brute([t for t in TEXTS if t])
    for h in ["<s>", "the", "a", "xx", "cat"]:
        assert sum(model.p(h, w) for w in model.uni) + model.p(h, "never seen") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", False)], "id long, text string, trains boolean")
    r = score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert score(docs.limit(0)).count() == 0


def test_query(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    model = Brute([t for i, t in docs.items() if not held[i]])
    got = op3(spark, tables).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        s, b, n, known = model.score(docs[r.doc_id])
        assert r.held_out == held[r.doc_id] and (r.n_tokens, r.n_known) == (n, known)
        assert r.score == pytest.approx(s, rel=1e-9, abs=1e-6) and r.base_score == pytest.approx(b, rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
