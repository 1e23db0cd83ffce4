import math
import re
from collections import Counter

from pyspark.sql import functions as F

from folioscope.llm.quality_rules import PUNCTUATION, SYMBOLS, Limits, judge, op4, oracle

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed


def jsd(p, q):
    h = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(h(a, b) + h(b, a) for a, b in zip(p, q)) / 2))


def classes(text):
    upper = len(re.findall("[A-Z]", text)) + sum(c.isupper() and not c.isascii() for c in text)
    letters = sum(c.isalpha() for c in text)
    digits, spaces = sum(c in "0123456789" for c in text), sum(c in " \t\n\x0b\f\r" for c in text)
    punctuation, symbols = sum(c in PUNCTUATION for c in text), sum(c in SYMBOLS for c in text)
    out = [upper, letters - upper, digits, spaces, punctuation, symbols]
    return [*out, len(text) - sum(out)]


def brute(rows, limits=Limits()):
    """doc_id -> contract columns, by plain loops."""
    counts, kinds = {}, {}
    for _, text, lang in rows:
        counts.setdefault(lang or "", Counter()).update(w.lower() for w in WORD.findall(text or ""))
        kinds[lang or ""] = [a + b for a, b in zip(kinds.get(lang or "", [0] * 7), classes(text or ""))]
    out = {}
    for i, text, lang in rows:
        text, own = text or "", counts[lang or ""]
        total = sum(own.values())
        common = sorted(w for w, n in own.items() if n >= limits.common_share * total)
        mine = Counter(w.lower() for w in WORD.findall(text))
        n, *rest = base(text)
        kept = not rest[-1]
        if n >= limits.word_guard:
            bins = [mine[w] for w in common]
            shares = [own[w] / total for w in common]
            kept &= jsd([x / n for x in [*bins, n - sum(bins)]], [*shares, 1 - sum(shares)]) <= limits.word_distance
        if len(text) >= limits.char_guard:
            reference = kinds[lang or ""]
            kept &= jsd([x / len(text) for x in classes(text)], [x / sum(reference) for x in reference]) <= limits.char_distance
        out.setdefault(i, []).append((n, *rest, kept))
    return out


def check(got, rows):
    want = brute(rows)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = op4(spark, tables).collect()
    check(got, [(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, None, "en"), (2, "", None), (None, "a b c a b c " * 30, "en"), (3, long, "en"), (3, long, "en"), (4, "x\n \nx\ny\nx", None), (5, "%%% " * 80, "en"), (6, "a b c\x0ba b c", "en")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    check(judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect(), rows)
    assert judge(docs.limit(0)).count() == 0


def test_labels(spark):
    """Of labelled documents, clean ones stay and most others go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judge(docs).join(labels, "doc_id").where(~F.col("base_failed")).collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert not bad or sum(bad) / len(bad) < 0.3


def test_query_equals_sql(spark, tables):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tables}/documents.parquet'")
    assert sorted(map(tuple, op4(spark, tables).collect())) == sorted(db.execute(oracle()).fetchall())


def test_languages_beyond_the_list(spark, tables):
    """Where the common words of all languages are too many for one list, each row's own decide alike; so do 1000 languages."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", F.concat("lang", F.lit("-"), F.col("doc_id") % 250).alias("lang"))
    listed, joined = (judge(docs, Limits(listed_words=n)).select("doc_id", "n_words", "base_failed", "kept", "char_distance", "word_distance") for n in (1 << 20, 0))
    assert docs.select("lang").distinct().count() > 190
    assert listed.exceptAll(joined).count() == joined.exceptAll(listed).count() == 0
