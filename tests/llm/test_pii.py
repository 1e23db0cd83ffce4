import re

from folioscope.llm.pii import DIGITS, entities, luhn, render, replace, rewrite, surrogate

KEY = b"k"


def kinds(text):
    return [(text[e.begin : e.end], e.kind) for e in entities(text)]


def test_detection():
    assert kinds("Call +1 (017) 555-7713 or 555-123-4567.") == [("+1 (017) 555-7713", "phone"), ("555-123-4567", "phone")]
    assert kinds('a und.34@mail7.example.com, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###') == [("und.34@mail7.example.com", "email"), ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret")]
    assert kinds("152.143.123.131### 4785380592391139$$$ 123-45-6789") == [("152.143.123.131", "ip"), ("4785380592391139", "card"), ("123-45-6789", "ssn")]
    assert kinds("Frau Anna Müller, г-н Петров, Mr. Smith") == [("Anna", "given_f_latin"), ("Müller", "surname_latin"), ("Петров", "surname_cyrillic"), ("Smith", "surname_latin")]
    for clean in ("Version 2.0. of 2024-01-31 at 10:30, 1,000.50 and 4.0.", "Mr. and the", "", None, "a.b.c 1.2.3", "12345 items"):
        assert kinds(clean) == []


def test_formats():
    for kind, value, pattern in (("email", "ab.1@host.example.com", r"[a-z]{2}\.\d@[a-z]{4}\.[a-z]{7}\.com"), ("ip", "10.1.2.3", r"10(\.\d{1,3}){3}"), ("secret", "0a" * 20, "[0-9a-f]{40}"), ("phone", "10175557713", r"1[2-9]\d{9}"), ("card", "4111111111111111", r"4\d{15}")):
        for attempt in range(50):
            s = surrogate(KEY, kind, value, attempt)
            assert re.fullmatch(pattern, s) and s != value
            assert kind != "card" or luhn(s) == 0
    e = entities("x +1 (017) 555-7713")[0]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", render(e, "+1 (017) 555-7713", surrogate(KEY, e.kind, e.canonical, 0)))
    assert surrogate(KEY, "given_f_cyrillic", "инна", 3)[-1] == "а"
    assert surrogate(b"other", "card", "4111111111111111", 0) != surrogate(KEY, "card", "4111111111111111", 0)


def test_table(spark):
    rows = [(i, f"mail a{i % 40}@x.org from 10.0.{i % 7}.{i % 9} phone +1 (017) 555-{7000 + i % 30}") for i in range(200)]
    rows += [(900, "Call 1 017"), (901, None), (902, ""), (None, "Mr. Smith"), (903, "Frau Smith"), (904, "+10175557000 x"), (904, "+10175557000 x"), (905, "no data here")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, spans string")
    got = replace(docs, KEY).collect()
    assert len(got) == len(rows) and docs.columns[:2] == ["doc_id", "text"]
    assert sorted(r.text or "" for r in replace(docs, KEY).collect()) == sorted(r.text or "" for r in got)
    by_id = {r.doc_id: r for r in got}
    maps = {}
    for i, old in rows[:200]:
        for a, b in zip(entities(old), by_id[i].spans):
            new = by_id[i].text[b.begin : b.end]
            assert b.kind == a.kind and maps.setdefault(old[a.begin : a.end], new) == new
    assert len(set(maps.values())) == len(maps) and not set(maps.values()) & set(maps)
    assert by_id[905].text == "no data here" and by_id[901].text is None and by_id[902].text == ""
    assert by_id[903].text.split()[1] == by_id[None].text.split()[1] != "Smith"
    digits = lambda s: [c for c in s if c in DIGITS]  # noqa: E731  one number in two formats
    assert digits(by_id[904].text) == digits(maps["+1 (017) 555-7000"])
    assert replace(docs.limit(0), KEY).count() == 0


def test_small_spaces_stay_distinct(spark):
    """More given names than the list has: later attempts must keep them apart."""
    names = [f"N{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    docs = spark.createDataFrame([(i, f"Frau {n} Meier") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r.text.split()[1] for r in replace(docs, KEY).collect()]
    assert len(set(got)) == 150 and not set(got) & set(names)


def test_planted_values_are_gone(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    for r in replace(docs, KEY).collect():
        found = entities(old[r.doc_id])
        assert r.n_entities == len(found)
        assert all(old[r.doc_id][e.begin : e.end] not in r.text for e in found)
        assert found or r.text == old[r.doc_id]


def test_rewrite_keeps_the_rest():
    text = "a 10.0.0.1 b x@y.org c"
    new, spans = rewrite(text, {(e.kind, e.canonical): surrogate(KEY, e.kind, e.canonical, 0) for e in entities(text)})
    assert new.startswith("a ") and new.endswith(" c") and [new[s["begin"] : s["end"]] for s in spans] == [new.split()[1], new.split()[3]]
