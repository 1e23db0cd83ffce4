"""The hint lets no text with an entity pass by."""

import unicodedata

from folioscope.llm.pii import entities, hint, replace

KEY = b"k"
ARABIC = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
TEXTS = [
    'password = "correct-horse-battery"',
    "the ToKeN: 'abcdefghij' here",
    'Passwd="abcdefgh" and API_KEY = "abcdefghij"',
    "accesskey : 'abcdefghij'",
    "ſecret = 'abcdefghij'",
    "toKen = 'abcdefghij'",
    'secret = "!!!!????"',
    'secret = "пароль-парольный"',
    "AKIA" + "ABCDEFGHIJKLMNOP",
    "ghp_" + "abcdefghij" * 4,
    "eyJabcdefgh.abcdefgh.abcdefgh",
    "abcdef" * 6,
    "ABCDEF" * 6,
    "to ab:cd:ef:ab:cd:ef:ab:cd now",
    "a@b-host.example",
    "Frau Smith",
    "г-н Петров",
    "Señora. Lopez",
    "call +1 (017) 555-7713".translate(ARABIC),
    "555-123-4567".translate(ARABIC),
    "4785380592391139".translate(ARABIC),
    "123-45-6789".translate(ARABIC),
    "at 12.34.56.78".translate(ARABIC),
    "DE" + "44".translate(ARABIC) + "ABCDEFGHIJKLMNOP",
]


def test_every_entity_matches(spark):
    digits = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Nd"]
    texts = [*TEXTS, *(d * 16 for d in digits)]
    assert all(entities(t) for t in texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in docs.where(~hint()).collect()] == []


def test_all_are_replaced(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in replace(docs, KEY).collect():
        old = TEXTS[r.doc_id]
        assert r.n_entities == len(entities(old)) > 0
        assert all(old[e.begin : e.end] not in r.text for e in entities(old))


def test_one_number_in_two_scripts(spark):
    number = "555-123-4567"
    docs = spark.createDataFrame([(1, f"call {number}"), (2, f"call {number.translate(ARABIC)}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in replace(docs, KEY).collect()}
    assert got[1].translate(ARABIC) == got[2] and number not in got[1]
