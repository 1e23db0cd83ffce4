"""Entities are taken whole: all words of a name, all spellings of an IPv6 address."""

from folioscope.llm.pii import entities, hint, replace

ADDRESSES = ["2001:db8::1", "::1", "fe80::", "dead::beef", "2001:DB8::A:0:1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:0db8:0000:0000:0000:0000:0000:0001", "ab:cd:ef:ab:cd:ef:ab:cd"]


def found(text):
    return [(text[e.begin : e.end], e.kind) for e in entities(text)]


def test_names_have_all_words():
    assert found("Mr Jan Peter Paul Schmidt went") == [("Jan", "given_m_latin"), ("Peter", "given_m_latin"), ("Paul", "given_m_latin"), ("Schmidt", "surname_latin")]
    assert [x for x, _ in found("Frau Anna Eva Maria Luise von")] == ["Anna", "Eva", "Maria", "Luise"]


def test_addresses_in_all_forms():
    for a in ADDRESSES:
        assert found(f"at {a}, now") == [(a, "ip6")], a
    for clean in ("a :: b", "std::vector", "x ::", "10:30:15", "1::2::3", "1:2:3:4:5:6:7:8::9", "::12345"):
        assert "ip6" not in [k for _, k in found(clean)], clean


def test_addresses_are_replaced(spark):
    docs = spark.createDataFrame([(i, f"at {a}, now") for i, a in enumerate(ADDRESSES)], "doc_id long, text string")
    assert docs.where(~hint()).count() == 0
    got = {r.doc_id: r.text for r in replace(docs, b"k").collect()}
    for i, a in enumerate(ADDRESSES):
        new = got[i][3:-5]
        assert new != a and found(got[i]) == [(new, "ip6")] and new.count(":") == a.count(":") and new.isupper() == a.isupper()
    assert entities(got[0])[0].canonical == entities(got[7])[0].canonical  # two spellings of one address


def test_few_short_addresses_end(spark):
    docs = spark.createDataFrame([(i, f"at ::{i:x}, now") for i in range(1, 16)], "doc_id long, text string")
    got = [r.text for r in replace(docs, b"k").collect()]
    assert len(set(got)) == 15
