"""Surrogates are distinct over all kinds, as readers see them, and unlike every real entity of any kind."""

from itertools import product

from folioscope.llm.pii import entities, replace, shown, surrogate

KEY = b"k"


def test_what_is_shown():
    same = [("+1 (017) 555-7713", "10175557713"), ("2001:db8::1", "2001:0DB8:0:0:0:0:0:1"), ("٠١٢", "012"), ("ΝΊΚΟΣ", "νίκος")]
    assert all(shown(a) == shown(b) for a, b in same)
    apart = [("10.1.2.3", "10.12.3.1"), ("101.2.3.4", "10.12.3.4"), ("::1", "::2"), ("anna", "hanna")]
    assert all(shown(a) != shown(b) for a, b in apart) and shown("----") == "" == shown("")


def test_real_entity_of_another_kind(spark):
    """What would be drawn first stands in the corpus as an entity of another kind, in another format."""
    phone, name = surrogate(KEY, "phone", "10175557713", 0), surrogate(KEY, "surname_latin", "meier", 0)
    address = surrogate(KEY, "ip", "10.1.2.3", 0)
    rows = ["call +1 (017) 555-7713", f'token = "{phone[:4]}-{phone[4:]}"', "Frau Meier", f"Herr {name.capitalize()} Schulz", "from 10.1.2.3", f'secret = "{address}"']
    got = {r.doc_id: r.text for r in replace(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).collect()}
    assert shown(got[0].removeprefix("call ")) != phone and got[2].split()[1].lower() != name and got[4].split()[1] != address
    assert all(shown(new.split()[-1].strip('"')) not in {phone, name, address} for new in got.values())


def test_surrogates_of_two_kinds(spark):
    """A surname and a given name that would both become Simon, and every pair in a larger corpus."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    given = next(w for w in map("".join, product(letters, repeat=3)) if surrogate(KEY, "given_m_latin", w, 0) == "simon")
    family = next((w for w in map("".join, product(letters, repeat=4)) if surrogate(KEY, "surname_latin", w, 0) == "simon"), None)
    rows = [f"Herr {given.capitalize()} Weber", f"Frau Olga {(family or 'none').capitalize()}"]
    rows += [f"Herr A{a}{b} B{b}{a} and +1 (017) 555-{1000 + 26 * i + j} or u{i}@v{j}.com" for i, a in enumerate(letters[:12]) for j, b in enumerate(letters[:12])]
    got = {r.doc_id: r.text for r in replace(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).collect()}
    maps = {}
    for i, old in enumerate(rows):
        new = {(e.kind, e.canonical): shown(n) for e, n in zip(entities(old), [w for w in seen(old, got[i])], strict=True)}
        for entity, form in new.items():
            assert maps.setdefault(entity, form) == form
    assert family and len(set(maps.values())) == len(maps) and not set(maps.values()) & {shown(c) for _, c in maps}


def seen(old: str, new: str) -> list[str]:
    """The replacements, by the text between the entities."""
    out, at, last = [], 0, 0
    for e in entities(old):
        between = old[last : e.begin]
        if last:
            stop = new.index(between, at)
            out.append(new[at:stop])
            at = stop + len(between)
        else:
            at = len(between)
        last = e.end
    return [*out, new[at : len(new) - len(old[last:]) or None]]
