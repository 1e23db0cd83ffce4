import random
import re

from folioscope.llm.graph import components
from folioscope.llm.ngram_join import Parameters, join, one_of_each, trie

SCHEMA = "doc_id long, text string"


def shingles(text, n=5):
    words = tuple(re.findall(r"[^\W_]+", (text or "").lower()))
    if not words:
        return words, frozenset()
    return words, frozenset(words[i : i + n] for i in range(len(words) - n + 1)) or frozenset([words])


def brute(rows, t=0.8):
    """doc_id -> (class, links, copies) by comparing all pairs of different texts."""
    kinds = {}
    for i, text in rows:
        kinds.setdefault(shingles(text)[0], []).append(i)
    sets = {w: shingles(" ".join(w))[1] for w in kinds}
    near = {w: [v for v in kinds if v != w and sets[w] and sets[v] and len(sets[w] & sets[v]) * 1000 >= t * 1000 * len(sets[w] | sets[v])] for w in kinds}
    out, done = {}, set()
    for w in kinds:
        if w in done:
            continue
        todo, group = [w], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        done |= group
        least = min(i for x in group for i in kinds[x])
        for x in group:
            for i in kinds[x]:
                out[i] = (least, len(near[x]), len(kinds[x]))
    return out


def corpus(seed=3, n=260):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            words = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 30, 80, 300])))
        rows.append((i * 3 + 1, text if r.random() < 0.8 else text.upper() + " ..."))
    return rows


def as_map(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in df.collect()}


def test_against_brute_force(spark):
    rows = corpus()
    assert as_map(join(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_group_in_many_blocks(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "quite another short text") for i in range(5)]
    got = as_map(join(spark.createDataFrame(rows, SCHEMA), Parameters(block_docs=16, block_shingles=3000)))
    assert got == brute(rows)


def test_table(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert as_map(join(spark.read.parquet(f"{tables}/documents.parquet"))) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (8, "...", 3), (None, "one two", 4), (None, "One, two!", 5), (9, "one two", 6), (9, "one two", 6), (2, "word " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_links int")
    got = join(docs).collect()
    assert len(got) == 8 and all(r.n_links == 0 for r in got)
    assert {r.class_id for r in got if r.doc_id in (3, 5, 8)} == {3}
    assert len({r.class_id for r in got if r.n_copies == 4}) == 1
    assert join(docs.limit(0)).count() == 0
    assert one_of_each(docs).columns == docs.columns
    assert {r.doc_id for r in one_of_each(docs.where("doc_id is not null")).collect()} == {2, 3, 9}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def groups(pairs, nodes):
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_trie_finds_every_prefix_group(spark):
    """At each depth, sorted neighbours connect just what shares a prefix of some tree; one prefix is very common."""
    r = random.Random(4)
    how, nodes = Parameters(trees=3), range(120)
    values = {i: [[7 if i % 3 == 0 and k < 6 else r.randrange(1, 4) for k in range(8)] for _ in range(3)] for i in nodes}

    def words(tree, v):
        pack = lambda part: sum(x << 14 * (3 - k) for k, x in enumerate(part))
        return tree << 56 | pack(v[:4]), pack(v[4:])

    rows = [(i, *map(list, zip(*(words(t, v) for t, v in enumerate(values[i]))))) for i in nodes]
    edges = [tuple(x) for x in trie(spark.createDataFrame(rows, "node long, first array<long>, second array<long>"), how).collect()]
    for depth in range(how.min_depth, 9):
        share = [(a, b) for a in nodes for b in range(a) if any(values[a][t][:depth] == values[b][t][:depth] for t in range(3))]
        assert groups([e[:2] for e in edges if e[2] >= depth], nodes) == groups(share, nodes), depth


def test_prefixes_are_shortened(spark):
    """Few trees: full paths miss links; the estimate on the data shortens until the target is met."""
    rows = corpus(seed=9)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sum(x[1] for x in brute(rows).values())
    links = lambda how: sum(r.n_links for r in join(docs, how).collect())
    full = links(Parameters(trees=2, min_depth=8))
    short = links(Parameters(trees=2, min_depth=1))
    assert full < 0.9 * want < 0.99 * want <= short <= want
    assert 0.996 < Parameters().found(0.8, 8) < 0.999 < Parameters().found(0.8, 7)
