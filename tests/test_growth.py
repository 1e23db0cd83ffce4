"""Steps whose memory or time grew too fast, against brute force on small inputs."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import aggregate, near, relations, scope, search
from folioscope.queries import QUERIES, SQL
from folioscope.sources import files
from folioscope.sources.tables import orders_corpus

ODD = ["Thea", "ver THÉA.", "xthea", "theatro", "a-thea_b", "\U0001d400thea", "\U0001f600thea", "1thea", "dos luces", "luz", "lucesita", "the", "thes", "machinery", "M\u00e1chinery 1", "machinery/x", "the machinery", "themachinery", "", "  ", None]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_leave_python_in_small_batches(monkeypatch):
    monkeypatch.setattr(files, "BATCH_CHARS", 5000)
    texts = [("palabra " * 30 + "\n") * (i % 40) for i in range(60)] + [None, "", " \n ", "x" * 9000, "ñ\r\n" * 4000]
    schema = pa.schema([("document_id", pa.int64()), ("text", pa.string())])
    made = list(files.chunk_batches(pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 50, len(texts)))), pa.array(texts[a : a + 50], pa.string())], schema=schema) for a in range(0, len(texts), 50)))
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert got == [(i, c["ordinal"], c["location"], c["content"]) for i, t in enumerate(texts) for c in files.chunks_of(t or "")]
    assert len(made) > 20 and all(sum(map(len, b.column(3).to_pylist()[:-1])) <= 5000 for b in made) and not list(files.chunk_batches([]))


@pytest.mark.parametrize("terms", [["thea"], ["luz"], ["the"], ["thea", "ver"], ["lucez"], ["a-th"], [""], []])
def test_terms_are_found_as_word_by_word(spark, terms):
    slow = F.lit(True)
    for t in terms:
        slow = slow & F.exists(text.words("x"), text._matches(t, 4))
    rows = spark.createDataFrame([(x,) for x in ODD], "x string").select("x", text.holds_terms("x", terms).alias("a"), slow.alias("b"))
    assert [r.x for r in rows.where("a").collect()] == [r.x for r in rows.where("b").collect()]
    assert terms != ["thea"] or "lambda" not in plan_of(rows.select("a"))


def test_records_of_a_member_are_one_row_and_items_are_not_sorted_for_their_currency(spark, tables):
    c = orders_corpus(spark, tables)
    members = scope.with_filters(c.documents, c.values, [("Segmento", "BUILDING")])
    found = scope.members_stating(members, c.values, "Precio").select("document_id")
    plan = plan_of(found)
    assert "Aggregate [document_id" in plan and "shuffle_hash" in plan
    items = {r.l_orderkey for r in spark.read.parquet(f"{tables}/lineitem.parquet").select("l_orderkey").collect()}
    assert sorted(r.document_id for r in found.collect()) == sorted(r.document_id for r in members.collect() if r.document_id in items)


@pytest.mark.parametrize("phrase", ["machinery", "the Machinery", "théa", "", "chinery", "-"])
def test_phrases_are_looked_for_where_they_can_be(spark, phrase):
    made = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "document_id int, x string")
    words = text.exactly("x")
    rows = made.select("x", text.holds_phrase("x", phrase).alias("a"), F.concat(F.lit(" "), words, F.lit(" ")).contains(f" {text.exact(phrase)} ").alias("b"), (~words.contains(text.exact(phrase)) | text.may_hold("x", phrase)).alias("c")).collect()
    assert all((r.a, r.c) == (r.b, None if r.x is None else True) for r in rows)
    found = {r.document_id for r in search.metadata_hits(made.select("document_id", F.col("x").alias("title"), F.lit("").alias("origin")), phrase, False).where("score = 130").collect()}
    assert found == {r.document_id for r in made.where(words.contains(text.exact(phrase))).collect()}


@pytest.mark.parametrize("op", ["sum", "count", "min", "average"])
def test_categories_need_no_join_with_the_scope(spark, op):
    r = random.Random(3)
    facts = [(r.randrange(30), r.choice(["money", "number"]), r.choice([None, Decimal(r.randrange(99))]), r.choice([None, "USD", "MXN"]), r.random() < 0.9) for _ in range(45)]
    values = spark.createDataFrame(facts, "document_id long, value_type string, numeric decimal(24,4), currency string, reliable boolean")
    docs = spark.createDataFrame([(d,) for d in range(3, 40)], "document_id long")
    found = aggregate.compute_category(values, docs, "money", op)
    assert "Join" not in plan_of(found)
    own = {d: [f for f in facts if f[0] == d and f[1] == "money"] for d in range(3, 40)}
    single = [rows[0] for rows in own.values() if len(rows) == 1]
    account = (37, sum(not x for x in own.values()), sum(len(x) > 1 for x in own.values()), len(single))
    got = found.collect()
    assert {(x.n_scope, x.n_none, x.n_several, x.n_calculated) for x in got} == {account}
    if op == "count":
        assert [(x.value, x.n_values, x.n_documents) for x in got] == [(len(single), len(single), len(single))] and "currency" not in found.columns
    else:
        by = {}
        for f in single:
            if f[2] is not None:
                by.setdefault(f[3], []).append(f[2])
        of = {"sum": sum, "min": min, "average": lambda x: round(float(sum(x)) / len(x), 4)}[op]
        assert {x.currency: (round(float(x.value), 4), x.n_values, x.n_documents) for x in got} == {k: (float(of(x)), len(x), len(x)) for k, x in by.items()}
    none = aggregate.compute_category(values, docs.limit(0), "money", op).collect()
    assert len(none) == 1 and none[0].n_scope == none[0].n_calculated == 0 and none[0].value == (0 if op == "count" else None)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_keys_of_near_values_are_rows_of_their_own(spark, most):
    r = random.Random(4)
    texts = ["", "a", "aa", "aab", "aaab", "abab", "baba", "\U0001d400\U0001d400b", "\U0001d400b", "\u00f1\u00f1", None] + ["ab" * 11 + "c" * n for n in range(1, 6)] + ["".join(r.choices("ab", k=n)) for n in (24, 25, 26, 27, 60)]
    asked = texts + [x[:i] + x[i + 1 :] for x in texts if x for i in {0, len(x) // 2}] + [x + "a" for x in texts if x]
    frame = lambda rows: spark.createDataFrame([(g, x) for x in rows for g in (1, None)], "g int, text string")
    want = {(1, a, b, d) for a in asked for b in texts if None not in (a, b) and (d := edits(a, b)) <= most}
    for hint in ("shuffle_hash", "broadcast"):
        found = near.near(frame(asked), frame(texts), ["g"], most, hint)
        got = [(x.g, x.asked, x.text, x.distance) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    made = near.keyed(frame(texts).where("g = 1").distinct(), "text", most, False)
    assert "lambda" not in plan_of(made) and not made.where("text is null").count()
    if most == 1:
        assert made.count() == made.distinct().count()


def test_near_values_are_read_once_and_their_keys_not_sorted(spark):
    found = QUERIES["F16_misspelled"](spark, "/root/testdata/sf0.001")
    assert found.count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert "lambda" not in final and "Sort [" not in final and final.count("FileScan parquet [o_orderkey") == 1


def test_every_value_is_asked_for_with_either_slip(spark):
    found = QUERIES["F16_misspelled"](spark, "/root/testdata/sf0.001")
    values = orders_corpus(spark, "/root/testdata/sf0.001").values.where("value_type = 'text'").select("concept", "literal_value").distinct().collect()
    slips = {(c, x[: len(x) // 2] + x[len(x) // 2 + 1 :]) for c, x in values} | {(c, x + "s") for c, x in values}
    assert {(r.concept, r.asked) for r in found.collect()} == slips and len({c for c, _ in slips}) == 3
    assert "right(" not in SQL["F16_misspelled"] and SQL["F16_misspelled"].count("where") == 1


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_dossiers_meet_in_rounds_that_are_written(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(relations, "HOT", hot, raising=False)
    r = random.Random(8)
    texts = {"Folio": ["OC-1", "oc 1", "OC-2", "OC-3", None], "Gu\u00eda": ["G-9", "g9", "OC-1", "sin"], "Monto": ["5", "6.0", None, ""], "Estado": ["Alta", "alta", "Baja"]}
    facts = [(d, c, x, None if x is None else x.lower(), r.random() < 0.9) for d in range(24) for c in texts for x in r.choices(texts[c], k=r.choice([0, 1, 1, 2, 3]))] + [(99, "Solo", "x", "x", True)]
    spark.createDataFrame(facts, "document_id long, concept string, text_value string, literal_value string, reliable boolean").write.parquet(str(tmp_path / "values"))
    found = relations.all_dossiers(spark.read.parquet(str(tmp_path / "values")))
    plan = plan_of(found)
    assert "text_value" not in plan and "Join" not in plan and "Aggregate" not in plan
    stated = {(d, c): [f for f in facts if f[:2] == (d, c)] for d, c, *_ in facts}
    linked = {}
    for d, c, x, *_ in facts:
        if x and (k := text.identifier(x)):
            linked.setdefault((c, k), set()).add(d)
    want = set()
    for (field, key), docs in linked.items():
        for c in {f[1] for f in facts} if len(docs) > 1 else ():
            own = [stated[d, c] for d in docs if (d, c) in stated]
            single = [{f[3] for f in rows} - {None} for rows in own]
            values = {v for x in single if len(x) == 1 for v in x}
            want.add((field, key, c, len(docs), len(own), len(values), sum(len(x) != 1 for x in single), len(docs) - len(own), len(values) > 1, all(f[4] for rows in own for f in rows)))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(x[6] for x in want) and any(x[7] for x in want)
    assert not relations.all_dossiers(spark.read.parquet(str(tmp_path / "values")).limit(0)).count()
