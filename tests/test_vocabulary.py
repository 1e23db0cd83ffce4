"""Near values, phrases of questions, identifiers in texts, contradictions over everything: against brute force."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import near, phrases
from folioscope.operators import relations as rel
from folioscope.sources import identifiers

from .test_index_versions import VALUES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_finds_every_pair_of_any_length(spark):
    r = random.Random(2)
    known = {"".join(r.choices("abc", k=r.choice([0, 1, 2, 3, 5, 8]))) for _ in range(60)}
    known |= {"".join(r.choices("abcdefgh ", k=n)) for n in (23, 24, 25, 26, 27, 28, 40, 90) for _ in range(3)}

    def slip(x):
        for _ in range(r.randrange(4)):
            at = r.randrange(len(x) + 1)
            x = r.choice([x[:at] + x[at + 1 :], x[:at] + "b" + x[at:], x[:at] + "c" + x[at + 1 :]])
        return x

    asked = {slip(x) for x in known for _ in range(2)}
    group = lambda x: len(x) % 2 if len(x) < 20 else 0
    left = spark.createDataFrame([(group(x), x) for x in asked] + [(0, None)], "g int, text string")
    right = spark.createDataFrame([(g, x) for x in known for g in (0, 1)], "g int, text string")
    for most in (1, 2):
        got = [(x.g, x.asked, x.text, x.distance) for x in near.near(left, right, ["g"], most).collect()]
        want = {(group(a), a, b, d) for a in asked for b in known if (d := distance(a, b)) <= most}
        assert len(got) == len(set(got)) and set(got) == want and any(len(a) > 30 for _, a, _, d in want if d)


def rows(spark, facts):
    made = [(d, c, 1, "money" if x.isdigit() else "text", x, text.fold(x), Decimal(x) if x.isdigit() else None, None, None, None, "x", sure) for d, c, x, sure in facts]
    return spark.createDataFrame(made, VALUES)


def test_respelled_takes_the_nearest_sure_value(spark):
    values = rows(spark, [(1, "Ciudad", "Mérida", True), (2, "Ciudad", "Merida", True), (3, "Ciudad", "Meridas", False), (4, "Ciudad", "Lima", False), (5, "Otra", "Meridas", False)])
    got = {(r.document_id, r.literal_value) for r in near.respelled(values).collect()}
    assert got == {(1, "merida"), (2, "merida"), (3, "merida"), (4, "lima"), (5, "meridas")}


def test_questions_take_the_longest_phrases_and_pin_one_document(spark):
    values = rows(spark, [(1, "Obra", "Puente Norte", True), (1, "Ciudad", "León", True), (2, "Obra", "Puente Norte", True), (2, "Ciudad", "Lima", True), (3, "Obra", "Norte", True), (3, "Lugar", "León", True), (4, "Nota", "uno dos tres cuatro cinco seis siete ocho nueve", True)])
    texts = ["¿Cómo va el puente norte de León?", "el PUENTE, norte", "norte", "nada", None, "de lima, lima y puente norte", "uno dos tres cuatro cinco seis siete ocho nueve"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")
    spans = phrases.covered(phrases.mentioned(questions, values))
    got = {(r.question_id, r.phrase, r.concept) for r in spans.collect()}
    assert got == {(0, "puente norte", "Obra"), (0, "leon", "Ciudad"), (0, "leon", "Lugar"), (1, "puente norte", "Obra"), (2, "norte", "Obra"), (5, "lima", "Ciudad"), (5, "puente norte", "Obra")}
    answers = {r.question_id: (r.document_id, r.score, r.n_anchors, r.n_tied) for r in phrases.pinned(questions, values).collect()}
    assert answers == {0: (1, 2005, 2, 1), 1: (None, 1003, 1, 2), 2: (3, 1002, 1, 1), 5: (2, 2005, 2, 1)}


def test_overlapping_spans_stay_and_inner_ones_go(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 0, 2), (1, 1, 3), (1, 2, 5), (1, 4, 5), (1, 6, 7), (2, 0, 1)], "question_id long, begin int, end int")
    assert {tuple(r) for r in phrases.covered(spans).collect()} == {(1, 0, 3), (1, 2, 5), (1, 6, 7), (2, 0, 1)}


def test_identifiers_in_texts(spark, tmp_path):
    texts = [(1, "ver OC-2024/00_1, y oc2024001."), (2, "OC-2024/0010 v2"), (3, "sólo palabras 123 1.5"), (4, None), (5, ""), (6, "ÑÚ-7x " * 2000 + "x9")]
    identifiers.save(spark.createDataFrame(texts, "document_id long, content string"), str(tmp_path))
    find = lambda *a: {(r.document_id, r.score) for r in identifiers.find(spark, str(tmp_path), *a).collect()}
    assert find("oc 2024 001") == {(1, 140)} and find("OC-2024001", "prefix") == {(1, 140), (2, 130)} and find("c2024/0", "contains") == {(1, 130), (2, 130)}
    assert find("ñú7X") == {(6, 140)} and find("x9", "contains") == {(6, 140)} and find("7x", "contains") == {(6, 130)} and find("palabras") == set() and find("zz9", "contains") == set()
    plan = identifiers.find(spark, str(tmp_path), "OC-2024001", "prefix")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(identifier,oc2024001)" in plan


def test_contradictions_and_dossiers_over_all_keys_and_fields(spark):
    facts = [(1, "OC", "OC-1", True), (2, "OC", "oc 1", True), (3, "OC", "OC1", False), (1, "Estado", "Autorizada", True), (2, "Estado", "Cancelada", True), (3, "Estado", "Cancelada", True), (1, "Monto", "5", True), (2, "Monto", "5", True), (3, "Monto", "6", False), (3, "Monto", "7", True)]
    facts += [(4, "OC", "OC-2", True), (4, "Estado", "Firme", True), (5, "Guía", "G-9", True), (6, "Guía", "G-9", True), (5, "Estado", "Alta", True), (6, "Estado", "Alta", True), (5, "OC", "OC-7", True), (6, "OC", "OC-8", True)]
    values = rows(spark, facts)
    got = {(r.key_field, r.key, r.concept, r.n_values, r.n_documents, r.low, r.high) for r in rel.all_contradictions(values).collect()}
    assert got == {("OC", "oc1", "Estado", 2, 3, "autorizada", "cancelada"), ("Guía", "g9", "OC", 2, 2, "oc-7", "oc-8")}
    cells = {(r.key, r.concept): (r.n_linked, r.n_documents, r.n_values, r.n_several, r.n_gaps, r.conflict, r.reliable) for r in rel.all_dossiers(values).collect()}
    assert cells == {
        ("oc1", "OC"): (3, 3, 3, 0, 0, True, False), ("oc1", "Estado"): (3, 3, 2, 0, 0, True, True), ("oc1", "Monto"): (3, 3, 1, 1, 0, False, False), ("oc1", "Guía"): (3, 0, 0, 0, 3, False, True),
        ("g9", "OC"): (2, 2, 2, 0, 0, True, True), ("g9", "Estado"): (2, 2, 1, 0, 0, False, True), ("g9", "Monto"): (2, 0, 0, 0, 2, False, True), ("g9", "Guía"): (2, 2, 1, 0, 0, False, True),
    }


def test_one_key_on_a_third_of_the_documents(spark):
    """The documents of a hot key are counted by value before they meet."""
    values = spark.range(3000).select(F.col("id").alias("document_id"), F.explode(F.array(F.struct(F.lit("OC").alias("concept"), F.when(F.col("id") % 3 == 0, "OC-0").otherwise(F.concat(F.lit("OC-"), "id")).alias("text_value")), F.struct(F.lit("Estado").alias("concept"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text_value")))).alias("v"))
    values = values.select("document_id", "v.*", F.lower("v.text_value").alias("literal_value"), F.lit(True).alias("reliable"))
    assert [tuple(r) for r in rel.all_contradictions(values).collect()] == [("OC", "oc0", "Estado", 2, 1000, "a", "b", True)]


def test_conditions_in_plain_words(spark):
    rows = [("Estado", "state", "activo"), ("Estado", "state", "cerrado"), ("Zona", "text", "san pedro"), ("Barrio", "text", "san pedro"), ("Zona", "text", "norte"), ("Ciudad", "text", "villa nueva"), ("Pagado", "text", "si"), ("Pagado", "text", "no"), ("Estado civil", "text", "soltero"), ("Monto", "money", "10"), ("Nota", "text", "monto")]
    values = spark.createDataFrame(rows, "concept string, value_type string, literal_value string")
    asked = [
        (1, "¿Cuál es el monto de los que tienen Estado activo?"),  # the note that says monto is the field's name
        (2, "los cerrado en Villa Nueva"),
        (3, "cuántos hay en San Pedro"),
        (4, "pagado de la zona San Pedro"),
        (5, "monto sin pagado, con zona, norte"),
        (6, "monto del estado civil"),  # holds the name of another field
        (7, "monto y ciudad"),
        (8, None),
        (9, ""),
        (1, "¿Cuál es el monto de los que tienen Estado activo?"),
    ]
    got = phrases.inferred_filters(spark.createDataFrame(asked, "question_id int, text string"), values)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            (1, "Monto", None, "asked"), (1, "Estado", "activo", "explicit"),
            (2, "Estado", "cerrado", "implicit"), (2, "Ciudad", "villa nueva", "implicit"),
            (3, "Zona", "san pedro", "ambiguous"), (3, "Barrio", "san pedro", "ambiguous"),
            (4, "Pagado", "si", "binary"), (4, "Zona", "san pedro", "explicit"),
            (5, "Monto", None, "asked"), (5, "Pagado", "no", "binary"), (5, "Zona", "norte", "explicit"),
            (6, "Monto", None, "asked"), (6, "Estado civil", None, "unapplied"),
            (7, "Monto", None, "asked"), (7, "Ciudad", None, "unapplied"),
        ],
        key=str,
    )
    empty = spark.createDataFrame([], "question_id int, text string")
    assert phrases.inferred_filters(empty, values).count() == 0


def rows_made(spark, action):
    """The most rows that any step of the plans makes which the action runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    most, every = 0, store.executionsList()
    for i in range(before, every.size()):
        number = every.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            found = (node.metrics().apply(k) for k in range(node.metrics().size()))
            most = max([most, *[int(values.apply(m.accumulatorId()).replace(",", "")) for m in found if m.name() == "number of output rows" and values.contains(m.accumulatorId())]])
    return most


def test_questions_of_one_wording_are_answered_once(spark):
    values = spark.createDataFrame([("Estado", "state", "activo"), ("Zona", "text", "norte"), ("Monto", "money", "10")], "concept string, value_type string, literal_value string")
    n, said = 400, ["monto de los de Zona norte con Estado activo", "los activo", "nada", "zona"]
    asked = spark.createDataFrame([(i, said[i % 4]) for i in range(n)] + [(1, said[1]), (n, None)], "question_id int, text string")
    got = []
    assert rows_made(spark, lambda: got.extend(phrases.inferred_filters(asked, values).collect())) < 3 * n
    want = {(i, *r) for i in range(n) for r in ([("Monto", None, "asked"), ("Zona", "norte", "explicit"), ("Estado", "activo", "explicit")], [("Estado", "activo", "implicit")], [], [("Zona", None, "asked")])[i % 4]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pinned_is_what_all_documents_score(spark):
    r = random.Random(8)
    for n_docs, sizes in ((25, (3, 6, 9)), (6, (4, 30, 30))):
        facts = [(d, c, f"{c[0].lower()}{r.randrange(k)}" + (" x" if r.random() < 0.3 else ""), True) for d in range(n_docs) for c, k in zip(("Alfa", "Beta", "Gama"), sizes) if r.random() < 0.8]
        said = sorted({x for *_, x, _ in facts} | {"b99"})
        asked = [(i, ", ".join(r.choices(said, k=r.choice([1, 2, 3, 5])))) for i in range(80)]
        stated = {d: {x for e, _, x, _ in facts if e == d} for d in range(n_docs)}
        spelled = {x for xs in stated.values() for x in xs}
        want = {}
        for i, q in asked:
            anchors = {x for x in q.split(", ") if x in spelled} - {x for x in spelled if f"{x} x" in q.split(", ") and x not in q.split(", ")}
            anchors |= {x[:-2] for x in q.split(", ") if x.endswith(" x") and x not in spelled and x[:-2] in spelled}
            scores = {d: sum(1001 + len(x.split()) for x in anchors & own) for d, own in stated.items()}
            best = max(scores.values())
            tied = [d for d, s in scores.items() if s == best]
            if anchors:
                want[i] = (tied[0] if len(tied) == 1 else None, best, len(anchors), len(tied))
        # A phrase that lies in a longer one is no anchor there, but it is where it stands alone.
        got = phrases.pinned(spark.createDataFrame(asked, "question_id long, text string"), rows(spark, facts))
        assert {x.question_id: (x.document_id, x.score, x.n_anchors, x.n_tied) for x in got.collect()} == want


def test_pinned_scores_no_document_for_a_common_value_alone(spark):
    n = 300
    values = rows(spark, [(d, "Folio", f"f{d}", True) for d in range(n)] + [(d, "Clase", "comun", True) for d in range(n)])
    asked = spark.createDataFrame([(d, f"f{d} comun") for d in range(n)], "question_id long, text string")
    assert rows_made(spark, lambda: phrases.pinned(asked, values).collect()) < 10 * n


def test_fields_across_read_their_rows_once(spark, tmp_path):
    from folioscope.operators import aggregate

    r = random.Random(5)
    facts = [(r.randrange(9), c, r.choice(["a", "b", None][: k + 1]), True) for k, c in enumerate(("Uno", "Dos", "Tres")) for _ in range(7 + 9 * k)] + [(d, "Todos", "x", True) for d in range(9)] + [(1, "Nada", None, True)]
    made = spark.createDataFrame([(d, c, x) for d, c, x, _ in facts], "document_id long, concept string, literal_value string")
    found = aggregate.fields_across(made)
    of = {c: [(d, x) for d, e, x, _ in facts if e == c] for c in {f[1] for f in facts}}
    want = {(c, len({d for d, _ in rows}), len({x for _, x in rows if x}), 9, len({x for _, x in rows if x}) == 1 and len({d for d, _ in rows}) == 9) for c, rows in of.items()}
    assert {tuple(x) for x in found.select("concept", "n_documents", "n_distinct", "n_read", "common").collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan and not aggregate.fields_across(made.limit(0)).count()


def test_keys_are_found_once(spark, tmp_path):
    rows(spark, [(1, "Folio", "OC-1", True), (2, "Folio", "oc 1", True), (1, "Estado", "F", True), (2, "Estado", "P", True), (3, "Folio", "12.5", True)]).write.parquet(str(tmp_path / "values"))
    found = rel.all_contradictions(spark.read.parquet(str(tmp_path / "values")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "text_value" in line for line in plan.splitlines()) == 1
    assert [(r.key_field, r.key, r.concept, r.n_values, r.low, r.high) for r in found.collect()] == [("Folio", "oc1", "Estado", 2, "f", "p")]
    texts = ["OC-1", "oc 1", "12.5", "", None, "a", "ÑÚ-7x", "a_1!", "Ⅷ-a", "x-٣", "--", "F 1 / 2"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", text.identifier_of("x").alias("k")).orderBy("i").collect()
    assert [r.k for r in got][:7] == ["oc1", "oc1", None, None, None, None, "nu7x"] and [r.k for r in got][7:] == [None, "ⅷa", "x٣", None, "f12"]


def test_keys_of_labels_are_found_once_for_each_label(spark, tmp_path):
    from folioscope.sources import concepts

    labels = ["Monto total", "MONTOS TOTALES", "Folio", None, "", "de la", "Luces"]
    spark.createDataFrame([(i, labels[i % 7]) for i in range(700)], "i int, label string").write.parquet(str(tmp_path / "v"))
    found = concepts.keyed(spark.read.parquet(str(tmp_path / "v")))
    assert found.columns == ["i", "label", "key"] and {(r.label, r.key) for r in found.collect()} == {(x, None if x is None else text.canonical_key(x)) for x in labels} and found.count() == 700
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    keyed = [k for k, line in enumerate(plan) if "lambda" in line]
    assert keyed and all("Aggregate [" in "".join(plan[k : k + 2]) for k in keyed)
