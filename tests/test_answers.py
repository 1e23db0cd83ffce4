"""Document answers, router, tools, reports, index life cycle, and the contracts that earlier rounds broke."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.functions import periods, text
from folioscope.functions import values as val
from folioscope.operators import aggregate as agg
from folioscope.operators import near
from folioscope.operators import relations as rel
from folioscope.operators import scope as sc
from folioscope.plans import language, report, tools
from folioscope.plans.engine import Engine, claims_of
from folioscope.queries import QUERIES
from folioscope.sources import files, index
from folioscope.sources.tables import Corpus

from .test_engine import COLUMNS, PDF, one, value

DOCUMENTS = "document_id long, path string, title string, origin string, extension string, content_hash string, ocr_status string, ocr_confidence double, declared_format_mismatch string"


def loop(word):
    """The rule of endings step by step, as the survey tells it."""
    while True:
        before = word
        for ending, least, new in (("ces", 7, "z"), ("es", 7, ""), ("s", 5, "")):
            if len(word) >= least and word.endswith(ending):
                word = word.removesuffix(ending) + new
                break
        if len(word) >= 6 and word[-1] in "oa":
            word = word[:-1]
        if word == before:
            return word


def test_roots_reach_the_end(spark):
    r = random.Random(3)
    words = ["".join(r.choice("ceszoabn") for _ in range(r.randrange(1, 15))) for _ in range(3000)] + ["casasasasas", "intereses"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.root_of(F.col("w")).alias("r")).collect()
    assert all(r.r == loop(r.w) == text.root(r.w) for r in rows)


def test_states_months_and_labels(spark):
    kind = lambda label: one(spark, val.kind_of(F.col("a"), F.lit("Abierta")), a=label)
    assert kind("Estados") == "state" and kind("Estadística") == "text"
    assert one(spark, val.date_value(F.col("a")), a="3  de setiembre   de 2024") == date(2024, 9, 3)
    assert periods.parse("en setiembre de 2024", date(2026, 1, 1)) == periods.month(2024, 9)
    lines = spark.createDataFrame([(1, "10:30 hola\nhttps://x.org\nFolio: A-1")], "document_id long, content string")
    assert [(r.label, r.value) for r in files.label_lines(lines).collect()] == [("Folio", "A-1")]
    assert val.render_total(Decimal("1500"), ["$1,000", "$500"]) == "$1,500" and val.render_total(Decimal("-3"), ["1.50 MXN", "1.50 MXN"]) == "-3.00 MXN"


def test_no_cell_is_lost():
    got = files.parse_csv("Nombre,,Total,Lugar\nAna,x,,,extra\n".encode())
    assert [(r["label"], r["value"]) for r in got.records] == [("Nombre", "Ana"), ("columna 2", "x"), ("columna 5", "extra")]
    late = "a b\n" * 3000 + "Nombre;Total\nAna;1\n"
    assert any(r["value"] == "Ana" for r in files.parse_csv(late.encode()).records)


def test_chunk_limit_counts_no_last_line_feed():
    text = "\n".join(["x" * 699, "y" * 700, "z"])
    assert [c["location"] for c in files.chunks_of(text)] == ["líneas 1-2", "líneas 3-3"]


def test_chunks_query_against_brute_force(spark, tables):
    def brute(text):
        out, held = [], ""
        for line in text.splitlines():
            if held and len(held.encode()) + len(line.encode()) > 1400:
                out.append(held)
                held = ""
            held += line + "\n"
        return [x[:-1] for x in [*out, held] if x.strip()]

    want = {r.doc_id: brute(r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["S16_chunks"](spark, tables).orderBy("document_id", "ordinal").collect():
        got.setdefault(r.document_id, []).append(r.content)
    assert got == {i: x for i, x in want.items() if x}


def test_accounts_stay_without_totals(spark):
    rows = spark.createDataFrame([value(1, "Importe", "nada")], COLUMNS)
    scope = spark.range(1, 4).withColumnRenamed("id", "document_id")
    r = agg.aggregate(rows, scope, "Importe").collect()
    assert [(x.value, x.n_scope, x.n_calculated, x.n_missing, x.n_invalid, x.verified) for x in r] == [(None, 3, 0, 2, 1, False)]
    r = agg.compute_category(rows, scope, "money").collect()
    assert [(x.value, x.n_scope, x.n_none) for x in r] == [(None, 3, 3)]


def test_large_products(spark):
    big = [value(1, "A", "x", "number", "99999999999999999.0000"), value(1, "B", "x", "number", "99999999999999999.0000"), value(2, "A", "x", "number", "1.5000"), value(2, "B", "x", "number", "0.3333")]
    got = {r.document_id: (r.result, r.issue) for r in agg.row_operation(spark.createDataFrame(big, COLUMNS), "A", "B", "multiply").collect()}
    assert got[2] == (Decimal("0.5000"), None) and (got[1][0] is not None or got[1][1] == "out_of_range")


def test_operands_and_citations(spark):
    rows = [value(1, "Peso", "12 kg"), value(2, "Peso", "1"), value(3, "Peso", "2", "number", "2"), value(3, "Peso", "3", "number", "3"), value(4, "Peso", "mucho")]
    got = {r.document_id: (r.numeric, r.issue) for r in agg.operand(spark.createDataFrame(rows, COLUMNS), "Peso").collect()}
    assert got[1] == (12, None) and got[3] == (None, "operando_multiple_en_documento") and got[4] == (None, "operacion_indeterminada")
    hits = spark.createDataFrame([(i, "MXN" if i > 2 else "USD") for i in range(50)], "document_id long, currency string")
    cited = [(r.currency, r.document_id) for r in agg.sampled_citations(hits, "currency", 5).collect()]
    assert cited == [("MXN", 3), ("USD", 0), ("MXN", 4), ("USD", 1), ("MXN", 5)]


def test_spelling_variants(spark):
    rows = [value(1, "Ciudad", "Monterrey"), value(2, "Ciudad", "Monterey", reliable=False), value(3, "Ciudad", "Lima", reliable=False)]
    got = [(r.variant, r.literal_value) for r in near.spelling_variants(spark.createDataFrame(rows, COLUMNS)).where("concept = 'Ciudad'").collect()]
    assert got == [("monterey", "monterrey")]


def test_order_is_kept(spark, tables):
    ranked = QUERIES["C1_ranking"](spark, tables).collect()
    assert [r.value for r in ranked] == sorted((r.value for r in ranked), reverse=True)
    ids = [r.document_id for r in QUERIES["F5_scope"](spark, tables).collect()]
    assert ids == sorted(ids)
    found = QUERIES["T7_free_text"](spark, tables).collect()
    assert [(-r.score, r.document_id) for r in found] == sorted((-r.score, r.document_id) for r in found)


def test_language():
    kinds = lambda q: [(t.kind, t.text) for t in language.exact_tokens(q)]
    assert kinds("¿estado de FAC-12 en 02_reportes?") == [("identifier", "FAC-12")] and kinds("abre nota.md FAC-1") == [("file", "nota.md")]
    assert kinds("¿quién dice «hola mundo» en FAC-1?") == [("quote", "hola mundo")]
    fields = ["Estado", "Segmento", "Importe total", "Importe neto"]
    assert language.resolve_field("el importe", fields) == (None, ["Importe total", "Importe neto"])
    assert language.resolve_field("el importe total", fields) == ("Importe total", [])
    roles = language.field_roles("¿cuál es el estado de los de segmento BUILDING?", fields)
    assert (roles["Estado"], roles["Segmento"], roles["Importe neto"]) == ("asked", "restriction", "unmarked")
    assert language.closed_answer("¿Está cerrada?", ["Cerrado"]) is True and language.closed_answer("¿No está cerrada?", ["Cerrado"]) is False
    assert language.closed_answer("¿Tiene firma?", ["No"]) is False and language.closed_answer("¿Cuál es?", ["No"]) is None
    assert claims_of("La suma de Ana Ruiz es 1,200.00") == ["1,200.00", "Ana Ruiz"]


@pytest.fixture(scope="module")
def small(spark):
    rows = []
    for i, (state, amount, cur) in enumerate([("Vencida", "1000", "MXN"), ("Pagada", "500", "MXN"), ("Vencida", "70", "USD")], 1):
        rows += [value(i, "Folio", f"FAC-{i}"), value(i, "Estado", state, "state"), value(i, "Importe", amount, "money", amount, cur), value(i, "Fecha de emisión", f"2024-0{i}-01", "date", day=date(2024, i, 1)), value(i, "Firmada", "Sí" if i == 1 else "No")]
    rows += [value(1, "Pieza", "tornillo", scope="fila 2"), value(1, "Peso", "3", "number", "3", scope="fila 2"), value(1, "Pieza", "tuerca", scope="fila 3"), value(1, "Peso", "8", "number", "8", scope="fila 3")]
    rows += [value(2, "Entrada", "10", "number", "10"), value(2, "Salida", "4", "number", "4"), value(3, "Vence", "2024-05-05", "date", day=date(2024, 5, 5)), value(3, "Cajas", "6", "number", "6")]
    documents = spark.createDataFrame([(i, f"02_reportes/{i}.md" if i < 3 else "legal/3.md", f"{i}.md", "02_reportes" if i < 3 else "legal", "md", "h" if i < 3 else "k", "not_required", None, "pdf" if i == 3 else None) for i in (1, 2, 3)], DOCUMENTS)
    chunks = spark.createDataFrame([(i, 0, f"texto sobre contrato número {i}") for i in (1, 2, 3)], "document_id long, ordinal int, content string")
    unindexed = spark.createDataFrame([], "path string, origin string, extension string, reason string")
    return Engine(Corpus(documents, spark.createDataFrame(rows, COLUMNS), unindexed, chunks), lambda: date(2024, 6, 1))


def test_document_answers(small):
    ask = lambda q, c="": small.ask(q, c)
    a = ask("¿Cuál es el estado de FAC-1?")
    assert a.text == "Estado: Vencida" and a.verified and a.citations == [1]
    assert ask("¿Está firmada FAC-2?").text.startswith("No.") and ask("¿Está pagada FAC-2? ¿Cuál es su estado?").citations == [2]
    assert ask("¿Cuándo fue FAC-1?").text == "Fecha de emisión: 2024-01-01"
    assert ask("¿Cuándo fue FAC-3?").reason == "campo_por_categoria_ambiguo"
    assert ask("¿Cuál es el peso de tuerca en FAC-1?").text == "Peso: 8"
    assert ask("¿Cuál es el peso en FAC-1?").reason == "campo_multiple_en_documento"
    assert ask("resume FAC-2").text.count("\n") == 6
    b = ask("compara el estado de FAC-1 contra FAC-2")
    assert b.reason == "valores_discrepantes" and b.citations == [1, 2]
    assert ask("compara la salida de FAC-1 contra FAC-2").reason == "campo_ausente_en_un_documento"
    assert ask("entrada menos salida en FAC-2").text == "Entrada y Salida: 6.00"
    assert "lectura" in " ".join(ask("¿Cuál es el estado de FAC-3?").notices) or "extension_enganosa" in " ".join(ask("¿Cuál es el estado de FAC-3?").notices)


def test_folders_references_and_currency(small):
    assert small.ask("¿Cuánto suma el importe en la carpeta «nada»?").reason == "carpeta_inexistente"
    a = small.ask("¿Cuánto suma el importe en la carpeta 02_reportes?", "f")
    assert "1,500.00 MXN" in a.text and "USD" not in a.text and any("idénticos" in n for n in a.notices)
    assert small.ask("¿Cuál es el estado del segundo?", "f").text == "Estado: Pagada"
    assert small.ask("¿Cuál es el estado del quinto?", "f").reason == "referencia_sin_contexto"
    b = small.ask("¿Cuánto suma el importe en USD?")
    assert "70.00 USD" in b.text and "MXN" not in b.text and not b.verified
    assert small.ask("el 45/45/2024 ¿cuánto suma el importe?").reason == "fecha_invalida"
    c = small.ask("¿Cuánto suma el importe con estado Vencida?", "e")
    assert "1,000.00 MXN" in c.text
    assert "500.00 MXN" in small.ask("¿Y con estado Pagada?", "e").text


def test_router_and_tools(small):
    ids = lambda q: [r.document_id for r in small.search(q).collect()]
    assert ids("FAC-2") == [2] and ids("abre 3.md") == [3] and ids("«Pagada»") == [2] and ids("Estado: Vencida") == [1, 3]
    assert set(ids("contrato número")) == {1, 2, 3}
    assert tools.call(small, "search_documents", {"query": "FAC-2", "limit": 1}) == [{"document_id": 2, "score": 140}]
    assert tools.call(small, "count_documents", {"filters": {"Estado": "vencida"}}) == {"n": 2}
    assert {"concept": "Importe", "kind": "money"} in tools.call(small, "list_concepts")
    assert [r["value"] for r in tools.call(small, "aggregate_values", {"concept": "Importe"})] == ["1500.0000", "70.0000"]
    assert tools.call(small, "exact_lookup", {"text": "pagada"})[0] == {"document_id": 2, "score": 120}
    for name, arguments in (("nada", {}), ("search_documents", {"query": "x", "limit": 99}), ("count_documents", {"filters": {"Nada": 1}}), ("exact_lookup", {"x": 1})):
        with pytest.raises(tools.ToolError):
            tools.call(small, name, arguments)


def test_reports(small):
    a = small.ask("¿Cuánto suma el importe?")
    out = report.render("Importes", a, small.corpus.documents)
    assert "02_reportes/1.md" in out and "Alcance 3" in out and out.startswith("## Importes")
    assert "| Estado |" in report.reading(small.corpus.values, [1, 2, 3])
    whole = report.collection(small.corpus.documents, small.corpus.unindexed, small.corpus.values)
    assert "### Carpetas" in whole and "legal" in whole
    assert [r.reason for r in rel.unreliable(small.corpus.documents).collect()] == ["extension_enganosa"]


def test_index_life_cycle(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "idx")
    folder.mkdir()
    (folder / "a.md").write_text("Folio: A-1")
    (folder / "falso.md").write_bytes(PDF)
    with pytest.raises(PermissionError):
        index.index_folder(spark, str(folder), root, "v1")
    index.authorize(spark, root, str(folder))
    assert index.index_folder(spark, str(folder), root, "v1")["disguised"] == 1
    (folder / "b.md").write_text("Folio: B-1")
    assert index.index_folder(spark, str(folder), root, "v2")["indexed"] == 3
    assert index.recover(spark, root) == ("v2", [])
    for f in (tmp_path / "idx" / "v2" / "documents").glob("*.parquet"):
        f.unlink()
    spark.catalog.clearCache()
    assert index.recover(spark, root) == ("v1", ["v2"]) and index.versions(spark, root)[0] == "v1"
    index.revoke(spark, root, str(folder))
    assert index.authorised_folders(spark, root) == []


def test_kind_stands_in_for_a_field_that_the_scope_lacks(small):
    a = small.ask("¿Cuánto suma la entrada con estado Pagada?")
    assert "10.00" in a.text and a.verified
    b = small.ask("¿Cuánto suma la entrada con estado Vencida?")
    assert b.text == "Suma de los datos de tipo number: 6.00" and not b.verified
    assert b.notices[0] == "Ningún documento del alcance (2) tiene Entrada; calculados 1, con varios datos 1, sin dato 0"


def test_aliases(small):
    with pytest.raises(ValueError):
        small.alias("cuantía", "Nada")
    assert small._canonical("la cuantía") == "la cuantía"
    small.alias("Cuantía", "Importe")
    assert small._canonical("¿Cuánto suma la cuantía de «cuantía»? cuantías") == "¿Cuánto suma la Importe de «cuantía»? cuantías"
    assert small.ask("¿Cuánto suma la cuantía?").text == small.ask("¿Cuánto suma el importe?").text
    small.alias("cuantia", None)
    assert small.aliases == {}
