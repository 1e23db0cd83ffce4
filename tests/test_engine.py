"""Functions, files, planner: golden values and small fixtures."""

import io
import zipfile
import zlib
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.functions import periods, text
from folioscope.functions import values as val
from folioscope.operators import aggregate as agg
from folioscope.operators import relations as rel
from folioscope.plans.engine import Engine, supported
from folioscope.sources import files, index
from folioscope.sources.tables import orders_corpus

COLUMNS = "document_id long, concept string, ordinal int, value_type string, text_value string, literal_value string, numeric decimal(24,4), currency string, date_value date, record_scope string, location string, reliable boolean"


def value(doc, concept, x, kind="text", numeric=None, currency=None, day=None, scope=None, reliable=True):
    return doc, concept, 1, kind, x, text.fold(x), numeric and Decimal(numeric), currency, day, scope, "línea 1", reliable


def one(spark, column, **cells):
    names = list(cells)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert text.roots("Los pagados y las pagadas: papeles, capaces, intereses") == "los pagad y las pagad papel capaz inter"
    assert text.canonical_key("Fecha de la emisión") == "fech_emision" or text.canonical_key("Fecha de la emisión") == "fecha_emision"
    assert text.identifier("OC-2024/00 01") == "oc20240001" and text.identifier("12-34") is None and text.identifier("a#1") is None
    assert text.stems_match("client", "cliente") and not text.stems_match("mes", "mesa")
    assert [text.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, text.folded("a"), a="ÁÉñ Ü-1") == "aen u-1"
    stated = {"papeles": "papel", "capaces": "capaz", "luces": "luce", "intereses": "inter", "interes": "inter", "pagados": "pagad", "pagada": "pagad", "tipos": "tipo", "mesa": "mesa", "mes": "mes", "estados": "estad", "casas": "casa", "dia": "dia", "": ""}
    for w, r in stated.items():
        assert text.root(w) == r and one(spark, text.root_of(F.col("a")), a=w) == r
    for label in ("Importes totales de la venta", "IMPORTÉ TOTAL", "La de los", "Núm. 2"):
        assert one(spark, text.canonical_key_of("a"), a=label) == text.canonical_key(label)
    assert one(spark, text.kind_of_path("a"), a="rh/00012_Acta de baja.pdf") == "acta_de_baja" and one(spark, text.kind_of_path("a"), a="x/123.txt") is None
    assert one(spark, text.holds_value("a", "FAC-1"), a="ver fac-1, hoy") and not one(spark, text.holds_value("a", "FAC-1"), a="ver FAC-10")


@pytest.mark.parametrize("raw,kind,amount", [("$1,000.50 MXN", "money", "1000.5000"), ("-$5", "money", "-5.0000"), ("€3 USD", "text", None), ("$2 usd", "money", "2.0000"), ("2024-02-31", "text", None), ("3 de marzo de 2024", "date", None), ("50%", "percentage", None), ("1,000", "number", None), ("1e3", "text", None), ("hola", "text", None)])
def test_typed_values(spark, raw, kind, amount):
    assert one(spark, val.kind_of(F.lit("Campo"), F.col("a")), a=raw) == kind
    found = one(spark, val.money_amount(F.col("a")), a=raw)
    assert found == (Decimal(amount) if amount else None)


def test_keys_and_currency(spark):
    assert one(spark, val.money_currency(F.col("a")), a="£5") == "GBP" and one(spark, val.money_currency(F.col("a")), a="$5") is None
    key = lambda k, x: one(spark, val.filter_key(F.lit(k), F.col("a")), a=x)
    assert key("number", "1000") == key("number", "1,000") and key("number", "50") != key("percentage", "50%")
    assert one(spark, val.kind_of(F.lit("Estado"), F.col("a")), a="Abierta") == "state"
    assert one(spark, val.exact_amount(F.col("a")), a="1.00001") is None


def test_exact_mean_and_ratio(spark):
    def mean(rows):
        df = spark.createDataFrame([(Decimal(x),) for x in rows], "x decimal(24,4)")
        return df.agg(val.exact_mean(F.sum("x"), F.count("x")).alias("m")).first().m

    assert mean(["0.0001"] * 100 + ["0"] * 101) == 0
    assert mean(["0.0001", "0.0002"]) == Decimal("0.0002") and mean(["-0.0001", "-0.0002"]) == Decimal("-0.0002")
    assert one(spark, val.exact_ratio(F.col("a").cast(val.AMOUNT), F.col("b").cast(val.AMOUNT)), a="-1", b="3") == Decimal("-0.3333")
    assert one(spark, val.exact_ratio(F.col("a").cast(val.AMOUNT), F.col("b").cast(val.AMOUNT)), a="1", b="0") is None
    assert val.render(Decimal("1234567.5")) == "1,234,567.50" and val.render_signed(Decimal("2"), "MXN") == "+2.00 MXN"


def test_periods():
    day = date(2026, 3, 15)
    assert periods.parse("este mes", day) == periods.month(2026, 3) and periods.parse("el mes pasado", day) == periods.month(2026, 2)
    assert periods.parse("febrero de 2024", day).last == date(2024, 2, 29)
    assert periods.parse("entre 2024-01-05 y 2024-01-09", day).previous() == periods.Period(date(2023, 12, 31), date(2024, 1, 4))
    assert periods.parse("en 2023", day).previous() == periods.year(2022) and periods.parse("hola", day) is None
    assert len(periods.slash_readings("03/04/2024")) == 2 and not periods.slash_readings("31/31/2024")


def test_scope_accounts_for_everything(spark):
    rows = [value(1, "Importe", "10 MXN", "money", "10", "MXN"), value(2, "Otro", "x"), value(3, "Importe", "nada", "text"), value(4, "Importe", "5 USD", "money", "5", "USD"), value(5, "Importe", "7 MXN", "money", "7", "MXN", reliable=False)]
    scope = spark.range(1, 6).withColumnRenamed("id", "document_id")
    r = agg.aggregate(spark.createDataFrame(rows, COLUMNS), scope, "Importe", "sum", "MXN").first()
    assert (r.value, r.n_scope, r.n_calculated, r.n_missing, r.n_invalid, r.n_currency, r.verified) == (17, 5, 2, 1, 1, 1, False)


def test_row_scope_and_operations(spark):
    rows = [value(1, "Estado", "Activo", scope="fila 2"), value(1, "Estado", "Cerrado", scope="fila 3"), value(1, "Importe", "10", "number", "10", scope="fila 2"), value(1, "Importe", "20", "number", "20", scope="fila 3"), value(2, "Importe", "5", "number", "5")]
    v = spark.createDataFrame(rows, COLUMNS)
    out = {r.grp: r.value for r in agg.compute(agg.labelled(agg.operands(v, "Importe"), v.where("concept = 'Estado'")), "sum", ["grp"]).collect()}
    assert out == {"Activo": 10, "Cerrado": 20, "Sin valor": 5}
    pairs = [value(1, "A", "6", "money", "6", "MXN"), value(1, "B", "4", "money", "4", "USD"), value(2, "A", "6", "money", "6", "MXN"), value(2, "B", "0", "money", "0.0000", "MXN"), value(3, "A", "9", "money", "9", "MXN"), value(3, "B", "2", "number", "2")]
    got = {r.document_id: (r.result, r.unit, r.issue) for r in agg.row_operation(spark.createDataFrame(pairs, COLUMNS), "A", "B", "divide").collect()}
    assert got == {1: (None, None, "incompatible"), 2: (None, None, "zero_divisor"), 3: (Decimal("4.5"), "MXN", None)}


def test_contradictions(spark):
    rows = [value(1, "OC", "OC-1"), value(1, "Estado", "Autorizada"), value(2, "OC", "oc 1"), value(2, "Estado", "Cancelada", reliable=False), value(3, "OC", "OC-2"), value(3, "Estado", "Abierta"), value(4, "OC", "OC-2"), value(4, "Estado", "abierta")]
    got = rel.contradictions(spark.createDataFrame(rows, COLUMNS), "OC", "Estado").collect()
    assert [(r.key, r.n_values, r.low, r.high, r.reliable) for r in got] == [("oc1", 2, "autorizada", "cancelada", False)]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("--", "."), body)
    return out.getvalue()


DOCX = zipped(**{"word__document--xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Folio: A-1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Total</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>$9 MXN</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped(
    **{
        "xl__workbook--xml": '<workbook xmlns:r="r"><sheets><sheet name="H" sheetId="1" r:id="x"/></sheets></workbook>',
        "xl__styles--xml": '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="#,##0.00 [$USD]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="200"/></cellXfs></styleSheet>',
        "xl__worksheets__sheet1--xml": '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Nombre</t></is></c><c r="B1" t="inlineStr"><is><t>Tasa</t></is></c><c r="C1" t="inlineStr"><is><t>Pago</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Uno</t></is></c><c r="B2" s="1"><v>0.07</v></c><c r="C2" s="2"><v>12.5</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>Dos</t></is></c><c r="C3"><f>1+1</f></c></row></sheetData></worksheet>',
    }
)
PDF = b"%PDF-1.4\n<< /Length 9 /Filter /FlateDecode >> stream\n" + zlib.compress(b"BT (Folio: P-77 de prueba larga) Tj T* (Estado: Abierta) Tj ET") + b"\nendstream"


def test_index_of_files(spark, tmp_path):
    folder = tmp_path / "origen"
    (folder / "rh").mkdir(parents=True)
    for name, data in {"rh/1_nota.md": "**Folio:** N-1\nImporte: $1,200.00 MXN\nFecha: 2024-05-01\n10:30 hola".encode(), "rh/2_copia.md": b"Folio: N-2", "t.csv": "Reporte,Mayo\nNombre,Importe,Estado\nAna,10,Activo\nLuis,20,Cerrado\n".encode(), "d.docx": DOCX, "x.xlsx": XLSX, "p.pdf": PDF, "falso.csv": PDF, "i.png": b"\x89PNG....", "v.doc": b"\xd0\xcf\x11\xe0", "no.exe": b"x"}.items():
        (folder / name).write_bytes(data)
    corpus = index.build(spark, str(folder))
    assert corpus.documents.count() == 7
    reasons = {r.path.rpartition("/")[2]: r.reason for r in corpus.unindexed.collect()}
    assert reasons == {"i.png": "OCR no disponible", "v.doc": "formato no soportado: doc"}
    facts = {(r.path.rpartition("/")[2], r.concept, r.text_value, r.value_type) for r in corpus.values.join(corpus.documents, "document_id").collect()}
    assert {("1_nota.md", "Folio", "N-1", "text"), ("1_nota.md", "Importe", "$1,200.00 MXN", "money"), ("1_nota.md", "Fecha", "2024-05-01", "date"), ("t.csv", "Reporte", "Mayo", "text"), ("t.csv", "Importe", "20", "number"), ("d.docx", "Folio", "A-1", "text"), ("d.docx", "Total", "$9 MXN", "money"), ("x.xlsx", "Tasa", "7%", "percentage"), ("x.xlsx", "Pago", "12.5 USD", "money"), ("p.pdf", "Estado", "Abierta", "state")} <= facts
    assert {r.title for r in corpus.documents.where("declared_format_mismatch = 'pdf'").collect()} == {"falso.csv"}
    assert {r.origin for r in corpus.documents.collect()} == {"rh", "origen"}
    assert rel.census(corpus.documents, corpus.unindexed, ["kind"]).where("kind = 'nota'").first().indexed == 1
    root = str(tmp_path / "indice")
    index.save(corpus, root, "v1")
    index.publish(spark, root, "v1")
    again = index.load(spark, root)
    assert again.values.count() == corpus.values.count() and index.versions(spark, root) == ["v1"]
    assert index.changed(again.documents, corpus.documents).where("state <> 'unchanged'").count() == 0
    assert index.purge(again, "rh").documents.count() == 5


def test_small_parsers():
    assert [c["location"] for c in files.chunks_of("\n".join(["x" * 600] * 5))] == ["líneas 1-2", "líneas 3-4", "líneas 5-5"]
    assert files.format_meaning('0.00" EUR"', 170) == ("money", "EUR") and files.shifted_percent("0.0725") == "7.25%"


@pytest.fixture(scope="module")
def engine(spark, tables):
    return Engine(orders_corpus(spark, tables), lambda: date(1996, 6, 15))


def test_questions(engine, spark, tables):
    known = engine.corpus.values.where("concept = 'Importe total'")
    a = engine.ask("¿Cuánto suma el importe total con Estado: F?", "s")
    want = known.join(engine.corpus.values.where("concept = 'Estado' and text_value = 'F'").select("document_id"), "document_id").groupBy("currency").agg(F.sum("numeric").alias("t")).collect()
    assert a.verified and all(val.render_money(r.t, r.currency) in a.text for r in want) and "Alcance" in a.notices[0]
    b = engine.ask("¿Y el promedio de importe total de esos?", "s")
    assert b.text.startswith("Promedio") and engine.memories["s"].scope.filters == (("Estado", "F"),)
    assert engine.ask("¿Cuánto suma el importe total de esos?", "nueva").reason == "referencia_sin_contexto"
    assert engine.ask("¿Cuánto suman Estado: Zeta?").reason == "valor_inexistente"
    c = engine.ask("suma total", "amb")
    assert c.reason == "campo_ambiguo" and "Precio" in c.options
    assert "Precio" in engine.ask("Precio", "amb").text
    assert "BUILDING" in engine.ask("ranking de importe total por segmento").text
    d = engine.ask("compara el importe total de building contra machinery")
    assert "difference" in d.text and d.rows.count() <= 5
    assert engine.ask("compara el importe total de building").reason == "comparacion_incompleta"
    assert engine.ask("documentos duplicados").text.startswith("Grupos")
    assert engine.ask("el 03/04/1996 ¿cuánto suma el precio?").reason == "fecha_ambigua"
    assert engine.ask("contradicciones de estado por cliente").text.startswith("Contradicciones")
    assert engine.ask("¿qué dice «license»?").rows is not None
    with pytest.raises(ValueError):
        engine.ask("  ")


def test_folders():
    from folioscope.plans import folders

    origins = ["02_reportes", "rh/nomina", "Ventas 2024"]
    assert folders.explicit("¿qué hay en 02_reportes?", origins) == folders.Folder("found", "02_reportes")
    assert folders.explicit("en la carpeta «legal»", origins) == folders.Folder("missing", "legal")
    assert folders.explicit("suma el importe", origins).state == "not_named"
    assert folders.fuzzy("los reportes del mes", origins) == "02_reportes" and folders.fuzzy("hola", origins) is None
    assert folders.in_order("compara ventas 2024 con rh nomina", origins) == ["Ventas 2024", "rh/nomina"]


def test_supported():
    assert supported(["1,200.00", "Ana Ruiz"], ["Importe: $1,200.00 MXN", "ANA RUÍZ"]) == [] and supported(["7"], ["8"]) == ["7"]


def test_stream(spark, tmp_path):
    from folioscope.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("Folio: A-1")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.md").write_text("Folio: A-2")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    corpus = index.load(spark, str(tmp_path / "out"))
    assert sorted(r.text_value for r in corpus.values.collect()) == ["A-1", "A-2"] and "batch" not in corpus.documents.columns
