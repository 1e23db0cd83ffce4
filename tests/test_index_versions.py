"""The index: merging by content hash, snapshots, fields and their spellings."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import aggregate as agg
from folioscope.sources import concepts, index, snapshots
from folioscope.sources.tables import Corpus
from folioscope.streaming.ingest import ingest

DOCUMENTS = "document_id long, path string, title string, origin string, extension string, content_hash string, ocr_status string, ocr_confidence double"
VALUES = "document_id long, concept string, ordinal int, value_type string, text_value string, literal_value string, numeric decimal(24,4), currency string, date_value date, record_scope string, location string, reliable boolean"


def corpus(spark, files, unread=()):
    """Files are {path: [(label, value)]}; the hash is their content's."""
    docs, values, chunks = [], [], []
    for path, facts in files.items():
        number = sum(map(ord, path)) * 1000 + len(path)
        docs.append((number, path, path, path.split("/")[0], "md", str(hash(tuple(facts))), "not_required", None))
        chunks.append((number, 0, f"{facts}"))
        for i, (label, x) in enumerate(facts):
            kind = "number" if x.isdigit() else "text"
            values.append((number, label, i, kind, x, text.fold(x), Decimal(x) if x.isdigit() else None, None, None, None, "línea", not label.startswith("?")))
    make = spark.createDataFrame
    return Corpus(make(docs, DOCUMENTS), make(values, VALUES), make([(u, "x", "md", "ilegible") for u in unread], "path string, origin string, extension string, reason string"), make(chunks, "document_id long, ordinal int, content string"))


def state(spark, root, version=None):
    c = index.load(spark, root, version)
    paths = {r.document_id: r.path for r in c.documents.collect()}
    assert {r.document_id for r in c.chunks.collect()} == set(paths)
    return {paths[d]: {(r.concept, r.text_value) for r in rows} for d, rows in _grouped(c.values.collect()).items()}


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.document_id, []).append(r)
    return out


def fields(spark, root, version=None):
    return {(r.concept, r.kind, r.n_values) for r in index.catalogue(spark, root, version).collect()}


def test_merge_adds_replaces_and_removes_without_rewriting(spark, tmp_path):
    root = str(tmp_path)
    one = {"a/1": [("Total", "5"), ("Nota", "x")], "a/2": [("Total", "7")], "b/3": [("Total", "n/d"), ("Solo", "1")]}
    assert index.merge(corpus(spark, one, ["b/9"]), root, "v1").note["added"] == 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "v1").rglob("*.parquet")}
    two = one | {"a/2": [("Totales", "70")], "c/4": [("TOTAL", "1")]}
    del two["b/3"]
    note = index.merge(corpus(spark, two), root, "v2").note
    assert (note["added"], note["modified"], note["removed"], note["unchanged"]) == (1, 1, 1, 1)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "v1").rglob("*.parquet")}
    assert spark.read.parquet(f"{root}/v2/documents").count() == 2  # the unchanged file is not written again
    assert state(spark, root) == {"a/1": {("TOTAL", "5"), ("Nota", "x")}, "a/2": {("TOTAL", "70")}, "c/4": {("TOTAL", "1")}}
    assert fields(spark, root) == {("TOTAL", "number", 3), ("Nota", "text", 1)}  # `Solo` went with its only value
    assert fields(spark, root, "v1") == {("Total", "number", 3), ("Nota", "text", 1), ("Solo", "number", 1)}
    assert state(spark, root, "v1")["b/3"] == {("Total", "n/d"), ("Solo", "1")}
    assert [r.path for r in index.load(spark, root, "v1").unindexed.collect()] == ["b/9"] and index.load(spark, root).unindexed.count() == 0
    index.merge(corpus(spark, one), root, "v3")  # the removed file comes back
    assert state(spark, root)["b/3"] == {("Total", "n/d"), ("Solo", "1")} and state(spark, root)["a/2"] == {("Total", "7")}


def test_purge_retypes_and_drops_fields(spark, tmp_path):
    root = str(tmp_path)
    index.merge(corpus(spark, {"a/1": [("Dato", "x")], "b/1": [("Dato", "1"), ("Otro", "y")], "b/2": [("Dato", "2")]}), root, "v1")
    assert fields(spark, root) == {("Dato", "number", 3), ("Otro", "text", 1)}
    index.purge_origin(spark, root, "b", "v2")
    assert fields(spark, root) == {("Dato", "text", 1)} and set(state(spark, root)) == {"a/1"}
    assert index.intact(spark, root) and index.versions(spark, root) == ["v2", "v1"]


def test_compaction_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    files = {"a/1": [("Total", "1")]}
    for i in range(4):
        files |= {f"a/{i}": [("Total", str(i + 10))]}
        index.merge(corpus(spark, files), root, f"v{i}")
    want, names = state(spark, root), fields(spark, root)
    made = index.compact(spark, root, "whole")
    assert made.segments == ("whole",) and state(spark, root) == want and fields(spark, root) == names
    (tmp_path / "stray").mkdir()
    assert snapshots.vacuum(spark, root, keep=1, age_s=0) == ["stray", "v0", "v1", "v2", "v3"]
    assert state(spark, root) == want and index.versions(spark, root) == ["whole"]


def test_the_slower_of_two_writers_is_told(spark, tmp_path):
    root = str(tmp_path)
    base = index.merge(corpus(spark, {"a/1": [("Total", "1")]}), root, "v1")
    snapshots.commit(spark, root, base, base.segments, {"name": "first"})
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, base, [], {"name": "second"})
    assert index.versions(spark, root) == ["first", "v1"]
    (tmp_path / "_log" / "000000000003.json.1.tmp").write_text("{")  # a writer that died
    assert set(state(spark, root)) == {"a/1"}


def test_a_changed_file_replaces_itself_in_a_stream(spark, tmp_path):
    folder, root, at = tmp_path / "in", str(tmp_path / "idx"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.md").write_text("Folio: A-1")
    ingest(spark, str(folder), root, at).awaitTermination()
    (folder / "b.md").write_text("Folios: B-1")
    ingest(spark, str(folder), root, at).awaitTermination()
    (folder / "a.md").unlink()
    (folder / "a.md").write_text("Folio: A-2, corregido")
    import os

    os.utime(folder / "a.md", (2e9, 2e9))
    ingest(spark, str(folder), root, at).awaitTermination()
    got = {(r.concept, r.text_value) for r in index.load(spark, root).values.collect()}
    assert got <= {("Folio", "A-1"), ("Folio", "A-2, corregido"), ("Folio", "B-1")} and ("Folio", "B-1") in got and len(got) == 2
    base = snapshots.read(spark, root)
    assert index.merge(corpus(spark, {"z/1": [("Total", "1")]}), root, "again", removes=False, stream=("stream", 0)) == base


def test_spellings_names_and_kinds(spark):
    rows = [("Monto total", "1", True)] * 3 + [("Montos totales", "2", True)] * 2 + [("MONTÓ TOTAL", "x", True)] + [("EMP.", "3", False)] * 5 + [("EMP", "4", True)] + [("Sólo escáner", "5", False)] + [("De la", "6", True)] + [("Importe", "7", True), ("Importes", "8", True)]
    values = spark.createDataFrame(rows, "label string, x string, reliable boolean").withColumn("value_type", F.when(F.col("x") == "x", "text").otherwise("number"))
    known = concepts.dictionary(concepts.readings(concepts.keyed(values)))
    got = {r.key: (r.concept, r.kind, r.n_values, r.n_labels) for r in known.collect()}
    # A final e may belong to the word, so that `Importe` and `Importes` stay two fields.
    assert got == {"monto_total": ("Monto total", "number", 6, 3), "emp": ("EMP", "number", 6, 2), "solo_escaner": ("Sólo escáner", "number", 1, 1), "de_la": ("De la", "number", 1, 1), "importe": ("Importe", "number", 1, 1), "import": ("Importes", "number", 1, 1)}
    assert {text.canonical_key(x) for x, _, _ in rows} == set(got)
    other = concepts.aliases(spark.createDataFrame([("EMP", "Número de empleado", "confirmed"), ("EMP", "cuantía", "rejected"), ("Nada", "cosa", "confirmed")], "label string, other string, status string"))
    asked = spark.createDataFrame([(n,) for n in ("los montos totales", "NUMERO DE EMPLEADO", "cuantía", "cosa", "emp")], "name string")
    assert {r.name: r.concept for r in concepts.lookup(asked, known, other).collect()} == {"los montos totales": "Monto total", "NUMERO DE EMPLEADO": "EMP", "emp": "EMP"}


def test_labels_of_records_and_of_the_document_never_add_up(spark):
    def value(doc, concept, x, scope=None):
        return doc, concept, 1, "number" if x.isdigit() else "text", x, text.fold(x), Decimal(x) if x.isdigit() else None, "MXN", None, scope, "x", True

    rows = [value(1, "Importe", "10", "fila 1"), value(1, "Importe", "20", "fila 2"), value(1, "Estado", "Activo", "fila 1"), value(1, "Estado", "Cerrado", "fila 2"), value(1, "Estado", "Anual"), value(1, "Estado", "Firme"), value(1, "Importe", "5"), value(1, "Importe", "7", "fila 3"), value(2, "Importe", "9")]
    values = spark.createDataFrame(rows, VALUES)
    out = agg.compute(agg.labelled(values.where("concept = 'Importe'"), values.where("concept = 'Estado'")), "sum", ["grp"])
    assert {r.grp: (int(r.value), r.n_values) for r in out.collect()} == {"Activo": (15, 2), "Cerrado": (25, 2), "Anual": (5, 1), "Firme": (5, 1), "Sin valor": (16, 2)}


def test_first_record_is_the_first_by_number(spark):
    def value(concept, x, scope):
        return 1, concept, 1, "number", x, x, Decimal(x), None, None, scope, "x", True

    values = spark.createDataFrame([value("A", "100", None), value("B", "10", "fila 10"), value("B", "2", "fila 2")], VALUES)
    assert agg.first_value(values, "B").first().numeric == 2 and agg.row_operation(values, "A", "B", "subtract").first().result == 98
