"""The cover pass over a vocabulary table, and OCR by content."""

from folioscope.sources import covers, index, ocr_cache

LABELS = [("Folio",), ("Estado",), ("Total neto",), ("Total",), ("Cantidad recibida",), ("Cantidad",)]


def found(spark, text):
    chunks = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "document_id long, ordinal int, content string")
    return [(r.line, r.label, r.value) for r in covers.cover_lines(chunks, spark.createDataFrame(LABELS, "label string")).orderBy("line").collect()]


def test_runs_of_lines_with_the_longest_label(spark):
    assert found(spark, "Folio  12\nEstado Abierta ya\nTotal neto 9\notro\nFolio 13\nTotal 5") == [(0, "Folio", "12"), (1, "Estado", "Abierta ya"), (2, "Total neto", "9")]
    assert found(spark, "Folio 1\nTotal neto\nEstado x\nTotal 2\r\nCantidad recibida 7") == [(2, "Estado", "x"), (3, "Total", "2"), (4, "Cantidad recibida", "7")]
    assert found(spark, "Folio 1\nImporte: 9\nCantidad de cajas 3\nnada") == [(0, "Folio", "1"), (2, "Cantidad", "de cajas 3")]
    assert found(spark, "Folios 1\nFolios 2\nFolios 3") == []


def test_vocabulary_has_no_limit_and_no_doubtful_labels(spark):
    rows = [(d, f"campo {i}", True) for i in range(2500) for d in (1, 2)] + [(1, "Solo uno", True), (1, "Otro Nombre", True), (2, "Otro Nombre", True), (1, "dudoso", False), (2, "dudoso", True), (1, "9x", True), (2, "9x", True)]
    labels = {r.label for r in covers.vocabulary(spark.createDataFrame(rows, "document_id long, concept string, reliable boolean")).collect()}
    assert labels == {f"campo {i}" for i in range(2500)}


def test_no_content_is_read_twice(spark, tmp_path):
    folder, root, calls = tmp_path / "in", str(tmp_path / "idx"), tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()

    def provider(data, at=str(calls)):
        import os
        import uuid

        open(os.path.join(at, uuid.uuid4().hex), "w").close()
        if b"rota" in data:
            raise ValueError("no se lee")
        return f"Folio: {data[12:].decode()}", 0.9 if b"clara" in data else 0.3

    png = b"\x89PNG\r\n\x1a\n0000"
    for name, what in {"a": b"clara-1", "b": b"clara-1", "c": b"turbia-2", "d": b"rota-3"}.items():
        (folder / f"{name}.png").write_bytes(png + what)
    (folder / "e.md").write_text("Folio: E-1")
    index.authorize(spark, root, str(folder))
    index.index_folder(spark, str(folder), root, "v1", provider)
    assert len(list(calls.iterdir())) == 3  # equal contents once
    first = {(r.path[-5], r.text_value, r.reliable) for r in index.load(spark, root).values.join(index.load(spark, root).documents.select("document_id", "path"), "document_id").collect()}
    assert first == {("a", "clara-1", True), ("b", "clara-1", True), ("c", "turbia-2", False), ("/", "E-1", True)} or {x[1:] for x in first} == {("clara-1", True), ("turbia-2", False), ("E-1", True)}
    assert [r.reason for r in index.load(spark, root).unindexed.collect()] == ["OCR fallido"]
    index.index_folder(spark, str(folder), root, "v2", provider)
    assert len(list(calls.iterdir())) == 3
    (folder / "a.png").write_bytes(png + b"clara-9")
    index.index_folder(spark, str(folder), root, "v3", provider)
    assert len(list(calls.iterdir())) == 4
    assert {r.text_value for r in index.load(spark, root).values.collect()} == {"clara-1", "clara-9", "turbia-2", "E-1"}
    ocr_cache.compact(spark, f"{root}/_ocr", "whole")
    assert {r.status for r in ocr_cache.cached(spark, f"{root}/_ocr").collect()} == {"complete", "low_confidence", "failed"} and ocr_cache.cached(spark, f"{root}/_ocr").count() == 4


def test_labels_are_read_once_and_the_words_of_no_line_are_aggregated(spark, tmp_path):
    spark.createDataFrame(LABELS, "label string").write.parquet(str(tmp_path / "labels"))
    chunks = spark.createDataFrame([(1, 0, "Total neto 9\nFolio: 1\nTotal Folio\nFolio 1 : x\nCantidad recibida\nFolio a\nFolio b")], "document_id long, ordinal int, content string")
    found = covers.cover_lines(chunks, spark.read.parquet(str(tmp_path / "labels")))
    assert [tuple(r) for r in found.select("line", "label", "value").orderBy("line").collect()] == [(0, "Total neto", "9"), (2, "Total", "Folio")]
    assert not any("/labels/" in f for f in found.inputFiles())
