"""Answers about one or a few identified documents: a field, a row, a calculation, a comparison, a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact
from ..functions.values import render
from ..operators import aggregate as agg
from ..operators import relations as rel
from ..operators import scope as sc
from ..sources.tables import Corpus
from .language import Signals, asked_kinds, closed_answer, resolve_field

#: Documents that an answer about documents takes at most, and fields that a summary shows.
DOCUMENTS, SUMMARY = 25, 12


@dataclass
class Answer:
    text: str
    verified: bool = False
    reason: str | None = None
    options: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    citations: list[int] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)


def located(corpus: Corpus, identifier: str) -> list[int]:
    """The documents that hold an identifier, the smallest ids first; one more than an answer takes tells that they are too many."""
    return [r.document_id for r in sc.by_identifier(corpus.values, identifier).select("document_id").orderBy("document_id").limit(DOCUMENTS + 1).collect()]


def identified(corpus: Corpus, tokens: list[str], question: str, s: Signals) -> Answer | None:
    """An answer about the documents of the identifiers in a question; None if it isn't about them."""
    found = [located(corpus, t) for t in tokens]
    missing = [t for t, ids in zip(tokens, found) if not ids]
    if len(missing) == len(tokens):
        return None
    if missing:
        return Answer(f"Ningún documento tiene {', '.join(missing)}.", reason="valor_inexistente", options=missing)
    about = question
    for t in tokens:
        about = about.replace(t, " ")
    if any(len(ids) > DOCUMENTS for ids in found):
        return None  # too common for an answer about documents: the identifier is a filter
    if len(tokens) == 2 and (s.comparison or s.row_operation) and all(len(ids) == 1 for ids in found):
        return compared(corpus, found[0][0], found[1][0], about)
    ids = sorted({i for x in found for i in x})
    if s.row_operation:
        return calculated(corpus, ids, about, s.row_operation)
    if s.operation in ("sum", "average", "max", "min", "count") and len(ids) > 1:
        return None
    return about_documents(corpus, ids, about)


def _of(corpus: Corpus, ids: list[int]) -> DataFrame:
    return corpus.values.where(F.col("document_id").isin(ids))


def _fields(values: DataFrame) -> dict[str, str]:
    """Fields of a few documents with their kind, in the documents' order."""
    rows = values.groupBy("concept").agg(F.min("ordinal").alias("at"), F.min("value_type").alias("kind")).orderBy("at", "concept").collect()
    return {r.concept: r.kind for r in rows}


def about_documents(corpus: Corpus, ids: list[int], question: str) -> Answer:
    """A field by its name, else by what the question word asks for, else a row by its label, else a summary."""
    values = _of(corpus, ids)
    fields = _fields(values)
    concept, options = resolve_field(question, list(fields))
    if concept is None and options:
        return Answer("¿Qué campo?", reason="campo_ambiguo", options=options)
    kinds = asked_kinds(question)
    if concept is None and kinds:
        fits = [f for f, k in fields.items() if k in kinds]
        if len(fits) > 1:
            return Answer("Varios campos responden a la pregunta.", reason="campo_por_categoria_ambiguo", options=fits[:6])
        if not fits:
            return Answer("El documento no tiene un dato de ese tipo.", citations=ids)
        concept = fits[0]
    if concept is not None:
        return field_answer(corpus, values, ids, concept, question)
    shown = [f"{r.concept}: {r.text_value}" for r in values.orderBy("document_id", "ordinal").limit(SUMMARY).collect()]
    return Answer("\n".join(shown), bool(shown), rows=values, citations=ids)


def field_answer(corpus: Corpus, values: DataFrame, ids: list[int], concept: str, question: str) -> Answer:
    """The value that the documents agree on; in tables that of the row whose label the question says; sí or no if it asks so."""
    own = values.where(F.col("concept") == concept)
    cells = values.where(F.col("record_scope").isNotNull() & (F.col("concept") != concept) & F.col("value_type").isin("text", "state"))
    labels = [r.literal_value for r in sc.mentioned_values(cells, question).select("literal_value").distinct().limit(2).collect()]
    if len(labels) == 1:
        own = agg.in_labelled_rows(values, labels[0], concept)
    scope = corpus.documents.where(F.col("document_id").isin(ids))
    r = agg.agreed_value(own, scope, concept).first()
    if r.outcome == "absent":
        return Answer(f"Los documentos no tienen {concept}.", citations=ids)
    stated = [x.text_value for x in own.select("text_value").distinct().orderBy("text_value").limit(DOCUMENTS).collect()]
    said = closed_answer(question, stated)
    if said is not None:
        return Answer(f"{'Sí' if said else 'No'}. {concept}: {'; '.join(stated)}", r.reliable, rows=own, citations=ids)
    if r.outcome == "agreed":
        return Answer(f"{concept}: {r.value}", r.reliable, rows=own, citations=ids)
    return Answer(f"{concept} tiene {r.n_values} valores: {'; '.join(stated)}", False, "campo_multiple_en_documento" if len(ids) == 1 else "valores_discrepantes", rows=own, citations=ids)


def compared(corpus: Corpus, first: int, second: int, question: str) -> Answer:
    """One field in two documents."""
    concept, options = resolve_field(question, list(_fields(_of(corpus, [first, second]))))
    if concept is None:
        return Answer("¿Qué campo comparar?", reason="campo_ambiguo", options=options)
    table = rel.compare_documents(corpus.values, concept, first, second)
    r = table.first()
    reason = None if r.outcome == "coinciden" else r.outcome
    return Answer(f"{concept}: {r.first or '—'} y {r.second or '—'} ({r.outcome})", reason in (None, "valores_discrepantes"), reason, rows=table, citations=[first, second])


def calculated(corpus: Corpus, ids: list[int], question: str, op: str) -> Answer:
    """A calculation with two fields of one document; an operand must be one number."""
    values = _of(corpus, ids)
    numeric = {f for f, k in _fields(values).items() if k in ("money", "number", "percentage", "text")}
    asked = exact(question)
    named = sorted((f for f in numeric if exact(f) in asked), key=lambda f: asked.find(exact(f)))
    named = [f for f in named if not any(f != g and exact(f) in exact(g) for g in named)]
    if len(ids) != 1 or len(named) != 2:
        return Answer("¿Qué dos campos de qué documento?", reason="campo_ambiguo", options=sorted(numeric)[:6])
    for f in named:
        r = agg.operand(values, f).first()
        if r is None or r.issue:
            return Answer(f"{f} no es un número único en el documento.", reason=r.issue if r else "operacion_indeterminada", citations=ids)
    table = agg.row_operation(values, named[0], named[1], op)
    r = table.first()
    if r.issue:
        return Answer("La operación no tiene resultado.", reason="operacion_indeterminada", rows=table, citations=ids)
    return Answer(f"{named[0]} y {named[1]}: {render(r.result)} {r.unit or ''}".rstrip(), True, rows=table, citations=ids)
