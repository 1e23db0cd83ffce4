"""Reports in Markdown: an answer, or several, with their evidence and what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import relations as rel
from .answers import Answer

#: Rows that a table shows, documents that a reading takes, details and lists.
ROWS, READ, LISTED = 18, 250, 24


def cell(x) -> str:
    return "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")


def table(rows: DataFrame, most: int = ROWS) -> str:
    """The first rows, and that there are more."""
    found = rows.limit(most + 1).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in found[:most]]
    return "\n".join(lines + ["", "Hay más filas."] * (len(found) > most))


def render(title: str, answer: Answer, documents: DataFrame) -> str:
    """Title, result, state of verification, cited documents by path, notices."""
    parts = [f"## {title}", answer.text, "Verificado." if answer.verified else f"Sin verificar{f' ({answer.reason})' if answer.reason else ''}."]
    if answer.options:
        parts.append("\n".join(f"- {o}" for o in answer.options))
    if answer.citations:
        paths = documents.where(F.col("document_id").isin(answer.citations)).select("document_id", "path").orderBy("document_id").limit(LISTED)
        parts.append("\n".join(f"- {r.path} ({r.document_id})" for r in paths.collect()))
    if answer.notices:
        parts.append("\n".join(f"> {n}" for n in answer.notices))
    return "\n\n".join(parts)


def reading(values: DataFrame, ids: list[int]) -> str:
    """What up to READ documents say: fields in which all agree, and those that differ, with the numbers' ranges."""
    own = values.where(F.col("document_id").isin(ids[:READ]))
    fields = agg.fields_across(own).orderBy(F.desc("common"), "concept")
    parts = ["### Campos", table(fields), "### Cantidades", table(agg.summary(own).orderBy("value_type", "currency"))]
    return "\n\n".join(parts + [f"Se leyeron {READ} de {len(ids)} documentos."] * (len(ids) > READ))


def collection(documents: DataFrame, unindexed: DataFrame, values: DataFrame) -> str:
    """The whole collection: formats, folders, copies, unread files, fields."""
    parts = ["## Colección", "### Formatos", table(rel.by_format(documents, unindexed).orderBy("extension")), "### Carpetas", table(rel.inventory(documents).orderBy("origin")), "### Idénticos", table(rel.duplicates(documents).orderBy("first")), "### Sin leer", table(unindexed.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")), "### Campos", table(agg.catalogue(values).orderBy(F.desc("n_values"), "concept"))]
    return "\n\n".join(parts)
