"""The tool protocol: named calls with JSON arguments, answered by JSON values of bounded size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import scope as sc
from ..operators import search
from .engine import Engine

#: Results that a search gives by default, and at most.
DEFAULT, MOST = 8, 20


class ToolError(ValueError):
    """The call names no tool, or its arguments don't fit."""


def _plain(rows) -> list[dict]:
    return [{k: v if isinstance(v, int | str | bool | type(None)) else str(v) for k, v in r.asDict().items()} for r in rows]


def list_concepts(engine: Engine) -> list[dict]:
    return [{"concept": c, "kind": k} for c, k in engine.fields()]


def search_documents(engine: Engine, query: str, limit: int = DEFAULT) -> list[dict]:
    if not 1 <= limit <= MOST:
        raise ToolError(f"limit must be from 1 to {MOST}")
    return _plain(engine.search(query).select("document_id", "score").orderBy(F.desc("score"), "document_id").limit(limit).collect())


def exact_lookup(engine: Engine, text: str) -> list[dict]:
    c = engine.corpus
    return _plain(search.strict_exact(c.documents, c.values, c.chunks, text).orderBy(F.desc("score"), "document_id").limit(MOST).collect())


def _scope(engine: Engine, filters: dict):
    unknown = [f for f in filters or {} if f not in engine.names()]
    if unknown:
        raise ToolError(f"unknown fields: {unknown}")
    return sc.with_filters(engine.corpus.documents, engine.corpus.values, list((filters or {}).items()))


def aggregate_values(engine: Engine, concept: str, operation: str = "sum", filters: dict | None = None) -> list[dict]:
    if operation not in ("sum", "count") or concept not in engine.names():
        raise ToolError("operation must be sum or count, of a known field")
    return _plain(agg.aggregate(engine.corpus.values, _scope(engine, filters), concept, operation).orderBy("currency").collect())


def count_documents(engine: Engine, filters: dict | None = None) -> dict:
    return {"n": _scope(engine, filters).count()}


TOOLS = {f.__name__: f for f in (list_concepts, search_documents, exact_lookup, aggregate_values, count_documents)}


def call(engine: Engine, name: str, arguments: dict | None = None):
    """Run a tool; wrong names and arguments raise ``ToolError``."""
    if name not in TOOLS:
        raise ToolError(f"no tool {name}; there are {sorted(TOOLS)}")
    try:
        return TOOLS[name](engine, **(arguments or {}))
    except TypeError as why:
        raise ToolError(str(why)) from why
