"""What a question asks for: words to signals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import exact, fold, identifier, root, roots, stems_match
from ..sources.files import EXTENSIONS

# Roots and words that name an operation or a relation.
OPERATIONS = {
    "average": {"roots": ["promedi", "medi"], "words": ["average", "mean"]},
    "sum": {"roots": ["sum", "total", "acumulad"], "words": ["suma", "suman", "sumar", "total", "totales"]},
    "max": {"roots": ["maxim"], "words": ["mayor", "maximo", "maxima", "largest"]},
    "min": {"roots": ["minim"], "words": ["menor", "minimo", "minima", "smallest"]},
    "count": {"roots": ["cuant"], "words": ["cuantos", "cuantas", "numero", "count"]},
}
PRECEDENCE = ["average", "sum", "max", "min", "count"]
CATEGORIES = {"importe": "money", "monto": "money", "dinero": "money", "cantidad": "number", "unidades": "number", "porcentaje": "percentage"}
REFERENCES = ["esos", "esas", "estos", "estas", "ellos", "ellas", "anteriores", "mismos", "mismas", "cuales"]
CATEGORY_WORDS = {"cuando": ("date",), "cuanto": ("money", "number", "percentage"), "cuanta": ("money", "number", "percentage"), "quien": ("text",), "quienes": ("text",)}
YES, NO = ["si", "yes", "true", "verdadero"], ["no", "false", "falso"]
CURRENCIES = ["MXN", "USD", "EUR", "GBP", "JPY", "INR", "KRW", "CAD"]
ORDINALS = {"primer": 1, "primero": 1, "primera": 1, "segundo": 2, "segunda": 2, "tercer": 3, "tercero": 3, "tercera": 3, "cuarto": 4, "quinto": 5}


@dataclass(frozen=True)
class Signals:
    operation: str | None
    grouped: bool
    ranking: bool
    ascending: bool
    comparison: bool
    periods: bool
    reference: bool
    ordinal: int | None
    contradiction: bool
    dossier: bool
    census: bool
    duplicates: bool
    formats: bool
    evidence: bool
    row_operation: str | None
    category: str | None


def signals(question: str) -> Signals:
    words = exact(question).split()
    own = {root(w) for w in words}
    has = lambda *names: any(n in words for n in names)
    found = [op for op in PRECEDENCE if own & set(OPERATIONS[op]["roots"]) or has(*OPERATIONS[op]["words"])]
    if "max" in found and "min" in found:
        found = [op for op in found if op not in ("max", "min")] or ["max"]
    ranking = has("ranking", "ordena", "ordenados", "top", "clasifica", "clasificacion")
    row = "divide" if has("entre", "dividido", "divide") and not has("compara") else "subtract" if has("menos", "resta", "diferencia") else "multiply" if has("multiplica", "multiplicado") else None
    return Signals(
        operation=found[0] if found else None,
        grouped=bool(re.search(r"\b(por|by)\s+\S", fold(question))),
        ranking=ranking,
        ascending=has("menor", "ascendente", "minimo") and not has("mayor"),
        comparison=has("compara", "comparar", "contra", "versus", "vs"),
        periods=has("anterior", "previo", "pasado") and has("compara", "comparado", "contra", "respecto"),
        reference=has(*REFERENCES),
        ordinal=next((ORDINALS[w] for w in words if w in ORDINALS), None),
        contradiction=any(w.startswith("contradi") for w in words) or has("discrepancias", "inconsistencias"),
        dossier=has("expediente", "dossier") or "todo lo relacionado" in exact(question),
        census=has("archivos", "documentos", "ficheros") and has("cuantos", "censo", "inventario"),
        duplicates=has("duplicados", "duplicado", "repetidos", "identicos"),
        formats=has("formato", "formatos", "extension", "extensiones"),
        evidence=has("evidencia", "fuentes", "documentas", "respaldo"),
        row_operation=row,
        category=next((k for w, k in CATEGORIES.items() if w in words), None),
    )


def named_fields(question: str, fields: list[str]) -> list[str]:
    """Fields all of whose stems stand in the question; the longest names first."""
    asked = roots(question).split()
    hit = [f for f in fields if all(any(stems_match(r, a) for a in asked) for r in roots(f).split())]
    return sorted(hit, key=lambda f: (-len(f.split()), fields.index(f)))


def group_field(question: str, fields: list[str]) -> tuple[str | None, list[str]]:
    """The field after the last ` por `: full name, else a single partial match; else what it could be."""
    m = re.search(r".*\b(?:por|by)\s+(.+)$", fold(question).rstrip("?¿ ."))
    if not m:
        return None, []
    tail = roots(m[1]).split()
    full = [f for f in fields if all(r in tail for r in roots(f).split())]
    if full:
        return max(full, key=lambda f: len(f.split())), []
    partial = [f for f in fields if any(len(t) >= 4 and any(r.startswith(t) or t.startswith(r) for r in roots(f).split()) for t in tail)]
    return (partial[0], []) if len(partial) == 1 else (None, partial[:6])


def written_filters(question: str, fields: list[str]) -> list[tuple[str, str]]:
    """`Campo: valor` pairs; a time like 10:30 is none."""
    known = {roots(f): f for f in fields}
    out = []
    for m in re.finditer(r"([^\W\d_][\w ]{0,60}?)\s*[:=]\s*([^,;:?¿]+?)(?=\s+(?:y|con|and)\s+[^\W\d_][\w ]*[:=]|[,;?]|$)", question):
        words = m[1].split()
        for k in range(len(words)):
            name = known.get(roots(" ".join(words[k:])))
            if name:
                out.append((name, m[2].strip().strip('"«»')))
                break
    return out


def quoted(question: str) -> str | None:
    m = re.search(r'["«“]([^"»”]+)["»”]', question)
    return m[1] if m else None


@dataclass(frozen=True)
class Token:
    kind: str  # quote, file or identifier
    text: str


def exact_tokens(question: str) -> list[Token]:
    """What a question gives to be taken literally: quotes, else file names, else mixed identifiers.

    A folder with a number before its name (`02_reportes`) is no identifier.
    """
    quotes = [Token("quote", m[1]) for m in re.finditer(r'["«“]([^"»”]+)["»”]', question)]
    if quotes:
        return quotes
    words = [w.strip("?¿!¡,;:()").rstrip(".") for w in question.split()]
    names = [Token("file", w) for w in words if re.search(rf"\.(?:{'|'.join(EXTENSIONS)})$", w, re.I)]
    if names:
        return names
    ordinal = re.compile(r"\d{1,3}_[^\W\d]+")
    return [Token("identifier", w) for w in words if identifier(w) and not ordinal.fullmatch(w)]


def asked_kinds(question: str) -> tuple[str, ...]:
    """Kinds of value that a question word asks for."""
    return next((CATEGORY_WORDS[w] for w in exact(question).split() if w in CATEGORY_WORDS), ())


def resolve_field(question: str, fields: list[str]) -> tuple[str | None, list[str]]:
    """The field that a question names, or what it could be: all words of one name, else the head word of just one.

    A name inside a longer one that is named too gives way to it; equally long ones are a tie.
    """
    named = named_fields(question, fields)
    named = [f for f in named if not any(f != g and set(roots(f).split()) < set(roots(g).split()) for g in named)]
    if named:
        return (named[0], []) if len(named) == 1 else (None, named[:6])
    asked = roots(question).split()
    heads = [f for f in fields if any(stems_match(roots(f).split()[0], a) for a in asked if len(a) >= 4)]
    return (heads[0], []) if len(heads) == 1 else (None, heads[:6])


def field_roles(question: str, fields: list[str]) -> dict[str, str]:
    """restriction: a field with its value (`Estado: X`, `con estado X`); asked: named otherwise; unmarked: not named."""
    written = {c for c, _ in written_filters(question, fields)}
    named = set(named_fields(question, fields))
    folded = fold(question)
    bound = {f for f in named if re.search(rf"\b(?:con|cuyo|cuya|de|en)\s+(?:el\s+|la\s+)?{re.escape(fold(f))}\s+(?:de\s+|es\s+|igual\s+a\s+)?\S", folded) and not re.search(rf"\b(?:cual|que)\s+(?:\w+\s+){{0,3}}{re.escape(fold(f))}", folded)}
    return {f: "restriction" if f in written | bound else "asked" if f in named else "unmarked" for f in fields}


def closed_answer(question: str, stated: list[str]) -> bool | None:
    """Does the document say what a yes/no question supposes? None if it is no such question or nothing can be said.

    The supposition is one of the values, or the field itself for yes/no values; `no` before it turns it round.
    """
    words = exact(question).split()
    if not words or words[0] not in ("esta", "es", "fue", "tiene", "hay", "sigue", "no"):
        return None
    turned = "no" in words
    values = [exact(v) for v in stated]
    if not values:
        return None
    if all(v in YES + NO for v in values):
        answers = {v in YES for v in values}
        return None if len(answers) > 1 else answers.pop() != turned
    said = f" {' '.join(roots(' '.join(words)).split())} "
    held = any(f" {roots(v)} " in said for v in values)
    return held != turned


def named_currency(question: str) -> str | None:
    """A currency that the question demands by its code."""
    words = re.findall(r"\b[A-Za-z]{3}\b", question)
    return next((w.upper() for w in words if w.upper() in CURRENCIES and (w.isupper() or "moneda" in exact(question))), None)
