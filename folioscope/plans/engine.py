"""From a question to one DataFrame, and from its rows to an answer with evidence.

The driver reads the question, the small catalogue of fields and, for values
that are named without their field, the distinct values that the question spells
out. Everything else is one distributed query. What is ambiguous is asked back
with a reason; what does not exist is said, never replaced.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.text import exact, exactly, fold, words
from ..functions.values import render_money
from ..operators import aggregate as agg
from ..operators import relations as rel
from ..operators import scope as sc
from ..operators import search
from ..sources.tables import Corpus
from . import answers, folders
from .answers import Answer
from .language import Signals, exact_tokens, field_roles, group_field, named_currency, named_fields, quoted, signals, written_filters

CONVERSATIONS, CITATIONS = 32, 18
NUMERIC = ("money", "number", "percentage")
TITLES = {"sum": "Suma", "average": "Promedio", "min": "Mínimo", "max": "Máximo", "count": "Cantidad"}


@dataclass(frozen=True)
class Scope:
    """A set of documents as a predicate, so that it survives a new index."""

    filters: tuple[tuple[str, str], ...] = ()
    origin: str | None = None
    dates: tuple[str, date, date] | None = None


@dataclass
class Memory:
    scope: Scope | None = None
    concept: str | None = None
    operation: str | None = None
    pending: tuple[str, list[str]] | None = None
    cited: list[int] = field(default_factory=list)


class Engine:
    def __init__(self, corpus: Corpus, today: Callable[[], date] = date.today):
        self.corpus, self.today = corpus, today
        self.memories: OrderedDict[str, Memory] = OrderedDict()
        self.aliases: dict[str, str] = {}
        self._fields: list[tuple[str, str]] | None = None

    # ---- what the index knows

    def fields(self) -> list[tuple[str, str]]:
        """(field, kind), the most frequent first; read once an index."""
        if self._fields is None:
            rows = agg.catalogue(self.corpus.values).orderBy(F.desc("n_values"), "concept").collect()
            self._fields = [(r.concept, r.kind) for r in rows]
        return self._fields

    def names(self, *kinds: str) -> list[str]:
        return [n for n, k in self.fields() if not kinds or k in kinds]

    def alias(self, name: str, concept: str | None) -> None:
        """Another name of a field; None rejects the name."""
        if concept is None:
            self.aliases.pop(fold(name), None)
        elif concept not in self.names():
            raise ValueError(f"no field {concept}")
        else:
            self.aliases[fold(name)] = concept

    def _canonical(self, question: str) -> str:
        """The question with whole names that are aliases, the longest first, put as their fields; quotes stay as they are."""
        if not self.aliases:
            return question
        names = "|".join(re.escape(a) for a in sorted(self.aliases, key=lambda a: (-len(a), a)))
        parts = re.split(r'(["«“][^"»”]*["»”])', question)
        for i in range(0, len(parts), 2):
            low = fold(parts[i])
            if len(low) == len(parts[i]):  # folding kept every place
                for m in reversed([*re.finditer(rf"(?<!\w)(?:{names})(?!\w)", low)]):
                    parts[i] = parts[i][: m.start()] + self.aliases[m[0]] + parts[i][m.end() :]
        return "".join(parts)

    def search(self, text: str, most: int = 12) -> DataFrame:
        """Documents with a score, by the first path that finds any: file name, identifier, quote, written pairs, blended text."""
        c, tokens = self.corpus, exact_tokens(text)
        paths: list[DataFrame] = []
        for token in tokens:
            if token.kind == "file":
                paths.append(sc.by_path(c.documents, token.text).select("document_id", F.lit(150).alias("score")))
            elif token.kind == "identifier":
                paths += [sc.by_identifier(c.values, token.text), sc.by_identifier(c.values, token.text, "prefix")]
            else:
                paths.append(search.strict_exact(c.documents, c.values, c.chunks, token.text))
        pairs = written_filters(text, self.names())
        if pairs:
            paths.append(search.strict_structured(c.documents, c.values, pairs))
        for found in paths:
            if not found.isEmpty():
                return found.orderBy(F.desc("score"), "document_id")
        return search.free_text(c.chunks, text, most)

    def invalidate(self) -> None:
        """After a new index: scopes stay, as they are predicates; results and the list of fields go."""
        self._fields = None
        for memory in self.memories.values():
            memory.cited, memory.pending = [], None

    def reset(self, conversation: str) -> None:
        self.memories.pop(conversation, None)

    # ---- asking

    def ask(self, question: str, conversation: str = "") -> Answer:
        if not question.strip():
            raise ValueError("empty question")
        memory = self.memories.pop(conversation, Memory())
        self.memories[conversation] = memory
        while len(self.memories) > CONVERSATIONS:
            self.memories.popitem(last=False)
        if memory.pending:
            original, options = memory.pending
            memory.pending = None
            if set(exact(question).split()) & {"todos", "todas", "ambos", "ambas"} and len(question.split()) <= 4:
                each = [self._answer(self._canonical(f"{original} {o}"), memory) for o in options]
                return Answer("\n".join(f"{o}: {a.text}" for o, a in zip(options, each)), all(a.verified for a in each), notices=[n for a in each for n in a.notices])
            said = exact(question)  # a short reply that names an option; anything longer is a new question
            chosen = next((o for o in options if f" {exact(o)} " in f" {said} " and len(said.split()) <= len(o.split()) + 3), None)
            if chosen:
                question = f"{original} {chosen}"
        answer = self._answer(self._canonical(question), memory)
        if answer.reason and answer.options:
            memory.pending = (question, answer.options)
        if answer.citations:
            memory.cited = answer.citations
            answer.notices += self._notices(answer.citations)
        return answer

    def _notices(self, ids: list[int]) -> list[str]:
        """Which cited documents are copies of one another, and which were read with doubt."""
        cited = self.corpus.documents.where(F.col("document_id").isin(ids))
        copies = rel.duplicates(cited).count()
        doubtful = rel.unreliable(cited).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()
        return [f"{copies} grupos de documentos citados son idénticos."] * bool(copies) + [f"{r.reason}: {r.n} documentos citados" for r in doubtful]

    def _answer(self, question: str, memory: Memory) -> Answer:
        s = signals(question)
        if "/" in question:
            readings = periods.slash_readings(question)
            if not readings and periods.SLASH.search(question):
                return Answer("La fecha no existe en el calendario.", reason="fecha_invalida")
            if len(readings) == 2:
                return Answer("La fecha admite dos lecturas.", reason="fecha_ambigua", options=[d.isoformat() for d in readings])
        if s.duplicates:
            return self._table(rel.duplicates(self.corpus.documents), "Grupos de documentos idénticos", "content_hash")
        if s.census and not s.operation == "sum" and not self._named(question, *NUMERIC):
            if s.formats:
                return self._table(rel.by_format(self.corpus.documents, self.corpus.unindexed), "Documentos por formato", "extension")
            found = self._scope(question, s, memory)
            if isinstance(found, Answer):
                return found
            if found == Scope():
                return self._table(rel.census(self.corpus.documents, self.corpus.unindexed, ["origin"] if s.grouped else ["kind"]), "Censo de archivos", "origin" if s.grouped else "kind")
            memory.scope = found
            return self._count(found)
        literal = quoted(question)
        if literal and not s.operation:
            hits = search.literal_hits(self.corpus.chunks, literal).orderBy("document_id")
            return self._cited(hits, f"Documentos que dicen «{literal}»")
        tokens = [t.text for t in exact_tokens(question) if t.kind == "identifier"]
        if s.ordinal and memory.cited:
            if s.ordinal > len(memory.cited):
                return Answer(f"El resultado anterior cita {len(memory.cited)} documentos.", reason="referencia_sin_contexto")
            return answers.about_documents(self.corpus, [memory.cited[s.ordinal - 1]], question)
        if tokens and not (s.dossier or s.contradiction or s.grouped or s.ranking):
            found = answers.identified(self.corpus, tokens, question, s)
            if found is not None:
                return found
        if s.reference and memory.scope is None:
            return Answer("No hay un resultado anterior al que referirse.", reason="referencia_sin_contexto")
        if s.evidence:
            if memory.scope is None:
                return Answer("No hay un cálculo que respaldar.", reason="sin_contexto")
            return self._cited(self._documents(memory.scope), "Documentos del último resultado")
        if s.contradiction or s.dossier:
            return self._relations(question, s)
        found = self._scope(question, s, memory)
        if isinstance(found, Answer):
            return found
        operation = s.operation or (memory.operation if s.reference or self._elliptical(question, memory) else None)
        if s.row_operation and exact(question).split().count("total") > 1:
            return Answer("¿La operación es entre los totales o dentro de cada documento?", reason="operacion_entre_totales_ambigua", options=["entre los totales", "en cada documento"])
        if s.row_operation and len(self._named(question, *NUMERIC)) == 2:
            return self._row_operation(question, s, found)
        if operation is None and not (s.comparison or s.ranking):
            if found != Scope():
                memory.scope = found
                return self._count(found)
            return self._cited(self.search(question), "Documentos más cercanos")
        if operation == "count" and not self._named(question, *NUMERIC) and not s.grouped:
            memory.scope, memory.operation = found, "count"
            return self._count(found)
        concept = self._concept(question, s, memory)
        if isinstance(concept, Answer):
            return concept
        memory.scope, memory.concept, memory.operation = found, concept, operation or "sum"
        return self._calculate(question, s, found, concept, operation or "sum")

    # ---- resolving

    def _named(self, question: str, *kinds: str) -> list[str]:
        return named_fields(question, self.names(*kinds))

    def _concept(self, question: str, s: Signals, memory: Memory) -> str | Answer:
        named = self._named(question, *NUMERIC)
        if named:
            return named[0]
        if (s.reference or self._elliptical(question, memory)) and memory.concept:
            return memory.concept
        fits = self.names(s.category) if s.category else self.names(*NUMERIC)
        if len(fits) == 1:
            return fits[0]
        return Answer("¿Sobre qué campo?", reason="campo_ambiguo", options=fits[:6]) if fits else Answer("No hay campos numéricos.", reason="campo_ambiguo")

    def _elliptical(self, question: str, memory: Memory) -> bool:
        """`¿Y de X?`: the last calculation with a changed scope."""
        return exact(question).startswith("y ") and memory.scope is not None and memory.concept is not None

    def _mentioned(self, question: str) -> DataFrame:
        """Values of text and state fields that the question spells out; those of one or two letters in capitals."""
        labels = self.corpus.values.where(F.col("concept").isin(self.names("state", "text")))
        capitals = F.lit(" ".join(re.findall(r"(?<!\w)[A-ZÁÉÍÓÚÑ0-9]{1,2}(?!\w)", question)))
        short = F.array_contains(F.split(F.lower(capitals), " "), F.col("literal_value"))
        return sc.mentioned_values(labels, question).where((F.length("literal_value") > 2) | short)

    def _folder(self, question: str) -> str | None | Answer:
        """A folder that is cued must exist; else one whose whole name the question says, if just one."""
        origins = self.corpus.documents.select("origin").distinct()
        cued = folders.cued(question)
        if cued is not None:
            wanted = exact(cued)
            hit = origins.where((exactly("origin") == wanted) | (exactly(F.element_at(F.split("origin", "/"), -1)) == wanted)).orderBy("origin").limit(2).collect()
            return hit[0].origin if hit else Answer(f"No existe la carpeta «{cued}».", reason="carpeta_inexistente")
        asked = F.lit(f" {exact(question)} ")
        near = origins.where(asked.contains(F.concat(F.lit(" "), exactly("origin"), F.lit(" "))))
        near = near.orderBy(F.desc(F.size(words("origin"))), "origin").limit(2).collect()  # the longest name wins, if one alone is longest
        return folders.fuzzy(question, [r.origin for r in near])

    def _scope(self, question: str, s: Signals, memory: Memory) -> Scope | Answer:
        """Written pairs rule; else values that the question names; then folder and period; inherited on reference or ellipsis."""
        inherits = memory.scope and (s.reference or self._elliptical(question, memory))
        values, base = self.corpus.values, memory.scope if inherits else Scope()
        pairs = written_filters(question, self.names())
        for concept, value in pairs:
            if not values.where(sc.equals(concept, value)).limit(1).count():
                near = [r.text_value for r in sc.near_values(values, concept, value).collect()]
                return Answer(f"Ningún documento tiene {concept}: {value}.", reason="valor_inexistente", options=near)
        if not pairs and not s.comparison:
            fields: dict[str, list[str]] = {}
            for r in self._mentioned(question).orderBy("literal_value", "concept").collect():  # values that the question spells out
                fields.setdefault(r.literal_value, []).append(r.concept)
            roles = field_roles(question, self.names())
            for v, own in fields.items():
                marked = [c for c in own if roles.get(c) == "restriction"] or [c for c in own if roles.get(c) != "asked"]
                if len(marked) > 1:  # the field that most documents state it in, if it is most by far
                    usual = sc.usual_fields(values.where(F.col("concept").isin(marked)), v).limit(2).collect()
                    marked = [usual[0].concept] if len(usual) == 1 or usual[0].n_documents >= 4 * usual[1].n_documents else marked
                if len(marked) == 1 and fold(marked[0]) != v:
                    pairs.append((marked[0], v))
        kept = [f for f in base.filters if not s.reference and f[0] not in {c for c, _ in pairs} or s.reference]
        out = replace(base, filters=tuple(dict.fromkeys([*kept, *pairs])))
        folder = self._folder(question)
        if isinstance(folder, Answer):
            return folder
        if folder:
            out = replace(out, origin=folder)
        period = periods.parse(question, self.today())
        if period and not s.periods:
            days = self.names("date")
            by = named_fields(question, days) or days
            if len(by) > 1 and not named_fields(question, days):
                return Answer("¿Qué fecha?", reason="campo_fecha_ambiguo", options=by[:8])
            if by:
                out = replace(out, dates=(by[0], period.first, period.last))
        return out

    def _documents(self, scope: Scope) -> DataFrame:
        return sc.resolve(self.corpus.documents, self.corpus.values, scope.filters, scope.origin, scope.dates)

    # ---- answering

    def _count(self, scope: Scope) -> Answer:
        found = self._documents(scope)
        ids = [r.document_id for r in found.limit(CITATIONS).collect()]
        n = found.count() if len(ids) == CITATIONS else len(ids)
        return Answer(f"{n:,} documentos", True, rows=found, citations=ids)

    def _calculate(self, question: str, s: Signals, scope: Scope, concept: str, operation: str) -> Answer:
        values, documents = self.corpus.values, self._documents(scope)
        if s.comparison and not s.periods:
            sides = self._mentioned(question).orderBy(F.instr(F.lit(fold(question)), F.col("literal_value"))).limit(3).collect()
            if len(sides) != 2:
                return Answer("Faltan los dos lados de la comparación.", reason="comparacion_incompleta", options=[r.literal_value for r in sides])
            side = lambda r: agg.operands(values, concept, sc.with_filters(documents, values, [(r.concept, r.literal_value)]))
            return self._table(rel.compare(side(sides[0]), side(sides[1]), operation), f"{concept}: {sides[0].literal_value} y {sides[1].literal_value}", "currency")
        if s.periods:
            period = periods.parse(question, self.today())
            days = self.names("date")
            by = named_fields(question, days) or days[:1]
            if period is None:
                return Answer("¿Respecto de qué periodo?", reason="periodo_sin_referencia")
            inside = values.join(documents, "document_id", "left_semi")
            return self._table(rel.compare_periods(inside, concept, by[0], period, operation), f"{concept}: periodo anterior y actual", "currency")
        rows = agg.operands(values, concept, documents)
        if s.grouped or s.ranking:
            group, options = group_field(question, self.names("text", "state"))
            if group is None:
                return Answer("¿Por qué campo agrupar?", reason="agrupacion_ambigua", options=options)
            rows = agg.labelled(rows, values.where(F.col("concept") == group))
            table = rel.rank(rows, "grp", operation, not s.ascending) if s.ranking else agg.compute(rows, operation, ["grp"])
            return self._table(table, f"{TITLES[operation]} de {concept} por {group}", "grp")
        table = agg.aggregate(values, documents, concept, operation, named_currency(question))
        found = table.orderBy("currency").collect()
        if found[0].value is None and operation != "count":
            kind = dict(self.fields()).get(concept)
            table = agg.compute_category(values, documents, kind, operation) if kind in NUMERIC else None
            by_kind = [] if table is None else [r for r in table.orderBy("currency").collect() if r.value is not None]
            if by_kind:  # the only value of the kind in each document stands in for the field that none has
                lines = [f"{TITLES[operation]} de los datos de tipo {kind}: {render_money(r.value, r.currency)}" for r in by_kind]
                r = by_kind[0]
                notice = f"Ningún documento del alcance ({r.n_scope:,}) tiene {concept}; calculados {r.n_calculated:,}, con varios datos {r.n_several:,}, sin dato {r.n_none:,}"
                return Answer("\n".join(lines), rows=table, notices=[notice])
        if found[0].value is None:
            return Answer(f"Ningún documento del alcance ({found[0].n_scope:,}) tiene {concept}.", rows=table)
        lines = [f"{TITLES[operation]} de {concept}: {render_money(r.value, r.currency)}" for r in found]
        r = found[0]
        notice = f"Alcance {r.n_scope:,}: calculados {r.n_calculated:,}, sin el campo {r.n_missing:,}, inválidos {r.n_invalid:,}, otra moneda {r.n_currency:,}"
        cited = list(dict.fromkeys(x.document_id for x in agg.sampled_citations(rows, "currency", CITATIONS).collect()))
        return Answer("\n".join(lines), all(x.verified for x in found), rows=table, citations=cited, notices=[notice])

    def _row_operation(self, question: str, s: Signals, scope: Scope) -> Answer:
        named = sorted(self._named(question, *NUMERIC), key=lambda f: fold(question).find(fold(f).split()[0]))
        inside = self.corpus.values.join(self._documents(scope), "document_id", "left_semi")
        table = agg.row_totals(agg.row_operation(inside, named[0], named[1], s.row_operation))
        return self._table(table, f"{named[0]} y {named[1]}", "unit", "issue")

    def _relations(self, question: str, s: Signals) -> Answer:
        named = named_fields(question, self.names("text", "state"))
        if s.contradiction:
            if len(named) < 2:
                return Answer("¿Qué clave y qué campo?", reason="campo_ambiguo", options=self.names("text", "state")[:6])
            key, concept = sorted(named[:2], key=lambda f: dict(self.fields())[f] == "state")
            return self._table(rel.contradictions(self.corpus.values, key, concept), f"Contradicciones de {concept} por {key}", "key")
        wanted = question.split()[-1].strip("?.¿")
        key = named[0] if named else self.names("text")[0]
        found = [r.key for r in rel.identifier_candidates(self.corpus.values, key, wanted).collect()]
        if len(found) != 1:
            return Answer("¿Qué identificador?", reason="identificador_ambiguo", options=found)
        return self._table(rel.dossier(self.corpus.values, key, found[0], self.names()), f"Expediente {found[0]}", "concept")

    def _table(self, table: DataFrame, title: str, *order: str) -> Answer:
        """The first rows as text; the whole result stays a DataFrame."""
        shown = (table if not order else table.orderBy(*order)).limit(CITATIONS + 1).collect()
        lines = [" | ".join("" if x is None else str(x) for x in r) for r in shown[:CITATIONS]]
        more = ["…"] if len(shown) > CITATIONS else []
        return Answer("\n".join([title, " | ".join(table.columns), *lines, *more]), bool(shown) and all(getattr(r, "reliable", True) for r in shown), rows=table)

    def _cited(self, hits: DataFrame, title: str) -> Answer:
        ids = [r.document_id for r in hits.limit(CITATIONS).collect()]
        n = hits.count() if len(ids) == CITATIONS else len(ids)
        return Answer(f"{title}: {n:,}" if ids else "No hay evidencia suficiente.", bool(ids), rows=hits, citations=ids)


def claims_of(text: str) -> list[str]:
    """Numbers and proper names that a text states."""
    numbers = re.findall(r"\d[\d,]*(?:\.\d+)?", text)
    names = re.findall(r"(?<![.!?¿¡]\s)(?<!^)\b[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)*", text)
    return list(dict.fromkeys([*numbers, *names]))


def supported(claims: list[str], evidence: list[str]) -> list[str]:
    """Numbers and names of a text that no evidence states literally: an answer with any is not verified."""
    whole = " ".join(map(fold, evidence))
    return [c for c in claims if fold(c) not in whole]
