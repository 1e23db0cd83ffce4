"""Folders named in a question; a folder that does not exist is reported, never replaced."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import exact, roots, search_terms, stems_match


@dataclass(frozen=True)
class Folder:
    state: str  # found, missing, not_named
    name: str | None = None


def cued(question: str) -> str | None:
    for pattern in (r'(?:carpeta|folder|directorio)\s+["«“]([^"»”]+)["»”]', r"(?:carpeta|folder|directorio)\s+(?:de\s+|llamada\s+)?([\w./-]+)", r"\b(\d{2}_[\w-]+)"):
        m = re.search(pattern, question, re.I)
        if m:
            return m[1].strip()
    return None


def explicit(question: str, origins: list[str]) -> Folder:
    """A folder that is quoted, cued by a word for folder, or written like `02_reportes`."""
    wanted = cued(question)
    if wanted is None:
        return Folder("not_named")
    for origin in origins:
        if exact(origin) == exact(wanted) or exact(origin.rpartition("/")[2]) == exact(wanted):
            return Folder("found", origin)
    return Folder("missing", wanted)


def fuzzy(question: str, origins: list[str]) -> str | None:
    """The folder whose name the question says best: whole phrase, descriptive part, shared stems; a tie names none."""
    asked, terms = f" {exact(question)} ", search_terms(question)

    def score(origin: str) -> int:
        words = exact(origin).split()
        spoken = [w for w in words if not w.isdigit()]
        if f" {' '.join(words)} " in asked:
            return 200 + len(words)
        if spoken and f" {' '.join(spoken)} " in asked:
            return 100 + len(spoken)
        return sum(any(stems_match(r, t) for t in terms) for r in roots(" ".join(spoken)).split())

    scores = sorted(((score(o), o) for o in origins), reverse=True)
    return scores[0][1] if scores and scores[0][0] > 0 and (len(scores) == 1 or scores[1][0] < scores[0][0]) else None


def in_order(question: str, origins: list[str]) -> list[str]:
    """Folders that the question names, in the order it names them."""
    asked = f" {exact(question)} "
    spots = [(asked.find(f" {exact(o)} "), o) for o in origins]
    return [o for at, o in sorted(spots) if at >= 0]
