"""Calendar periods named in a question; the day that counts as today is always given."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from .text import fold
from .values import MONTH_SPELLINGS, MONTHS


@dataclass(frozen=True)
class Period:
    first: date
    last: date
    unit: str = "custom"

    def previous(self) -> Period:
        """The period of the same unit, or length, right before."""
        if self.unit == "month":
            return month((self.first - timedelta(1)).year, (self.first - timedelta(1)).month)
        if self.unit == "year":
            return year(self.first.year - 1)
        days = (self.last - self.first).days + 1
        return Period(self.first - timedelta(days), self.first - timedelta(1))


def month(y: int, m: int) -> Period:
    return Period(date(y, m, 1), date(y, m, calendar.monthrange(y, m)[1]), "month")


def year(y: int) -> Period:
    return Period(date(y, 1, 1), date(y, 12, 31), "year")


def _iso(text: str) -> date | None:
    try:
        found = date.fromisoformat(text)
    except ValueError:
        return None
    return found if 1900 <= found.year <= 2200 else None


def parse(question: str, today: date) -> Period | None:
    """este mes, mes pasado, este año, año pasado, pairs of ISO dates, desde, hasta, month names, years."""
    q = fold(question)
    for spelling, usual in MONTH_SPELLINGS.items():
        q = re.sub(rf"\b{spelling}\b", usual, q)
    days = [d for d in map(_iso, re.findall(r"\d{4}-\d{2}-\d{2}", q)) if d]
    if len(days) >= 2:
        return Period(min(days[:2]), max(days[:2]))
    if len(days) == 1:
        if re.search(r"\b(desde|a partir)\b", q):
            return Period(days[0], date(2200, 12, 31))
        if re.search(r"\bhasta\b", q):
            return Period(date(1900, 1, 1), days[0])
        return Period(days[0], days[0])
    this = month(today.year, today.month)
    if re.search(r"\beste mes\b", q):
        return this
    if re.search(r"\b(mes (pasado|anterior)|ultimo mes)\b", q):
        return this.previous()
    if re.search(r"\beste ano\b", q):
        return year(today.year)
    if re.search(r"\bano (pasado|anterior)\b", q):
        return year(today.year - 1)
    years = [int(y) for y in re.findall(r"\b((?:19|20|21)\d{2})\b", q)]
    for i, name in enumerate(MONTHS, 1):
        if re.search(rf"\b{name}\b", q):
            return month(years[0] if years else today.year, i)
    return year(years[0]) if years else None


SLASH = re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b")


def slash_readings(text: str) -> list[date]:
    """The calendar readings of D/M/Y and M/D/Y: none is impossible, two are ambiguous."""
    m = SLASH.search(text)
    out = []
    if m:
        a, b, y = map(int, m.groups())
        for mm, dd in ((b, a), (a, b)):
            try:
                out.append(date(y, mm, dd))
            except ValueError:
                pass
    return sorted(set(out))
