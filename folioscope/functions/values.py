"""Typed values and exact arithmetic on four decimals."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, root_of

AMOUNT = "decimal(24,4)"
# What a currency sign states; $ and ¥ name no currency.
SIGNS = {"€": "EUR", "£": "GBP", "₹": "INR", "₩": "KRW"}
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
KIND_ORDER = ["money", "date", "percentage", "number", "state", "text"]

# The grammar of amounts, and another spelling of a month.
MONTH_SPELLINGS = {"setiembre": "septiembre"}
_MONEY = r"^(-?)\s*([$¥€£₹₩]?)\s*(-?)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*([A-Za-z]{3})?$"


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group)


def money_amount(x: Column) -> Column:
    """Amount of a money literal; null if it is none."""
    sign, symbol, inner, number, code = (_part(x, _MONEY, i) for i in range(1, 6))
    stated = F.lit(None).cast("string")
    for mark, name in SIGNS.items():
        stated = F.when(symbol == mark, name).otherwise(stated)
    agrees = stated.isNull() | (code == "") | (F.upper(code) == stated)
    valid = x.rlike(_MONEY) & ((symbol != "") | (code != "")) & ~((sign != "") & (inner != "")) & agrees
    amount = F.regexp_replace(number, ",", "").try_cast(AMOUNT)
    return F.when(valid, F.when((sign != "") | (inner != ""), -amount).otherwise(amount))


def money_currency(x: Column) -> Column:
    symbol, code = _part(x, _MONEY, 2), _part(x, _MONEY, 5)
    out = F.when(code != "", F.upper(code))
    for mark, name in SIGNS.items():
        out = out.when(symbol == mark, name)
    return out


def date_value(x: Column) -> Column:
    """ISO date or `D de <mes> de YYYY`, in 1900..2200 and on the calendar."""
    written = r"^([0-9]{1,2})\s+de\s+([a-z]+)\s+de\s+([0-9]{4})$"
    low = folded(x)
    name = _part(low, written, 2)
    for spelling, usual in MONTH_SPELLINGS.items():
        name = F.when(name == spelling, usual).otherwise(name)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    day = F.lpad(_part(low, written, 1), 2, "0")
    iso = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), x).when(low.rlike(written) & (month > 0), F.concat_ws("-", _part(low, written, 3), F.lpad(month.cast("string"), 2, "0"), day))
    found = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(F.year(found).between(1900, 2200), found)


def plain_number(x: Column) -> Column:
    bare = F.regexp_replace(x, ",", "")
    return F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]+$"), bare.try_cast("decimal(38,12)"))


def exact_amount(x: Column) -> Column:
    """Four decimals at most; more of them are a number, but no amount."""
    bare = F.regexp_replace(x, ",", "")
    return F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]{1,4}$|^-?[0-9]+$"), bare.try_cast(AMOUNT))


def percentage(x: Column) -> Column:
    return F.when(x.endswith("%"), plain_number(F.trim(F.regexp_replace(x, "%$", ""))))


def kind_of(label: Column, x: Column) -> Column:
    """money, date, percentage, number, state or text: the first that fits."""
    return (
        F.when(money_amount(x).isNotNull(), "money")
        .when(date_value(x).isNotNull(), "date")
        .when(percentage(x).isNotNull(), "percentage")
        .when(plain_number(x).isNotNull(), "number")
        .when(F.exists(F.split(folded(label), r"[^\p{L}\p{N}]+"), lambda w: root_of(w) == "estad"), "state")
        .otherwise("text")
    )


def filter_key(kind: Column, x: Column) -> Column:
    """What two values must share to be equal for a filter: 1000 = 1,000, but 50 is not 50%."""
    number = F.coalesce(percentage(x), plain_number(x))
    return F.when(kind.isin("number", "percentage"), F.concat_ws("|", kind, number.cast("string"))).otherwise(F.concat_ws("|", F.lit("literal"), folded(x)))


def exact_mean(total: Column, n: Column) -> Column:
    """Mean at four decimals, half away from zero, by integers: dividing first would round twice."""
    units = (total * 10_000).cast("decimal(38,0)")
    whole = _div(2 * F.abs(units) + n, 2 * n)
    return (F.signum(total).cast("int") * whole.cast("decimal(28,0)") * F.lit(Decimal("0.0001"))).cast(AMOUNT)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative numbers; null for a zero divisor."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return F.floor(F.try_divide(a - a % F.nullif(b, F.lit(0).cast("decimal(38,0)")), b) + F.lit(Decimal("0.5")))


def exact_ratio(a: Column, b: Column, scale: int = 1) -> Column:
    """scale * a / b at four decimals, half away from zero; null if b is zero."""
    up = (F.abs(a) * 10_000).cast("decimal(38,0)") * scale * 10_000
    down = (F.abs(b) * 10_000).cast("decimal(38,0)")
    whole = _div(2 * up + down, 2 * down)
    return F.when(b != 0, (F.signum(a).cast("int") * F.signum(b).cast("int") * whole.cast("decimal(28,0)") * F.lit(Decimal("0.0001"))).cast(AMOUNT))


def exact_product(a: Column, b: Column) -> Column:
    """a * b at four decimals, half away from zero; of factors from 10^15 on, at six decimals first; null beyond 38 digits."""
    narrow = "decimal(19,4)"
    small = F.round(F.try_multiply(a.try_cast(narrow), b.try_cast(narrow)), 4).try_cast("decimal(38,4)")
    return F.coalesce(small, F.round(F.try_multiply(a, b), 4).try_cast("decimal(38,4)"))


# ---- driver forms ---------------------------------------------------------------------------------


def rounded(x: Decimal, places: int = 4) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)


def render(x: Decimal, places: int = 2) -> str:
    """Thousands separated; decimals beyond ``places`` only if they are not zero."""
    text = f"{rounded(x):,.4f}".rstrip("0")
    whole, _, part = text.partition(".")
    return f"{whole}.{part.ljust(places, '0')}" if places or part else whole


def render_money(x: Decimal, currency: str | None) -> str:
    return f"{render(x)} {currency}" if currency else render(x)


def render_signed(x: Decimal, currency: str | None = None) -> str:
    return ("+" if x > 0 else "") + render_money(x, currency)


def render_total(x: Decimal, inputs: list[str]) -> str:
    """A total in the notation of its inputs: their sign or code of currency, and decimals only if one of them has any."""
    import re

    places = 2 if any(re.search(r"\.[0-9]", i) for i in inputs) or x != x.to_integral_value() else 0
    text = render(abs(x), places)
    signs = {m[0] for i in inputs if (m := re.search(r"[$¥€£₹₩]", i))}
    codes = {m[0].upper() for i in inputs if (m := re.search(r"[A-Za-z]{3}$", i.strip()))}
    percent = all(i.strip().endswith("%") for i in inputs) and bool(inputs)
    marked = (signs.pop() if len(signs) == 1 else "") + text + ("%" if percent else "") + (f" {codes.pop()}" if len(codes) == 1 else "")
    return ("-" if x < 0 else "") + marked
