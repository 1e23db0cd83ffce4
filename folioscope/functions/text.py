"""Folding, roots and keys of labels and values.

Column functions stay in the JVM for Latin text, which is folded by a
translation table; ``fold_any`` decomposes any script with an Arrow UDF and is
meant for ingest, where the folded column is stored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning in a label.
STOPWORDS = ["de", "del", "la", "las", "el", "los", "un", "una", "y", "e", "en", "por", "para", "con", "sin", "al", "a", "que"]

# Endings of number, then of gender: what goes, what takes its place, and the letters that a word needs to lose it.
ENDINGS = [[("ces", "z", 7), ("es", "", 7), ("s", "", 5)], [("o", "", 6), ("a", "", 6)]]

_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) == 1)
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def _text(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- Python forms, for the driver and for parsers -------------------------------------------------


def fold(text: str) -> str:
    """Lower case without accents; punctuation stays."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def exact(text: str) -> str:
    """Folded words joined by one space."""
    return " ".join(re.findall(r"[^\W_]+", fold(text)))


def root(word: str) -> str:
    """The word without its endings of number and gender, however many are stacked: `intereses` and `interés` are `inter`."""
    seen = None
    while seen != word:
        seen = word
        for kind in ENDINGS:
            fits = [(gone, put) for gone, put, least in kind if len(word) >= least and word.endswith(gone)]
            if fits:
                word = word.removesuffix(fits[0][0]) + fits[0][1]
    return word


def roots(text: str) -> str:
    return " ".join(map(root, exact(text).split()))


def content_roots(text: str) -> list[str]:
    """Roots of the words that carry meaning."""
    return [r for r in roots(text).split() if r not in STOPWORDS]


def canonical_key(label: str) -> str:
    """One key for all spellings of a field: `Montos totales` and `MONTO TOTAL` are `monto_total`."""
    return "_".join(content_roots(label) or roots(label).split())


def search_terms(text: str) -> list[str]:
    return [r for r in content_roots(text) if len(r) > 1]


def stems_match(a: str, b: str) -> bool:
    """Equal roots, or of five letters and more with one letter more at the end of one: a final e may or may not belong to it."""
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= 5 and short == long[:-1])


def identifier(text: str) -> str | None:
    """Letters and digits of a mixed identifier; None if it lacks either or holds anything else."""
    bare = re.sub(r"[-_/.\s]", "", fold(text))
    return bare if {unicodedata.category(c)[0] for c in bare} == {"L", "N"} else None


def column_name(index: int) -> str:
    """A, B, ..., Z, AA, ... of a zero-based column."""
    name, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def decode_entities(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(entity, char)
    return text


# ---- Column forms ---------------------------------------------------------------------------------


def folded(x) -> Column:
    """As ``fold`` for Latin text; text of one byte a character has nothing to translate."""
    text = _text(x)
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _ACCENTED, _PLAIN)))


@F.pandas_udf(T.StringType())
def fold_any(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


def words(x) -> Column:
    """Folded words as an array."""
    return F.array_remove(F.split(folded(x), r"[^\p{L}\p{N}]+"), "")


def exactly(x) -> Column:
    return F.array_join(words(x), " ")


def root_of(word: Column) -> Column:
    """As ``root``, in the JVM: a round for each letter is enough, as a round that changes anything takes one."""

    def shorter(w: Column) -> Column:
        for kind in ENDINGS:
            out = w
            for gone, put, least in reversed(kind):
                fits = (F.length(w) >= least) & w.endswith(gone)
                out = F.when(fits, F.concat(F.substring(w, F.lit(1), F.length(w) - len(gone)), F.lit(put))).otherwise(out)
            w = out
        return w

    return F.reduce(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), word, lambda w, _: shorter(w))


def canonical_key_of(x) -> Column:
    """As ``canonical_key``, in the JVM."""
    every = F.transform(words(x), root_of)
    telling = F.filter(every, lambda w: ~w.isin(*STOPWORDS))
    return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(every), "_")


def identifier_of(x) -> Column:
    """As ``identifier``, in the JVM; what has no letter or no digit, as most values, is not folded."""
    bare = F.regexp_replace(folded(x), r"[-_/.\s]", "")
    return F.when(_text(x).rlike(r"\p{L}"), F.when(_text(x).rlike(r"\p{N}"), F.when(bare.rlike(r"^[\p{L}\p{N}]+$"), bare)))


def kind_of_path(path) -> Column:
    """Stem of a file name without its leading number; null if nothing but digits is left."""
    stem = F.regexp_replace(F.element_at(F.split(_text(path), "/"), -1), r"\.[^.]*$", "")
    rest = F.regexp_replace(stem, r"^[0-9]+[_-]", "")
    name = F.array_join(words(rest), "_")
    return F.when(~name.rlike(r"^[0-9_]*$"), name)


def holds_phrase(x, phrase: str) -> Column:
    """The words of the phrase stand together in the text."""
    return may_hold(x, phrase) & F.concat(F.lit(" "), exactly(x), F.lit(" ")).contains(f" {exact(phrase)} ")


def holds_value(x, value: str) -> Column:
    """The literal occurs, not as part of a longer word or code."""
    return folded(x).contains(fold(value)) & folded(x).rlike(rf"(?<![\p{{L}}\p{{N}}_/.-])\Q{fold(value)}\E(?![\p{{L}}\p{{N}}_/.-])")


def _matches(term: str, least_prefix: int):
    return lambda w: (w == term) | (root_of(w) == term) | (w.startswith(term) if len(term) >= least_prefix else F.lit(False))


def holds_terms(x, terms: list[str], least_prefix: int = 4) -> Column:
    """Each term is a root of the text, or the beginning of one of its words."""
    found = F.lit(True)
    for term in terms:
        if len(term) >= least_prefix and re.fullmatch(r"[^\W_]+", term) and not term.endswith("z"):
            # A root is the beginning of its word, except for z, which stands for ces.
            begins = folded(x).contains(term) & folded(x).rlike(rf"(?:^|[^\p{{L}}\p{{N}}])\Q{term}\E")
            found = found & begins
        else:
            found = found & F.exists(words(x), _matches(term, least_prefix))
    return found


def may_hold(x, phrase: str) -> Column:
    """Cheap and necessary for the phrase's words to stand in the text: its longest one is in there somewhere."""
    return folded(x).contains(max(exact(phrase).split(), key=len, default=""))


def excerpt(x, needle: str, size: int = 360) -> Column:
    """At most ``size`` characters around the first match, or from the start."""
    text = _text(x)
    at = F.instr(folded(text), fold(needle))
    begin = F.greatest(F.lit(1), at - F.lit((size - len(needle)) // 2))
    return F.substring(text, begin, F.lit(size))
