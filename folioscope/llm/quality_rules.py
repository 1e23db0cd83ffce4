"""Quality rules from the divergence between a document and its language.

Two histograms describe a document: the classes of its characters, and the
words that are common in its language (every other word is one more bin). The
references are the same histograms over all documents of that language. A
document whose Jensen-Shannon distance from either reference exceeds a limit
is rejected, unless it is too short for that histogram to mean anything. Plain
counts (words, symbols, repeated lines and windows) give the base rule.

Only DataFrame functions run. A common word is one that makes up at least
``common_share`` of its language's words, so there are at most
1 / common_share of them for each language. The references are tables with a
row for each language, written first: Spark broadcasts them as long as they are
small and joins by language beyond that. Documents with a null language form a
language of their own.

Null text has no words: all counts are 0 and the base rule rejects it. A null
doc_id and repeated rows are kept as they are; equal rows get equal verdicts,
and a distance that is exactly the limit is within it. Very long texts are
judged whole, by one task each. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = ("upper", "other_letter", "digit", "space", "punctuation", "symbol", "rest")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A word is common if it makes up this share of its language's words.
    common_share: float = 0.005
    #: Common words of all languages up to which they are looked up in one list.
    listed_words: int = 4096
    #: Jensen-Shannon distances (square root of the divergence in bits) allowed.
    char_distance: float = 0.28
    word_distance: float = 0.42
    #: Characters and words below which the histograms are not judged.
    char_guard: int = 200
    word_guard: int = 60


def let(value: Column, then) -> Column:
    """Evaluate ``value`` once and use it in ``then``, also inside lambdas."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def count_of(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text has; runs of all others go at once."""
    return F.length(F.regexp_replace(text, f"[^{re.escape(chars)}]+", ""))


def repeat_words(words: Column) -> Column:
    """Words inside those 3-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, repeated))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang with words and the plain counts."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def common_words(docs: DataFrame, share: float) -> DataFrame:
    """(lang, common, word_reference): each language's common words, and their shares with that of all others; by counts over all documents."""
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words_of(F.lower("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = materialise(counts, "word-counts")
    totals = materialise(counts.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    found = counts.join(totals, "lang").where(F.col("n") >= share * F.col("total"))
    ordered = found.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("q")))).alias("w"))
    others = F.greatest(F.lit(0.0), 1 - F.aggregate("w.q", F.lit(0.0), lambda a, x: a + x))
    return materialise(ordered.select("lang", F.col("w.word").alias("common"), F.concat("w.q", F.array(others)).alias("word_reference")), "word-references")


def is_common(words: DataFrame, most: int) -> Callable[[Column], Column]:
    """Whether a word is common in some language, by a list of all of them up to ``most``; beyond, whether it is in the row's own ``common``."""
    every = [r.word for r in words.select(F.explode("common").alias("word")).distinct().limit(most + 1).collect()]
    if len(every) > most:
        return lambda w: F.array_contains("common", w)
    return lambda w: w.isin(sorted(every)) if every else F.lit(False)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays that each sum to 1."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(0.0)))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts, the two distances and the verdict for each row of ``docs`` (doc_id, text, lang)."""
    words = common_words(docs, limits.common_share)
    known_word = is_common(words, limits.listed_words)

    text = F.col("text")
    counted = base_counts(docs)
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    spaces = F.length(text) - F.col("word_chars").cast("int")  # words hold all other characters
    kinds = [upper, letters - upper, count_of(text, "0123456789"), spaces, count_of(text, PUNCTUATION), F.col("n_symbols").cast("int")]
    hits = F.transform(F.filter("words", lambda w: known_word(F.lower(w))), F.lower)
    features = counted.join(words, "lang", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common", "word_reference",
        F.length(text).alias("n_chars"), F.array(*kinds).alias("kinds"), hits.alias("hits"),
    )
    bins = F.transform("common", lambda w: (F.size("hits") - F.size(F.array_remove("hits", w))).cast("long"))
    known = F.aggregate("word_bins", F.lit(0).cast("long"), lambda s, x: s + x)
    inner = F.aggregate("kinds", F.lit(0), lambda s, x: s + x)
    features = (
        features.withColumn("word_bins", bins)
        .withColumn("word_bins", F.concat("word_bins", F.array(F.col("n_words") - known)))
        .withColumn("char_bins", F.transform(F.concat("kinds", F.array(F.col("n_chars") - inner)), lambda x: x.cast("long")))
        .drop("kinds", "hits", "common", "n_chars")
    )
    features = materialise(features, "quality-features")

    # The references of the character classes: sums over all documents of a language.
    sums = features.groupBy("lang").agg(*[F.sum(F.col("char_bins")[i]).alias(c) for i, c in enumerate(CLASSES)])
    references = materialise(sums.select("lang", shares(F.array(*CLASSES)).alias("char_reference")), "class-references")
    distance = lambda bins, reference: F.sqrt(divergence(shares(F.col(bins)), F.col(reference)))
    n_chars = F.aggregate("char_bins", F.lit(0).cast("long"), lambda s, x: s + x)
    scored = features.join(references, "lang", "left").select(
        "*",
        F.when(n_chars >= limits.char_guard, distance("char_bins", "char_reference")).alias("char_distance"),
        F.when(F.col("n_words") >= limits.word_guard, distance("word_bins", "word_reference")).alias("word_distance"),
        ((F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )
    within = (F.coalesce("char_distance", F.lit(0.0)) <= limits.char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.word_distance)
    return scored.withColumn("kept", ~F.col("base_failed") & within).drop("char_reference", "word_reference")


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*CONTRACT)


def _classes_sql() -> str:
    removed = lambda chars: f"length(text) - length(translate(text, {chars}, ''))"
    upper = r"length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))"
    letters = r"length(regexp_replace(text, '\P{L}+', '', 'g'))"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    quoted = "'" + PUNCTUATION.replace("'", "''") + "'"
    kinds = [upper, f"{letters} - ({upper})", removed("'0123456789'"), removed(spaces), removed(quoted), removed(f"'{SYMBOLS}'")]
    return f"[{', '.join(kinds)}]"


def oracle(limits: Limits = Limits()) -> str:
    """The same rules in DuckDB SQL."""
    term = "(case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end)"
    both = lambda p, q: f"({term.format(a=p, b=q)} + {term.format(a=q, b=p)}) / 2"
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
u as (select rid, lang, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select rid, i, word || chr(1) || lead(word) over (partition by rid order by i) || chr(1) || lead(word, 2) over (partition by rid order by i) as grams from u),
r as (select rid, i from g where grams is not null qualify count(*) over (partition by rid, grams) > 1),
c as (select rid, count(distinct p) as n_repeat from (select rid, unnest([i, i + 1, i + 2]) as p from r) group by rid),
base as (select rid, doc_id, lang, text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words
  from w left join c using (rid)),
counts as (select lang, lower(word) as word, count(*) as n from u group by all),
totals as (select lang, sum(n) as total from counts group by lang),
common as (select lang, word, n::double / total as q from counts join totals using (lang) where n >= {limits.common_share} * total),
hits as (select rid, lower(word) as word, count(*) as k from u group by all),
bins as (select rid, coalesce(k, 0)::double / n_words as p, q from base join common using (lang) left join hits using (rid, word) where n_words >= {limits.word_guard}),
word_d as (select rid, sum({both("p", "q")}) as s, greatest(0, 1 - sum(p)) as p, greatest(0, 1 - sum(q)) as q from bins group by rid),
word_j as (select rid, sqrt(greatest(0, s + {both("p", "q")})) as word_distance from word_d),
kinds as (select rid, lang, length(text) as n_chars, {_classes_sql()} as k from base),
filled as (select rid, lang, n_chars, list_append(k, n_chars - list_sum(k)) as k from kinds),
spread as (select rid, lang, n_chars, unnest(k) as k, generate_subscripts(k, 1) as i from filled),
refs as (select lang, i, sum(k)::double / sum(sum(k)) over (partition by lang) as q from spread group by lang, i),
char_j as (select rid, sqrt(greatest(0, sum({both("(k::double / n_chars)", "q")}))) as char_distance from spread join refs using (lang, i) where n_chars >= {limits.char_guard} group by rid),
judged as (select *, n_words < {limits.min_words} or 100 * n_repeat_words > {limits.max_repeat_percent} * n_words as base_failed from base left join word_j using (rid) left join char_j using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(word_distance, 0) <= {limits.word_distance} and coalesce(char_distance, 0) <= {limits.char_distance} as kept from judged
"""
