"""Full-text search over chunks: postings, BM25 and the scores of the search paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact, exactly, fold, folded, holds_phrase, holds_value, may_hold, search_terms, words
from .scope import equals, meeting_all

DOC = "document_id"
K1, B = 1.2, 0.75  # public defaults of the ranking function


def begins(term: str):
    return lambda w: w.startswith(term)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, document_id, ordinal, tf, length): the inverted index as a table, to be written once and reread."""
    split = chunks.select(DOC, "ordinal", words("content").alias("w"))
    return split.select(DOC, "ordinal", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", DOC, "ordinal", "length").agg(F.count("*").alias("tf"))


def prefix_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with how many of their words begin with each term, and their length in words.

    Counted by patterns on the folded text, which stay in generated code; a
    pattern runs only where the text holds its term at all.
    """
    text = folded("content")
    counted = [F.when(text.contains(t), F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{t}\E"))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
    return chunks.select(DOC, "ordinal", "content", F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")).alias("length"), *counted)


def holding_any(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks in which some term occurs at all: no other can have a hit."""
    return chunks.where(reduce(Column.__or__, [folded("content").contains(t) for t in terms], F.lit(False)))


def bm25(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with hits, their counts and ``score``; document frequencies and the mean length come from all chunks, in one row."""
    n_terms = len(terms)
    tf = [F.col(f"tf{i}") for i in range(n_terms)]
    totals = prefix_counts(chunks, terms).agg(F.count("*").alias("__n"), F.avg("length").alias("__mean"), *[F.count_if(t > 0).alias(f"__df{i}") for i, t in enumerate(tf)])
    counted = prefix_counts(holding_any(chunks, terms), terms)
    parts = []
    for i, t in enumerate(tf):
        df = F.col(f"__df{i}")
        idf = F.greatest(F.ln((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        parts.append(idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.col("__mean"))))
    return counted.crossJoin(F.broadcast(totals)).withColumn("score", reduce(Column.__add__, parts)).drop("__n", "__mean", *[f"__df{i}" for i in range(n_terms)])


def first_chunks(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, content): the chunk that each document begins with, of some documents or of all; a document without chunks has no row."""
    own = chunks if documents is None else chunks.join(documents.select(DOC), DOC, "left_semi")
    return own.groupBy(DOC).agg(F.min_by("content", F.struct("ordinal", "content")).alias("content"))


def best_per_document(hits: DataFrame, order: list[Column]) -> DataFrame:
    """The first hit of each document in this order."""
    window = Window.partitionBy(DOC).orderBy(*order)
    return hits.withColumn("__k", F.row_number().over(window)).where("__k = 1").drop("__k")


def all_terms(chunks: DataFrame, question: str, most: int = 12) -> DataFrame:
    """Chunks with every term as a prefix: 20 plus BM25, best of each document."""
    terms = search_terms(question)
    counted = bm25(chunks, terms)
    every = reduce(Column.__and__, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    hits = counted.where(every).select(DOC, "ordinal", (20 + F.col("score")).alias("score"))
    return best_per_document(hits, [F.desc("score"), F.asc("ordinal")]).orderBy(F.desc("score"), DOC).limit(most)


def free_text(chunks: DataFrame, question: str, most: int = 20) -> DataFrame:
    """Any term as a prefix; documents that cover more of the question come first.

    A chunk scores 50 times its coverage, 3 times its specificity (letters of
    the matched terms), a hundredth of its length up to 1000, BM25, and 100
    times the coverage by its whole document. Of n terms all up to two, else a
    third but at least two, must match. Equal texts count once.
    """
    terms = search_terms(question)
    n = len(terms)
    least = n if n <= 2 else max(2, -(-n // 3))
    hit = [(F.col(f"tf{i}") > 0).cast("int") for i in range(n)]
    counted = bm25(chunks, terms)
    matched = counted.withColumn("matched", reduce(Column.__add__, hit)).withColumn("specific", reduce(Column.__add__, [h * len(t) for h, t in zip(hit, terms)]))
    whole = prefix_counts(holding_any(chunks, terms), terms).groupBy(DOC).agg(reduce(Column.__add__, [F.max(h) for h in hit]).alias("doc_matched"))
    rows = matched.where(F.col("matched") >= least).join(whole, DOC)
    score = 50 * F.col("matched") / n + 3 * F.col("specific") + F.least(F.length("content"), F.lit(1000)) / 100 + F.col("score") + 100 * F.col("doc_matched") / n
    scored = rows.select(DOC, "ordinal", F.xxhash64("content").alias("__text"), score.alias("score"))
    best = best_per_document(scored, [F.desc("score"), F.asc("ordinal")])
    once = Window.partitionBy("__text").orderBy(F.desc("score"), DOC)
    return best.withColumn("__k", F.row_number().over(once)).where("__k = 1").select(DOC, "ordinal", "score").orderBy(F.desc("score"), DOC).limit(most)


def best_line(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """The line of each chunk with most matched terms, the last one on a tie."""
    lines = chunks.select(DOC, "ordinal", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    score = reduce(Column.__add__, [F.exists(words("text"), begins(t)).cast("int") for t in terms])
    best = F.max_by(F.struct("line", "text", "n_terms"), F.struct("n_terms", "line"))
    return lines.withColumn("n_terms", score).groupBy(DOC, "ordinal").agg(best.alias("b")).select(DOC, "ordinal", "b.*")


def literal_hits(chunks: DataFrame, literal: str) -> DataFrame:
    return chunks.where(folded("content").contains(fold(literal))).select(DOC).distinct().withColumn("score", F.lit(115))


def phrase_hits(chunks: DataFrame, phrase: str) -> DataFrame:
    return chunks.where(holds_phrase("content", phrase)).select(DOC).distinct()


def metadata_hits(documents: DataFrame, phrase: str, folder_is_named: bool) -> DataFrame:
    """Title 130; folder 90 if the question names it as one, else 15."""
    wanted = exact(phrase)
    score = F.when(may_hold("title", phrase) & exactly("title").contains(wanted), 130).when(may_hold("origin", phrase) & exactly("origin").contains(wanted), 90 if folder_is_named else 15)
    return documents.select(DOC, score.alias("score")).where("score is not null")


def structured_hits(documents: DataFrame, values: DataFrame, wanted: str) -> DataFrame:
    """A value that is equal 120, holds the phrase 105, a field named so 80; folder 15."""
    literal, phrase = fold(wanted), exact(wanted)
    score = F.when(F.col("literal_value") == literal, 120).when(holds_phrase("text_value", phrase), 105).when(exactly("concept") == phrase, 80)
    hits = values.select(DOC, score.alias("score")).where("score is not null")
    folders = documents.where(may_hold("origin", phrase) & exactly("origin").contains(phrase)).select(DOC, F.lit(15).alias("score"))
    return hits.unionByName(folders).groupBy(DOC).agg(F.max("score").alias("score"))


def complete_hits(chunks: DataFrame, phrase: str) -> DataFrame:
    """Documents whose text holds the phrase, not as part of a longer word or code: 115."""
    return chunks.where(holds_value("content", phrase)).select(DOC).distinct().withColumn("score", F.lit(115))


def strict_exact(documents: DataFrame, values: DataFrame, chunks: DataFrame, phrase: str) -> DataFrame:
    """Best score of each document whose title, folder, fields or text hold the phrase; nothing approximate."""
    parts = [metadata_hits(documents, phrase, False), structured_hits(documents, values, phrase), complete_hits(chunks, phrase)]
    return reduce(DataFrame.unionByName, parts).groupBy(DOC).agg(F.max("score").alias("score"))


def strict_structured(documents: DataFrame, values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Documents that have all pairs of field and value, in one pass over the values: 120."""
    every = meeting_all(values, [equals(c, v) for c, v in pairs])
    return documents.select(DOC).join(every, DOC, "left_semi").withColumn("score", F.lit(120))
