"""Full-text ranking from the stored inverted index: no text is read.

A term of the question is the beginning of a word. Every score has an upper
bound in each block, from the block's largest counts and smallest lengths, which
stand beside the postings. The blocks with the highest bounds are scored first;
their k-th score then rules out every block whose bound is lower, before its
postings are read. What is left is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..sources.postings import BLOCK, InvertedIndex
from .search import B, DOC, K1, best_per_document

#: Blocks that are scored first.
PROBE = 4


def _any(terms: list[str]) -> Column:
    return reduce(Column.__or__, [F.col("term").startswith(t) for t in terms])


def frequencies(index: InvertedIndex, terms: list[str]) -> list[int]:
    """Chunks that hold a word beginning with each term: from the dictionary where one word does, else counted in the postings' places."""
    own = [F.col("term").startswith(t) for t in terms]
    known = index.terms.where(_any(terms)).agg(*[F.count_if(o).alias(f"w{i}") for i, o in enumerate(own)], *[F.sum(F.when(o, F.col("df"))).alias(f"d{i}") for i, o in enumerate(own)]).first()
    out = [known[f"d{i}"] or 0 for i in range(len(terms))]
    several = [i for i in range(len(terms)) if known[f"w{i}"] > 1 or known[f"w{i}"] and index.ends is not None]
    if several:
        which = F.explode(F.filter(F.array(*[F.when(own[i], F.lit(i)) for i in several]), lambda i: i.isNotNull()))
        each = _postings(index, [terms[i] for i in several]).withColumn("i", which).select("i", *BLOCK, "__segment", F.explode(F.arrays_zip("places", "documents")).alias("p"))
        each = _living(index, each.select("i", *BLOCK, "__segment", F.col("p.places").alias("place"), F.col("p.documents").alias(DOC)))
        counts = {r.i: r.n for r in each.select("i", *BLOCK, "place").distinct().groupBy("i").agg(F.count("*").alias("n")).collect()}
        for i in several:
            out[i] = counts.get(i, 0)
    return out


def _postings(index: InvertedIndex, terms: list[str]) -> DataFrame:
    rows = index.blocks if "__segment" in index.blocks.columns else index.blocks.withColumn("__segment", F.lit(0))
    return rows.where(_any(terms))


def _living(index: InvertedIndex, rows: DataFrame) -> DataFrame:
    if index.ends is None:
        return rows
    ends = index.ends.withColumnRenamed(DOC, "__doc")
    return rows.join(ends, (F.col(DOC) == F.col("__doc")) & (F.col("__segment") < F.col("__end")), "left_anti")


def _idf(index: InvertedIndex, counts: list[int]) -> list[float]:
    return [max(math.log((index.n - df + 0.5) / (df + 0.5)), 1e-6) for df in counts]


def _impact(idf: float, tf: Column, length: Column, mean: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def bounds(index: InvertedIndex, terms: list[str], idf: list[float]) -> DataFrame:
    """(segment, block, impact, has0, has1, ...): no chunk of the block has a larger BM25 score, nor more terms."""
    own = [F.col("term").startswith(t) for t in terms]
    each = _postings(index, terms).groupBy(*BLOCK).agg(*[F.coalesce(F.sum(F.when(o, F.col("max_tf"))), F.lit(0)).alias(f"t{i}") for i, o in enumerate(own)], *[F.min(F.when(o, F.col("min_length"))).alias(f"l{i}") for i, o in enumerate(own)])
    parts = [F.when(F.col(f"t{i}") > 0, _impact(w, F.col(f"t{i}"), F.col(f"l{i}"), index.mean)).otherwise(0.0) for i, w in enumerate(idf)]
    return each.select(*BLOCK, reduce(Column.__add__, parts).alias("impact"), *[(F.col(f"t{i}") > 0).cast("int").alias(f"has{i}") for i in range(len(terms))])


def scored(index: InvertedIndex, terms: list[str], idf: list[float], blocks: DataFrame) -> DataFrame:
    """Chunks with a hit in these blocks: segment, block, place, document, tf of each term, length and BM25 score."""
    own = [F.col("term").startswith(t) for t in terms]
    rows = _postings(index, terms).join(blocks.select(*BLOCK), [*BLOCK], "left_semi")
    flags = [o.alias(f"f{i}") for i, o in enumerate(own)]
    each = rows.select(*BLOCK, "__segment", *flags, F.explode(F.arrays_zip("places", "tfs", "lengths", "documents")).alias("p"))
    chunks = each.groupBy(*BLOCK, "__segment", F.col("p.places").alias("place")).agg(*[F.coalesce(F.sum(F.when(F.col(f"f{i}"), F.col("p.tfs"))), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))], F.max("p.lengths").alias("length"), F.max("p.documents").alias(DOC))
    score = reduce(Column.__add__, [_impact(w, F.col(f"tf{i}"), F.col("length"), index.mean) for i, w in enumerate(idf)])
    return _living(index, chunks).withColumn("score", score)


def _described(index: InvertedIndex, hits: DataFrame, *names: str) -> DataFrame:
    """Hits with what the spans say of their chunks."""
    spans = index.spans.select(*BLOCK, F.col("places").alias("__places"), *[F.col(n) for n in names])
    joined = hits.join(spans, [*BLOCK])
    at = F.array_position("__places", F.col("place")).cast("int")
    return joined.select(*hits.columns, *[F.element_at(n, at).alias(n[:-1] if n != "hashes" else "hash") for n in names])


def _best(index: InvertedIndex, bounded: DataFrame, rank: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The first ``most`` of ``rank`` over all blocks, of which only those are read whose ``bound`` reaches the k-th score of the first few."""
    first = bounded.orderBy(F.desc("bound"), *BLOCK).limit(PROBE + 1).select(*BLOCK, "bound").collect()
    if len(first) <= PROBE:
        return rank(bounded)
    probe = bounded.sparkSession.createDataFrame([(r.segment, r.block) for r in first[:PROBE]], "segment string, block long")
    scores = [r.score for r in rank(probe).collect()]
    return rank(bounded.where(F.col("bound") >= min(scores) - 1e-9) if len(scores) == most else bounded)


def all_terms(index: InvertedIndex, question: str, most: int = 12) -> DataFrame:
    """As ``search.all_terms``: chunks with every term as a prefix, 20 plus BM25, best of each document."""
    terms = search_terms(question)
    idf = _idf(index, frequencies(index, terms))
    every = reduce(Column.__and__, [F.col(f"has{i}") == 1 for i in range(len(terms))])
    bounded = bounds(index, terms, idf).where(every).withColumn("bound", 20 + F.col("impact"))

    def rank(blocks: DataFrame) -> DataFrame:
        hits = scored(index, terms, idf, blocks).where(reduce(Column.__and__, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
        rows = _described(index, hits, "ordinals").select(DOC, "ordinal", (20 + F.col("score")).alias("score"))
        return best_per_document(rows, [F.desc("score"), F.asc("ordinal")]).orderBy(F.desc("score"), DOC).limit(most)

    return _best(index, bounded, rank, most)


def free_text(index: InvertedIndex, question: str, most: int = 20) -> DataFrame:
    """As ``search.free_text``: any term as a prefix; coverage, specificity, size, BM25 and the whole document's coverage."""
    terms = search_terms(question)
    n = len(terms)
    least = n if n <= 2 else max(2, -(-n // 3))
    idf = _idf(index, frequencies(index, terms))
    has, sizes = [F.col(f"has{i}") for i in range(n)], [len(t) for t in terms]
    total = lambda parts: reduce(Column.__add__, parts)
    bound = 50 * total(has) / n + 3 * total([h * s for h, s in zip(has, sizes)]) + 10 + F.col("impact") + 100
    bounded = bounds(index, terms, idf).where(total(has) >= least).withColumn("bound", bound)
    edges = index.spans.select(*BLOCK, F.explode(F.array_distinct(F.array("first_document", "last_document"))).alias(DOC))

    def rank(blocks: DataFrame) -> DataFrame:
        hit = [(F.col(f"tf{i}") > 0).cast("int") for i in range(n)]
        hits = scored(index, terms, idf, blocks).withColumn("matched", total(hit)).withColumn("specific", total([h * s for h, s in zip(hit, sizes)])).where(F.col("matched") >= least)
        found = hits.select(DOC).distinct()
        around = edges.join(found, DOC, "left_semi").select(*BLOCK).unionByName(hits.select(*BLOCK)).distinct()
        whole = scored(index, terms, idf, around).join(found, DOC, "left_semi").groupBy(DOC).agg(total([F.max(h) for h in hit]).alias("doc_matched"))
        rows = _described(index, hits, "ordinals", "sizes", "hashes").join(whole, DOC)
        score = 50 * F.col("matched") / n + 3 * F.col("specific") + F.least("size", F.lit(1000)) / 100 + F.col("score") + 100 * F.col("doc_matched") / n
        best = best_per_document(rows.select(DOC, "ordinal", "hash", score.alias("score")), [F.desc("score"), F.asc("ordinal")])
        once = Window.partitionBy("hash").orderBy(F.desc("score"), DOC)
        return best.withColumn("__k", F.row_number().over(once)).where("__k = 1").select(DOC, "ordinal", "score").orderBy(F.desc("score"), DOC).limit(most)

    return _best(index, bounded, rank, most)
