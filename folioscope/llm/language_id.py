"""Language identification by inferring each document's mixture of languages.

A model holds, for each language, the smoothed log probabilities of hashed
letter trigrams. A document's trigram counts are explained by a mixture of
these; expectation-maximisation estimates the proportions. Of the nested sets
of its likeliest languages, the one with the best penalised likelihood is
taken, so that a language enters only if it explains enough of the text. All
documents of a slice run through the same numpy operations together.

Null text and text without a letter give ``und`` with score 0 and no
languages, as does a model that saw no labelled text. A very long text is one
slice of its own. Equal shares are ranked by the language's name. Predictions
depend on the text alone: repeated rows give repeated results. A null doc_id is
never held out and never learned from.
Extra columns are ignored; passed-through columns named like an output give
way to the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

FEATURES = 1 << 16
UNDETERMINED = "und"
OUTPUT = "lang_pred string, score double, languages array<string>, proportions array<double>"


@dataclass(frozen=True)
class Parameters:
    #: Expected number of labelled documents to learn a language from, at most (whole texts).
    train_docs_per_language: int = 3000
    #: More labels than this are taken for a mistake; bounds the model that the driver holds.
    most_languages: int = 512
    smoothing: float = 0.5
    iterations: int = 12
    #: Languages below this share after the first estimate are not tried.
    least_share: float = 0.02
    #: Weight of the penalty log(n) / 2 for each further language; overlapping trigrams count three times.
    penalty: float = 3.0


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray = field(repr=False)  # FEATURES x languages
    #: Mean log probability of a trigram of each language's own training texts.
    typical: np.ndarray | None = field(default=None, repr=False)


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts, and the index of the text of each.

    Runs of other characters count as one space; each text is enclosed in spaces
    of its own, so that a text has one trigram a letter whatever its neighbours.
    """
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer("".join(f"\n{x}\n" for x in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(x) + 2 for x in lowered]) if texts else np.empty(0, int)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a run of letters
    keep[:-1] |= letter[1:] & ~letter[:-1]  # and the one before it
    codes, owner = np.where(letter, codes, 32)[keep].astype(np.uint32), owner[keep]
    if len(codes) < 3:
        return np.empty(0, np.uint16), np.empty(0, int)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    inside = (owner[:-2] == owner[2:]) & (codes[1:-1] != 32)
    return (mixed[inside] >> np.uint32(16)).astype(np.uint16), owner[:-2][inside]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order, with counts."""
    features, owner = trigrams(texts)
    key = (owner.astype(np.uint64) << np.uint64(16)) | features
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    return (key[first] >> np.uint64(16)).astype(np.int64), (key[first] & np.uint64(0xFFFF)).astype(np.int64), np.diff(np.append(first, len(key))).astype(np.float64)


def infer(model: Model, texts: list[str], how: Parameters = Parameters(), counts=None) -> np.ndarray:
    """Language proportions, texts x languages; zero rows where nothing can be said."""
    n_languages, out = len(model.languages), np.zeros((len(texts), len(model.languages)))
    owner, feature, count = _counts(texts) if counts is None else counts
    if not len(owner) or not n_languages:
        return out
    present, begin = np.unique(owner, return_index=True)
    row = np.searchsorted(present, owner)
    log_p = model.log_p[feature].astype(np.float64)
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    total = np.add.reduceat(count, begin)
    single = np.add.reduceat(count[:, None] * (log_p - top[:, None]), begin, axis=0)

    def run(rows: np.ndarray, allowed: np.ndarray, share: np.ndarray, iterations: int):
        """EM for some of the texts; their proportions and log likelihoods."""
        pick = np.isin(row, rows) if len(rows) < len(present) else slice(None)
        local, q, c = np.searchsorted(rows, row[pick]), p[pick], count[pick]
        at = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        share = np.where(allowed, share, 0) + allowed * 1e-6
        share /= share.sum(axis=1, keepdims=True)
        for _ in range(iterations):
            resp = q * share[local]
            mass = resp.sum(axis=1)
            resp *= (c / mass)[:, None]
            share = np.add.reduceat(resp, at, axis=0) / total[rows][:, None]
        mass = (q * share[local]).sum(axis=1)
        return share, np.add.reduceat(c * np.log(mass), at)

    everyone = np.arange(len(present))
    first, _ = run(everyone, np.ones((len(present), n_languages), bool), np.full((len(present), n_languages), 1 / n_languages), how.iterations)
    ranked = np.argsort(-first, axis=1, kind="stable")
    best = np.zeros_like(first)
    best[everyone, ranked[:, 0]] = 1
    best_fit = single[everyone, ranked[:, 0]]
    candidates = (first >= how.least_share).sum(axis=1)
    for size in range(2, n_languages + 1):
        rows = np.flatnonzero(candidates >= size)
        if not len(rows):
            break
        allowed = np.zeros((len(rows), n_languages), bool)
        np.put_along_axis(allowed, ranked[rows, :size], True, axis=1)
        share, fit = run(rows, allowed, first[rows], 5)
        fit = fit - how.penalty * (size - 1) * np.log(total[rows] + 1) / 2
        better = fit > best_fit[rows]
        best[rows[better]], best_fit[rows[better]] = share[better], fit[better]
    out[present] = best
    return out


def fits(model: Model, shares: np.ndarray, counts, spread: float = 0.5) -> np.ndarray:
    """How well its inferred mixture explains each text: 1 as well as training texts, 0 as if every trigram were unseen.

    The mean log likelihood per trigram, on the scale between these two for
    the same mixture. Few trigrams say little, so ``spread`` / sqrt(n) is
    added. 0 where nothing can be said.
    """
    out = np.zeros(len(shares))
    owner, feature, count = counts
    if not len(owner) or not model.languages:
        return out
    p = (np.exp(model.log_p[feature].astype(np.float64)) * shares[owner]).sum(axis=1)
    total = np.bincount(owner, count, len(shares))
    known = total > 0
    own, total = shares[known], total[known]
    mean = np.bincount(owner, count * np.log(p), len(shares))[known] / total
    low = np.log(own @ np.exp(model.log_p.min(axis=0).astype(np.float64)))
    high = own @ model.typical + np.where(own > 0, own * np.log(np.where(own > 0, own, 1)), 0).sum(axis=1)
    out[known] = (mean - low) / np.maximum(high - low, 1e-9) + spread / np.sqrt(total)
    return out


def train(labelled: DataFrame, how: Parameters = Parameters()) -> Model:
    """Learn from rows (doc_id, text, lang) with text, lang and doc_id.

    A language with more rows than the bound is thinned by a hash of doc_id to
    about the bound; texts are whole. What reaches the driver is at most
    FEATURES counts a language.
    """
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).limit(how.most_languages + 1).collect()}
    if len(sizes) > how.most_languages:
        raise ValueError(f"more than {how.most_languages} labels: is this column a language?")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, how.train_docs_per_language / n)]) if sizes else None
    if share is None:
        return Model([], np.zeros((FEATURES, 0), np.float32))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for begin, end in slices([len(x) for x in own], 1 << 19):
                    features, _ = trigrams(own[begin:end])
                    sums[lang] = sums.get(lang, 0) + np.bincount(features, minlength=FEATURES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    table = picked.select("text", "lang").mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((FEATURES, len(languages)), how.smoothing)
    counts[table["feature"].to_numpy(), table["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int)] += table["n"].to_numpy()
    log_p = np.log(counts / counts.sum(axis=0))
    seen = counts - how.smoothing
    return Model(languages, log_p.astype(np.float32), (seen * log_p).sum(axis=0) / np.maximum(seen.sum(axis=0), 1))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, how: Parameters = Parameters(), fit: str | None = None) -> DataFrame:
    """Append lang_pred, score, languages and proportions to the ``keep`` columns (all by default); needs ``text``.

    ``fit`` names one more column, of ``fits``.
    """
    output = OUTPUT + (f", {fit} double" if fit else "")
    outputs = [x.split()[0] for x in output.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for begin, end in slices([len(x) for x in texts], 1 << 19):
                counts = _counts(texts[begin:end])
                shares = infer(model, texts[begin:end], how, counts)
                langs, scores, sets, proportions = [], [], [], []
                for x in shares:
                    order = [i for i in np.argsort(-x, kind="stable") if x[i] > 0]
                    langs.append(model.languages[order[0]] if order else UNDETERMINED)
                    scores.append(min(1.0, float(x[order[0]])) if order else 0.0)
                    sets.append([model.languages[i] for i in order])
                    proportions.append([float(x[i]) for i in order])
                part = batch.slice(begin, end - begin)
                found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(proportions, pa.list_(pa.float64()))]
                if fit:
                    found.append(pa.array(fits(model, shares, counts), pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=[*keep, *outputs])

    source = docs.select(F.col("text").alias("__text"), *[docs[c] for c in keep])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), output])
    return source.mapInArrow(run, ddl)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])
