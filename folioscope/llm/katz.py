"""Katz back-off scoring with Good-Turing discounts.

Bigram model over words: a seen bigram has its discounted relative frequency,
an unseen one the history's back-off weight times the word's unigram
probability, (c + 1) / (N + V + 1), which keeps one share for unknown words.
Counts up to ``k`` get Good-Turing discounts; larger ones lose a fixed small
``delta``, so that no history is left without mass. Weights are exact: for each
history the probabilities of all words sum to 1. A history never seen gives
the unigram probability.

Layout. Words are 64-bit hashes. The unigram table (word, counts) comes first;
the few words with a large share of all tokens (at most 1 / hot_share) are read
from it. Then every (history, word, document) occurrence is dealt to the bucket
of its word, packed into arrays without repeats; hot words are dealt by word
*and* history. A pair can only be frequent if its word and its history are hot:
such pairs are counted by slice in the first round and dealt from the second on,
but for the frequent ones (at most 1 / hot_share). Their counts are then known,
so that each task evaluates its documents' occurrences of them where they are,
and no bucket has them. With one round there is no such count, and a frequent
pair stays in one bucket. The buckets come in ``rounds`` of about equal shares of the hash
range: a round deals and evaluates its share of all occurrences and frees its
shuffle before the next, so that only one share is on disk at a time. Each
round reads the documents again, and rows are told apart by their place; input
that is not surely read alike each time (``stable``) is written first, and a
document whose occurrences don't add up to its tokens is an error. A bucket knows all counts of its words and evaluates its
occurrences; what depends on the whole corpus (N, V, the discounts) enters as
separate sums and is applied afterwards. For unseen bigrams the history's
weight is joined from the history table. Buckets' results are tables
partitioned by kind in the shared folder: documents, histories, unseen,
counts of counts, and with ``keep_bigrams`` the bigram counts themselves.

Null text counts as empty: one end token. Each row is scored on its own, also
repeated ones. Rows with a null doc_id are scored, and learned from. An empty
training set gives scores of the unknown word. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, slices, work_dir
from .ngram_join import U64, _table, mix

BEGIN, END = U64(0x5BD1E9955BD1E995), U64(0xA0761D6478BD642F)  # history before the first word, and the end token
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20  # bytes that are hashed at a time


@dataclass(frozen=True)
class Parameters:
    k: int = 5
    delta: float = 0.05
    #: A word or pair above this share of all tokens, or above that of a bucket if this is less, is hot.
    hot_share: float = 1 / 2000
    slice_bytes: int = 5 << 20
    #: Shares of the hash range that are dealt one after the other.
    rounds: int = 3
    #: Buckets for each shuffle partition in a round; a bucket's arrays are what a task holds at once.
    buckets_each: int = 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends in order, and the index of the text of each."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8) if texts else np.empty(0, np.uint8)
    word = ~SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    hashes = np.empty(len(begin), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), BLOCK)), len(begin)))
    for a, b in zip(cuts[:-1], cuts[1:]):  # whole words, so that a block is as long as BLOCK and one word at most
        at, size = begin[a], end[b - 1] - begin[a]
        sums = np.zeros(size + 1, np.uint64)
        sums[1:] = LOWER[data[at : at + size]]
        sums[1:] += U64(1)
        sums[1:] *= _table("power", size)[:size]
        np.cumsum(sums, out=sums)
        first, last = begin[a:b] - at, end[a:b] - at
        hashes[a:b] = mix((sums[last] - sums[first]) * _table("inverse", size + 1)[first] + (last - first).astype(np.uint64))
    stops = np.cumsum([len(x) + 1 for x in texts])  # the end token of each text follows its words
    owner = np.searchsorted(stops, begin, side="right")
    at = np.searchsorted(owner, np.arange(len(texts)), side="right")
    return np.insert(hashes, at, END), np.insert(owner, at, np.arange(len(texts)))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, int)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _sum_by(keys: np.ndarray, *columns: np.ndarray):
    """Distinct keys, sorted, and the columns' sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], [np.add.reduceat(c[order], first) if len(keys) else c for c in columns]


def unigrams(docs: DataFrame, how: Parameters) -> DataFrame:
    """(word, trained, every): counts of each word in training documents and in all; ``docs`` has trains, text binary."""

    def count(batches):
        import pyarrow as pa

        kept: list = []
        size = 0

        def flush():
            words, (trained, every) = _sum_by(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), np.concatenate([x[2] for x in kept]))
            return words, trained, every

        for batch in batches:
            texts, trains = [x or b"" for x in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), bool)
            for begin, end in slices([len(x) for x in texts], how.slice_bytes):
                words, owner = tokens(texts[begin:end])
                words, (trained, every) = _sum_by(words, trains[begin:end][owner].astype(np.int64), np.ones(len(words), np.int64))
                kept.append((words, trained, every))
                size += len(words)
                if size > 2_000_000:
                    kept[:] = [flush()]
                    size = len(kept[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_pydict({"word": kept[0][0].view(np.int64), "trained": kept[0][1], "every": kept[0][2]})
                        kept, size = [], 0
        if kept:
            words, trained, every = flush()
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "trained": trained, "every": every})

    counted = docs.select("text", "trains").mapInArrow(count, "word long, trained long, every long")
    return counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("every").alias("every"))


@dataclass(frozen=True)
class Pairs:
    """Frequent pairs of a history and a word by their route, sorted, with the training counts of pair and word."""

    route: np.ndarray
    word: np.ndarray
    history: np.ndarray
    c_pair: np.ndarray
    c_word: np.ndarray


def route_of(words: np.ndarray, history: np.ndarray) -> np.ndarray:
    return mix(words ^ (history * U64(0x2545F4914F6CDD1D)))


def turns(hot_part: float, rounds: int) -> tuple[list[int], list[int]]:
    """Bounds of each turn's share of the hash range: of common pairs and of all others.

    Turn 0 has none of the common pairs, as it counts them; it has the more of
    the others, so that all turns deal about as much (``hot_part`` of the words are hot).
    """
    whole = 1 << 64
    if rounds == 1:
        return [0, 0], [0, whole]
    first = int(whole * min(1.0, 1 / (rounds * max(1 - hot_part**2, 1e-9))))
    even = lambda a: [a + (whole - a) * i // (rounds - 1) for i in range(rounds)]
    return [0, *even(0)], [0, *even(first)]


def deal(docs: DataFrame, hot: np.ndarray, buckets: int, turn: int, how: Parameters, bounds: tuple[list[int], list[int]], pairs_known: Pairs | None) -> DataFrame:
    """(bucket, blob) rows of the occurrences of this turn's buckets; ``docs`` has id, trains, text binary.

    Turn 0 has the documents too, and counts of the common pairs; turn 1 what
    the occurrences of the frequent ones are worth, which no turn deals.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, every, trains = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()], np.array(batch.column(2).to_pylist(), bool)
            for begin, end in slices([len(x) for x in every], how.slice_bytes):
                order = np.argsort(~trains[begin:end], kind="stable")  # training documents come first
                texts, n_train = [every[begin + i] for i in order], int(trains[begin:end].sum())
                words, owner = tokens(texts)
                history = np.empty_like(words)
                history[1:] = words[:-1]
                starts = _firsts(owner)
                history[starts] = BEGIN
                is_hot = np.isin(words, hot) if len(hot) else np.zeros(len(words), bool)
                route = np.where(is_hot, route_of(words, history), words) if len(hot) else words
                common = np.append(True, is_hot[:-1])  # history and word are hot
                common[starts] = True
                common &= is_hot & (how.rounds > 1)
                sizes = np.bincount(owner, minlength=end - begin)
                place = np.full(len(words), -1)
                for of, bound in zip((common, ~common), bounds):
                    low, size = bound[turn], bound[turn + 1] - bound[turn]
                    if size:
                        at = np.flatnonzero(of & (route >= U64(low)) & (route <= U64(low + size - 1)))
                        place[at] = (route[at] - U64(low)) // U64((size - 1) // buckets + 1)
                out_bucket, out_blob = [], []

                def send(batches, row=row, out_bucket=out_bucket, out_blob=out_blob):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batches[0].schema) as stream:
                        for x in batches:
                            stream.write_batch(x)
                    out_bucket.append(int(row + (row >> 40)) % buckets)
                    out_blob.append(b"\0" * 24 + sink.getvalue().to_pybytes())

                at = np.flatnonzero(common)
                if not turn and len(at):
                    keys, first, which = np.unique(route[at], return_index=True, return_inverse=True)
                    trained, total = np.bincount(which, weights=owner[at] < n_train), np.bincount(which)
                    to = (keys // U64((1 << 64) // buckets + 1)).astype(np.int64)
                    for a, b in zip(_firsts(to), np.append(_firsts(to)[1:], len(to))):
                        parts = [words[at[first[a:b]]], history[at[first[a:b]]], trained[a:b].astype(np.uint32), total[a:b].astype(np.uint32)]
                        out_bucket.append(int(to[a]))
                        out_blob.append(struct.pack("<QIIII", 0, COUNTED, 0, b - a, 0) + b"".join(x.tobytes() for x in parts))
                if pairs_known is not None and len(at):
                    which = np.minimum(np.searchsorted(pairs_known.route, route[at]), len(pairs_known.route) - 1)
                    frequent = (pairs_known.word[which] == words[at]) & (pairs_known.history[which] == history[at])
                    at, which = at[frequent], which[frequent]
                    place[at] = -1
                    if turn == 1 and len(at):
                        send(list(_worth(owner[at].astype(np.int64) + row, which, pairs_known.word, pairs_known.history, pairs_known.c_pair, pairs_known.c_word, how)))
                mine = np.flatnonzero(place >= 0)
                by = mine[np.lexsort((history[mine], words[mine], place[mine]))]
                words, history, place, owner = words[by], history[by], place[by], owner[by].astype(np.uint32)
                pairs = _firsts(words, history)
                new_word = np.zeros(len(pairs), bool)
                new_word[_firsts(words[pairs])] = True
                bucket = place[pairs]
                cuts = np.append(_firsts(bucket), len(pairs))
                new_word[cuts[:-1]] = True
                times = np.diff(np.append(pairs, len(words))).astype(np.uint32)
                narrow = (end - begin <= 1 << 16) << 63  # 16 bits tell documents apart
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                    firsts = np.flatnonzero(new_word[a:b])
                    runs = np.diff(np.append(firsts, b - a)).astype(np.uint32)
                    own = owner[pairs[a] : pairs[b] if b < len(pairs) else len(words)]
                    parts = [words[pairs[a:b]][firsts], history[pairs[a:b]], runs, times[a:b], own.astype(np.uint16) if narrow else own]
                    out_bucket.append(int(bucket[a]))
                    out_blob.append(struct.pack("<QIIII", row | narrow, n_train, len(runs), b - a, len(own)) + b"".join(x.tobytes() for x in parts))
                if not turn:
                    known = ids.slice(begin, end - begin).take(pa.array(order))
                    send([pa.RecordBatch.from_pydict({"row": pa.array(np.arange(row, row + end - begin), pa.int64()), "doc_id": known.cast(pa.int64()), "n": pa.array(sizes, pa.int64()), "trains": np.arange(end - begin) < n_train})])
                row += end - begin
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])

    return docs.select("id", "text", "trains").mapInArrow(run, "bucket int, blob binary")


RESULT = "kind string, key long, history long, doc_id long, trains boolean, n long, n_known long, base double, sure double, counts array<long>"


#: Mark of a blob that holds counts of common pairs.
COUNTED = 1


def _rows(kind: str, size: int, **columns):
    """An Arrow batch of RESULT; columns that are not given are null."""
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    types = {"kind": pa.string(), "key": pa.int64(), "history": pa.int64(), "doc_id": pa.int64(), "trains": pa.bool_(), "n": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "sure": pa.float64(), "counts": pa.list_(pa.int64())}
    arrays = [pa.array([kind] * size) if k == "kind" else columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], types[k]) if k in columns else pa.nulls(size, types[k]) for k in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _lists(matrix: np.ndarray):
    import pyarrow as pa

    flat = np.ascontiguousarray(matrix, np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(flat))


def _worth(d: np.ndarray, pair: np.ndarray, pair_w: np.ndarray, pair_h: np.ndarray, c_pair: np.ndarray, c_of_pair: np.ndarray, how: Parameters):
    """Documents' sums over occurrences of what each pair is worth, and their unseen bigrams; ``d`` is sorted."""
    k = how.k
    at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    add = lambda of_pair: np.add.reduceat(of_pair[pair], at)
    base = np.log10(c_of_pair + 1)
    sure = np.where(c_pair > 0, np.log10(np.where(c_pair > k, c_pair - how.delta, np.maximum(c_pair, 1))), 0.0)
    sure -= np.where((c_of_pair > 0) & (pair_w != END), np.log10(np.maximum(c_of_pair, 1)), 0.0)  # as the history of the next token
    few = np.stack([*(add((c_pair == i).astype(np.int64)) for i in range(1, k + 1)), np.diff(np.append(at, len(d)))], axis=1)
    yield _rows("score", len(at), key=d[at], n_known=add((c_of_pair > 0).astype(np.int64)), base=add(base), sure=add(sure), counts=_lists(few))

    new = np.flatnonzero((c_pair == 0)[pair])
    if len(new):
        hist, dd, base = pair_h[pair[new]], d[new], base[pair[new]]
        o = np.lexsort((hist, dd))
        at = np.flatnonzero(np.append(True, (dd[o][1:] != dd[o][:-1]) | (hist[o][1:] != hist[o][:-1])))
        yield _rows("unseen", len(at), key=dd[o][at], history=hist[o][at].view(np.int64), n=np.diff(np.append(at, len(o))), base=np.add.reduceat(base[o], at))


def _taken(pair_w: np.ndarray, pair_h: np.ndarray, c_pair: np.ndarray, c_of_pair: np.ndarray, how: Parameters, keep_bigrams: bool):
    """What seen words take away from their histories, and counts of counts."""
    k, seen = how.k, np.flatnonzero(c_pair)
    if not len(seen):
        return
    c = c_pair[seen]
    o = np.argsort(pair_h[seen], kind="stable")
    hh, c = pair_h[seen][o], c[o]
    at = np.flatnonzero(np.append(True, hh[1:] != hh[:-1]))
    add = lambda x: np.add.reduceat(x, at)
    few = np.stack([add((c == i).astype(np.int64)) for i in range(1, k + 1)] + [add((c > k).astype(np.int64)), add(np.where(c > k, c, 0)), add(c_of_pair[seen][o] + 1)], axis=1)
    for a in range(0, len(at), 1 << 17):
        part = slice(a, a + (1 << 17))
        yield _rows("history", len(at[part]), history=hh[at[part]].view(np.int64), counts=_lists(few[part]))
    yield _rows("counts", 1, counts=_lists(np.bincount(np.minimum(c, k + 2), minlength=k + 3)[None, 1 : k + 2]))
    if keep_bigrams:
        yield _rows("bigram", len(seen), key=pair_w[seen].view(np.int64), history=pair_h[seen].view(np.int64), n=c_pair[seen])


def _folded(counted: list[np.ndarray]) -> np.ndarray:
    """One column for each pair."""
    every = np.concatenate(counted, axis=1)
    every = every[:, np.lexsort(every[:2])]
    first = _firsts(*every[:2])
    return np.concatenate([every[:2, first], np.add.reduceat(every[2:], first, axis=1)]) if len(first) else every


def _bucket(blobs: list[bytes], hot: np.ndarray, hot_counts: np.ndarray, how: Parameters, keep_bigrams: bool):
    """All results of one bucket, as Arrow batches of RESULT."""
    import pyarrow as pa

    counted = [np.empty((4, 0), np.int64)]  # word, history, in training, in all
    words, history, times, docs, train_below = [], [], [], [], []
    for blob in blobs:
        row, n_train, n_words, n_pairs, n_docs = struct.unpack_from("<QIIII", blob)
        if n_train == COUNTED and not n_docs:
            names, sums = np.frombuffer(blob, "<i8", 2 * n_pairs, 24), np.frombuffer(blob, "<u4", 2 * n_pairs, 24 + 16 * n_pairs)
            counted.append(np.concatenate([names.reshape(2, -1), sums.astype(np.int64).reshape(2, -1)]))
            if sum(x.shape[1] for x in counted[1:]) > max(1 << 20, counted[0].shape[1]):
                counted = [_folded(counted)]
            continue
        if not n_docs:  # the documents of a slice, or what the frequent pairs are worth to them
            head = pa.ipc.open_stream(blob[24:]).read_all()
            if "kind" in head.column_names:
                yield from head.to_batches()
                continue
            yield _rows("document", head.num_rows, key=head["row"].combine_chunks(), doc_id=head["doc_id"].combine_chunks(), trains=head["trains"].combine_chunks(), n=head["n"].combine_chunks())
            continue
        at = 24
        w = np.frombuffer(blob, "<u8", n_words, at)
        h = np.frombuffer(blob, "<u8", n_pairs, at + 8 * n_words)
        at += 8 * (n_words + n_pairs)
        runs = np.frombuffer(blob, "<u4", n_words, at)
        t = np.frombuffer(blob, "<u4", n_pairs, at + 4 * n_words)
        own = np.frombuffer(blob, "<u2" if row >> 63 else "<u4", n_docs, at + 4 * (n_words + n_pairs))
        row &= (1 << 63) - 1
        words.append(np.repeat(w, runs))
        history.append(h)
        times.append(t.astype(np.int64))
        train_below.append(own < n_train)
        docs.append(own.astype(np.int64) + row)
    w, h, trained, every = _folded(counted)
    if len(w):
        yield _rows("common", len(w), key=w, history=h, n=trained, n_known=every)
    del counted, trained, every
    if not words:
        return
    w, h, t = np.concatenate(words), np.concatenate(history), np.concatenate(times)
    doc, trains = np.concatenate(docs), np.concatenate(train_below)
    del words, history, times, docs, train_below
    starts = np.cumsum(t) - t
    trained = np.add.reduceat(trains.astype(np.int64), starts)
    order = np.lexsort((h, w))
    ws, hs = w[order], h[order]
    new = np.append(True, (ws[1:] != ws[:-1]) | (hs[1:] != hs[:-1]))
    first = np.flatnonzero(new)
    pair_w, pair_h, c_pair = ws[first], hs[first], np.add.reduceat(trained[order], first)
    pair_of = np.empty(len(w), np.int64)
    pair_of[order] = np.cumsum(new) - 1
    first_w = np.flatnonzero(np.append(True, pair_w[1:] != pair_w[:-1]))
    c_word = np.add.reduceat(c_pair, first_w)
    distinct = pair_w[first_w]
    if len(hot):
        place = np.minimum(np.searchsorted(hot, distinct), len(hot) - 1)
        c_word = np.where(hot[place] == distinct, hot_counts[place], c_word)
    c_of_pair = np.repeat(c_word, np.diff(np.append(first_w, len(pair_w))))
    del w, h, ws, hs, order, new

    pair = np.repeat(pair_of, t)
    by_doc = np.argsort(doc, kind="stable")
    d, pair = doc[by_doc], pair[by_doc]
    del doc, trains, by_doc, pair_of, t
    yield from _worth(d, pair, pair_w, pair_h, c_pair, c_of_pair, how)
    del d, pair
    yield from _taken(pair_w, pair_h, c_pair, c_of_pair, how, keep_bigrams)


#: While tables are written: a shuffle's files go when its write is complete, a file for each kind is open at once, so that
#: rows need no sort by kind, and no Arrow batch holds much more than these bytes.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of the block; results don't depend on them."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts of the counts 1 .. k from the counts of counts n_1 .. n_(k+1).

    Where the counts of counts are too few to give a value between 0 and 1,
    half an occurrence is taken.
    """
    k = len(n) - 1
    last = (k + 1) * n[k] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - last) / (1 - last) if n[r - 1] and last < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def frequent_pairs(table: DataFrame, least: float, hot: np.ndarray, hot_counts: np.ndarray) -> Pairs | None:
    """The common pairs with more than ``least`` occurrences, of which there are few: ``least`` is a fixed share of all."""
    found = table.where((F.col("kind") == "common") & (F.col("n_known") > least)).select("key", "history", "n").collect()
    if not found:
        return None
    word, history = (np.array([r[i] for r in found], np.int64).view(np.uint64) for i in (0, 1))
    route = route_of(word, history)
    by = np.argsort(route)
    return Pairs(route[by], word[by], history[by], np.array([r.n for r in found], np.int64)[by], hot_counts[np.searchsorted(hot, word)][by])


def score(docs: DataFrame, how: Parameters = Parameters(), keep_bigrams: bool = False, out: str | None = None, stable: bool = False) -> DataFrame:
    """Scores each row of ``docs`` (id, text, trains): learns from rows that train.

    ``stable`` says that ``docs`` gives the same rows in the same order and
    partitions whenever it is read, as a plain scan of files does; otherwise it
    is written first.
    """
    spark = docs.sparkSession
    docs = docs.select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "trains")
    if not stable:
        docs = materialise(docs, "katz-documents")
    with settings(spark, WRITING):
        words = materialise(unigrams(docs, how), "unigrams")
    totals = words.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1)), F.sum("every")).first()
    n_train, n_types, n_all = (int(x or 0) for x in totals)
    buckets = how.buckets_each * partitions(spark)
    share = min(how.hot_share, 1 / (buckets * how.rounds))  # of a bucket, at most its mean
    top = words.where(F.col("every") > share * n_all).select("word", "trained", "every").collect()  # at most 1 / share
    hot_part = sum(r.every for r in top) / max(n_all, 1)
    top = sorted((int(r.word) % (1 << 64), int(r.trained)) for r in top)
    hot, hot_counts = np.array([x[0] for x in top], np.uint64), np.array([x[1] for x in top], np.int64)

    def evaluate(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # gives back what a bucket no longer needs
        open_bucket, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != open_bucket:
                    yield from _bucket(blobs, hot, hot_counts, how, keep_bigrams)
                    open_bucket, blobs = bucket, []
                blobs.append(blob)
        yield from _bucket(blobs, hot, hot_counts, how, keep_bigrams)

    path = out or work_dir(spark, "katz")
    schema = spark.createDataFrame([], RESULT.replace("kind string, ", "") + ", kind string").schema
    known = None
    with settings(spark, WRITING):
        for turn in range(how.rounds):
            dealt = deal(docs, hot, buckets, turn, how, turns(hot_part, how.rounds), known).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
            dealt.mapInArrow(evaluate, RESULT).write.mode("append").partitionBy("kind").parquet(path)
            if not turn and how.rounds > 1:
                known = frequent_pairs(spark.read.schema(schema).parquet(path), share * n_all, hot, hot_counts)
                if known is not None:
                    import pyarrow as pa

                    taken = list(_taken(known.word, known.history, known.c_pair, known.c_word, how, keep_bigrams))
                    if taken:
                        spark.createDataFrame(pa.Table.from_batches(taken)).write.mode("append").partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)

    k = how.k
    counts = table.where("kind = 'counts'").agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(k + 1)]).first()
    d = discounts([int(x) for x in counts])
    whole = float(n_train + n_types + 1)
    train_docs = table.where("kind = 'document' and trains").count()

    c = F.col("counts")
    of_history = table.where("kind = 'history'").select(
        "history",
        sum(((i + 1) * c[i] for i in range(k)), c[k + 1]).alias("total"),
        sum((c[i] * ((i + 1) * (1 - d[i])) for i in range(k)), c[k] * how.delta).alias("missing"),
        c[k + 2].alias("seen"),
    )
    of_history = of_history.groupBy("history").agg(F.sum("total").alias("total"), F.sum("missing").alias("missing"), F.sum("seen").alias("seen"))
    # log10 of total * back-off weight: the history's total was taken off for every token
    weight = F.log10(F.col("missing") / (1 - F.col("seen") / whole))
    unseen = table.where("kind = 'unseen'").select("key", "history", "n", "base").join(of_history, "history", "left")
    backed = unseen.select("key", (F.col("base") - F.col("n") * math.log10(whole) + F.col("n") * F.coalesce(weight, F.lit(0.0))).alias("sure"))

    zero = F.lit(None)
    scored = table.where("kind = 'score'").select("key", zero.cast("long").alias("doc_id"), zero.cast("boolean").alias("trains"), zero.cast("long").alias("n"), "n_known", "base", (sum((c[i] * math.log10(d[i]) for i in range(k)), F.col("sure"))).alias("sure"), c[k].alias("evaluated"))
    listed = table.where("kind = 'document'").select("key", "doc_id", "trains", "n", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.lit(-math.log10(train_docs) if train_docs else 0.0).alias("sure"), F.lit(0).cast("long").alias("evaluated"))
    backed = backed.select("key", zero.cast("long").alias("doc_id"), zero.cast("boolean").alias("trains"), zero.cast("long").alias("n"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), "sure", F.lit(0).cast("long").alias("evaluated"))
    summed = listed.unionByName(scored).unionByName(backed).groupBy("key").agg(F.max("doc_id").alias("id"), F.max("trains").alias("trains"), F.max("n").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("sure").alias("score"), F.sum("evaluated").alias("evaluated"))
    whole_text = F.when(F.col("evaluated") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("the documents were not read alike in each round")).cast("long"))
    return summed.select("id", "trains", whole_text.alias("n_tokens"), "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(whole)).alias("base_score"), "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = score(docs.select(F.col("doc_id").alias("id"), "text", (~held_out).alias("trains")), stable=True)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
