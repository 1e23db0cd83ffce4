"""Byte-level BPE by backtracking over Aho-Corasick matches; decoding by an offset table.

For a piece of text the automaton lists, in one pass, every vocabulary token
that begins at each position. The encoder takes the longest one whose pairing
with the token before is *compatible*: BPE, run on the two tokens' bytes
alone, would end with just these two. If none fits it steps back. Compatible
neighbours everywhere are exactly the result of the merges, and each position
is given up at most once, so the time is linear in the piece.

Compatibility is decided by undoing merges from the joint outwards and is kept
in a bounded table. The parts between spaces are numbered by Arrow and their
ids kept in a cache bounded in bytes; neither bound changes a result.

Null text counts as empty. Repeated rows give repeated results. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, slices
from .pieces import PieceCache

#: White space of the splitting pattern (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public splitting pattern of the rank files, with that white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next code point from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBPE:
    PAIRS = 200_000
    CACHE_BYTES = 32 << 20

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path) as f:
            spec = json.load(f)
        symbols = byte_symbols()
        as_bytes = lambda s: "".join(chr(symbols[c]) for c in s)  # noqa: E731  one char a byte
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.size = max([*vocab.values(), *special.values()]) + 1
        # Where a token comes from: ranks, and the two parts of its merge. Bytes are their own parts.
        self.rank, self.left, self.right = [-1] * self.size, list(range(self.size)), list(range(self.size))
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            token, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merge[pair] = rank
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, *pair
        self.length = [0] * self.size
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            self.length[token] = len(text)
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        table = [b""] * self.size
        for text, token in vocab.items():
            table[token] = text.encode("latin-1")
        for text, token in special.items():
            table[token] = text.encode()
        self.offsets = np.cumsum([0, *map(len, table)])
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece_pattern = regex.compile(PIECES)
        self.vocab = vocab
        self.fits: dict[int, bool] = {}
        self.cache = PieceCache(self._parts, self.CACHE_BYTES)

    def compatible(self, a: int, b: int) -> bool:
        """Would the merges leave a and b as they are, side by side?

        Undo, step by step, the later of the two merges next to the joint. At
        each step a merge across the joint must not have come before the merge
        that covers one of its parts.
        """
        key = a * self.size + b
        found = self.fits.get(key)
        if found is None:
            found = self._compatible(a, b)
            if len(self.fits) >= self.PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        rank, left, right, merge = self.rank, self.left, self.right, self.merge
        before = len(merge) * 2 + 2  # twice the rank below which a merge across wins; odd: ties win too
        while True:
            across = merge.get((a, b))
            if across is not None and 2 * across < before:
                return False
            # Of equal ranks the left one is merged first, so it is undone last.
            if rank[a] > rank[b]:
                before, a = 2 * rank[a], right[a]
            elif rank[b] >= 0:
                before, b = 2 * rank[b] + 1, left[b]
            else:
                return True

    def _merge_piece(self, piece: str) -> list[int]:
        """Ids of one piece; a char of the string is a byte."""
        whole = self.vocab.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        begins: list[list[int]] = [[] for _ in range(n)]  # tokens by first position, the shortest first
        for end, (token, length) in self.automaton.iter(piece):
            begins[end - length + 1].append(token)
        length, compatible = self.length, self.compatible
        alive = [True] * (n + 1)
        out: list[int] = []
        trial: list[int] = []  # next alternative at the position where each token of out begins
        at, k = 0, len(begins[0]) - 1
        while at < n:
            options, last = begins[at], out[-1] if out else -1
            while k >= 0:
                token = options[k]
                if alive[at + length[token]] and (last < 0 or compatible(last, token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                trial.append(k - 1)
                at += length[token]
                k = len(begins[at]) - 1 if at < n else -1
            else:
                alive[at] = False
                at -= length[out.pop()]
                k = trial.pop()
        return out

    def _chunk(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.piece_pattern.findall(text):
            ids += self._merge_piece(piece.encode().decode("latin-1"))
        return ids

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        from array import array

        flat, counts = array("I"), np.empty(len(parts), np.int64)
        for i, part in enumerate(parts):
            ids = [self.special[part]] if part in self.special else self._chunk(part)
            flat.extend(ids)
            counts[i] = len(ids)
        return np.frombuffer(flat, np.uint32) if len(flat) else np.empty(0, np.uint32), counts

    def _pieces_of(self, text: str) -> list[str]:
        """Pieces of the pattern, and special tokens."""
        out = []
        for i, x in enumerate(self.special_pattern.split(text) if self.special_pattern is not None else [text]):
            out += [x] if i % 2 else self.piece_pattern.findall(x)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        return self.encode_all(pa.array([text or ""]))[0].astype("<u4").tobytes()

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts in a row, and how many each has.

        A space between two other characters always begins a piece, so a text
        is cut before such spaces and looked up part by part. A text with
        spaces elsewhere, or with special tokens, is cut by the pattern.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        odd = pc.match_substring_regex(texts, f"[{SPACE}] |  | [{SPACE}]| $")
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        spaced = np.ones(len(codes), np.int64)
        spaced[np.cumsum(sizes) - sizes] = 0  # the first part of a text has no space before it
        used = np.unique(codes * 2 + spaced)
        words = pc.if_else(pa.array(used % 2 == 1), pc.binary_join_element_wise(" ", coded.dictionary.take(pa.array(used // 2)), ""), coded.dictionary.take(pa.array(used // 2)))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = [self._pieces_of(texts[i].as_py()) for i in whole]
        found = self.cache.places(pa.concat_arrays([words, pa.array([x for pieces in cut for x in pieces], pa.string())]))
        place = np.empty(2 * n, np.int64)
        place[used] = found[: len(used)]
        ids, counts = self.cache.gather(place[codes * 2 + spaced], sizes)
        if not whole:
            return ids, counts
        each = np.split(ids, np.cumsum(counts)[:-1])
        more, sizes = self.cache.gather(found[len(used) :], np.fromiter(map(len, cut), np.int64, len(cut)))
        for i, x in zip(whole, np.split(more, np.cumsum(sizes)[:-1])):
            each[i] = x
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; the bytes of all tokens are gathered at once from the offset table."""
        tokens = np.frombuffer(ids, "<u4")
        begin, length = self.offsets[tokens], self.offsets[tokens + 1] - self.offsets[tokens]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        where = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
        data = self.flat[where].tobytes()
        try:
            data.decode()
            return data
        except UnicodeDecodeError:  # the ids end inside a character
            return data.decode("utf-8", "replace").encode()


_LOADED: dict[str, BacktrackingBPE] = {}


def bpe_of(path: str) -> BacktrackingBPE:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, keep: bool = False, keep_text: bool | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its ids' and decoded text's digests; with ``keep`` also ids and, unless ``keep_text`` is False, decoded text."""
    keep_text = keep if keep_text is None else keep_text

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        give_back()
        bpe = bpe_of(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for begin, end in slices(pc.utf8_length(texts).to_pylist(), 1 << 21):
                flat, counts = bpe.encode_all(texts.slice(begin, end - begin))
                stops = np.cumsum(counts).tolist()
                ids = [flat[b - n : b].astype("<u4").tobytes() for b, n in zip(stops, counts.tolist())]
                decoded = [bpe.decode(x) for x in ids]
                out = {
                    "doc_id": batch.column(0).slice(begin, end - begin).cast(pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                }
                if keep:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                if keep_text:
                    out["decoded"] = pa.array([x.decode() for x in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(out)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, ROWS + ", ids array<int>" * keep + ", decoded string" * keep_text)


def op8(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
