"""Token-ID files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that the vocabulary needs. A file is::

    magic | block 0 | block 1 | ... | doc_id int64[n] | doc_id is null uint8[n]
          | first token uint64[n + 1] | block offset uint64[blocks] | footer | footer length | magic

Each block packs BLOCK ids (the last one fewer), so any id range is read with
one range read of the blocks that hold it and unpacked by numpy.

A task rolls to its next file after ROLL ids, so that a file and what is held of
it stay bounded however many rows one range of doc_ids has.

Null text counts as empty (only the end id is written). Rows with a null
doc_id come first. Equal doc_ids are ordered by a hash of their text, then by
the text; they may lie in several files. An empty table gives no file. Columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AtomicFile, RangeReader, partitions, slices, work_dir
from .pieces import PieceCache

MAGIC = b"FSTOKEN1"
BLOCK = 65_536  # a multiple of 64
ROLL = 1 << 25
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long, bits int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width(vocabulary: int) -> int:
    """Bits that the ids 0 .. vocabulary - 1 need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian packing; the ids are padded with zeros to whole groups of 64."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed groups, as uint32."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, i] = lane & mask
    return lanes.reshape(-1)[:count]


class TokenFileWriter:
    """Streams documents' ids into one file; holds at most a block and the document index."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.file, self.bits = uri, AtomicFile(uri), bits
        self.file.write(MAGIC)
        self.pending, self.n_pending, self.n_ids = [], 0, 0
        self.blocks, self.doc_ids, self.counts = [], [], []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """ids: of all these documents in a row, counts of each."""
        self.doc_ids.append((doc_ids.astype("<i8"), nulls.astype("u1")))
        self.counts.append(counts)
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, end, BLOCK):
            self.blocks.append(self.file.write(pack(ids[at : min(at + BLOCK, end)], self.bits)))
        self.pending, self.n_pending = [ids[end:].copy()], len(ids) - end

    def close(self) -> int:
        """Returns the number of documents."""
        self._flush(True)
        starts = np.cumsum(np.concatenate([[0], *self.counts])).astype("<u8")
        at = self.file.at
        for part in [*(x for x, _ in self.doc_ids), *(x for _, x in self.doc_ids)]:
            self.file.write(part.tobytes())
        self.file.write(starts.tobytes())
        self.file.write(np.array(self.blocks, "<u8").tobytes())
        footer = json.dumps({"bits": self.bits, "block": BLOCK, "blocks": len(self.blocks), "docs": len(starts) - 1, "ids": self.n_ids, "index": at}).encode()
        self.file.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.file.commit()
        return len(starts) - 1


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.file = RangeReader(uri)
        tail = self.file.read(self.file.size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file, or is cut short")
        (length,) = struct.unpack("<I", tail[:4])
        meta = json.loads(self.file.read(self.file.size - 12 - length, length))
        self.bits, self.block, self.n_ids, n, blocks, at = (meta[k] for k in ("bits", "block", "ids", "docs", "blocks", "index"))
        index = self.file.read(at, self.file.size - 12 - length - at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.starts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks, 17 * n + 8), at).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """ids start .. start + count - 1 of the file, by one range read."""
        if count <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        data = self.file.read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block
        return unpack(data, self.bits, start + count - base)[start - base :]

    def close(self) -> None:
        self.file.close()


class WordCachedTokenizer:
    """The tokenizers library behind a bounded cache of white-space separated pieces.

    Texts are split and their pieces numbered by Arrow; only pieces that the
    cache lacks reach the library, many at once, with a separator between them.
    Exact only for tokenizers whose normalizer and splitter never look across
    white space and drop it (``by_piece``); others get whole texts.
    """

    CACHE_BYTES = 32 << 20  # of pieces, ids and offsets
    SLICE = 8 << 20  # characters, about
    JOINED = 2000
    SEPARATOR = "|"  # no other character normalizes to it
    ODD = "[\x1c-\x1f]"  # white space for Arrow, but not for the tokenizer

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path) as f:
            meta = json.load(f)
        steps = (meta.get("pre_tokenizer") or {}).get("pretokenizers") or [meta.get("pre_tokenizer") or {}]
        self.added = [x["content"] for x in meta.get("added_tokens") or []]
        plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in meta.get("added_tokens") or [])
        self.by_piece = plain and any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in steps)
        kinds = (meta.get("normalizer") or {}).get("normalizers") or [meta.get("normalizer") or {}]
        self.folds_case = any(x.get("type") == "Lowercase" for x in kinds)
        mark = self._raw([self.SEPARATOR])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None  # the id that stands between joined pieces
        self.cache = PieceCache(self._pieces, self.CACHE_BYTES)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", x.ids), np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many each has."""
        alone = [i for i, x in enumerate(pieces) if self.mark is None or self.SEPARATOR in x or any(a in x for a in self.added)]
        separate = dict(zip(alone, self._raw([pieces[i] for i in alone])))
        found: list[np.ndarray] = []
        for at in range(0, len(pieces) if self.mark is not None else 0, self.JOINED):
            part = ["" if i in separate else pieces[i] for i in range(at, min(at + self.JOINED, len(pieces)))]
            joined = self._raw([f" {self.SEPARATOR} ".join(part)])[0]
            own = np.split(joined, np.flatnonzero(joined == self.mark))
            found += [x[1:] if i else x for i, x in enumerate(own)] if len(own) == len(part) else self._raw(part)
        if self.mark is None:
            found = [separate[i] for i in range(len(pieces))]
        else:
            for i, x in separate.items():
                found[i] = x
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        lists = pc.utf8_split_whitespace(texts)
        coded = pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary
        if self.folds_case:  # spellings of ASCII words fall together; special tokens are told by their case
            plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
            words = pc.if_else(plain, pc.ascii_lower(words), words)
        codes = self.cache.places(words)[coded.indices.to_numpy()]
        return self.cache.gather(codes, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), end_id)

    def encode(self, texts, end_id: int):
        """Yields (begin, end, ids, counts) of slices of an Arrow array of texts; each text's ids end with ``end_id``."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        sizes = pc.binary_length(texts).to_pylist()
        for first, stop in slices(sizes, self.SLICE):
            edges = [first, *(np.flatnonzero(np.diff(odd[first:stop])) + first + 1).tolist(), stop]
            for begin, end in zip(edges, edges[1:]):
                part = texts.slice(begin, end - begin)
                if odd[begin]:
                    each = [np.append(x, np.uint32(end_id)) for x in self._raw(part.to_pylist())]
                    yield begin, end, np.concatenate(each), np.array([len(x) for x in each])
                else:
                    yield begin, end, *self._words(part, end_id)


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer_of(path: str) -> WordCachedTokenizer:
    """One per worker process and file, so that its cache serves later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, files: int | None = None, roll: int = ROLL) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ascending doc_id order; returns the manifest.

    The rows are dealt by ranges of doc_id, so file k holds smaller ids than
    file k + 1. The manifest itself is a table beside the files.
    """
    spark = docs.sparkSession

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = tokenizer_of(tokenizer)
        bits = width(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        task, number, writer = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            n = writer.close()
            shard = (task << 24) + number
            return pa.RecordBatch.from_pydict({"shard": [shard], "path": [writer.uri], "n_docs": [n], "n_tokens": [writer.n_ids], "n_bytes": [writer.file.at], "bits": pa.array([bits], pa.int32())})

        try:
            for batch in batches:
                ids = batch.column(0).cast(pa.int64())
                values, nulls = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for begin, end, encoded, counts in encoder.encode(batch.column(1), end_id):
                    if writer is None:
                        writer = TokenFileWriter(f"{out}/shard-{task:06d}-{number:06d}.tok", bits)
                    writer.add(values[begin:end], nulls[begin:end], counts, encoded)
                    if writer.n_ids >= roll:
                        yield closed()
                        writer, number = None, number + 1
            if writer is not None:
                yield closed()
        except BaseException:
            if writer is not None:
                writer.file.abandon()
            raise

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ranged = hashed.repartitionByRange(files or partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    manifest = ranged.select("doc_id", "text").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = TokenFile(path)
                counts = np.diff(file.starts)
                for begin, end in slices(counts.tolist(), 1 << 20):
                    first = int(file.starts[begin])
                    ids = file.ids(first, int(file.starts[end]) - first).astype("<u4")
                    at = (file.starts[begin : end + 1] - first).tolist()
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids[begin:end], pa.int64(), mask=file.nulls[begin:end]), "start": file.starts[begin:end] + base, "n_tokens": counts[begin:end], "ids_crc32": pa.array(crcs, pa.int64())})
                file.close()

    return placed.repartition(partitions(spark), "shard").mapInArrow(read, ROWS)


def op1(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, work_dir(spark, "tokens"), vocabulary or public_tokenizers.path("word_bpe_49k.json")))
