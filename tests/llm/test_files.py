"""Token files, media shards and WARC bundles: round trips, the queries' contracts, odd rows."""

import base64
import hashlib
import io
import random
import tarfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import media_store as M
from folioscope.llm import token_files as T
from folioscope.llm import warc_bundles as A
from folioscope.llm.common import work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 21, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = T.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits and (T.unpack(data, bits, n) == ids).all()
    assert T.width(2) == 1 and T.width(49_408) == 16 and T.width(65_537) == 17


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (5, 0, 200_000, 1, 70_000)]
    writer = T.TokenFileWriter(f"file://{tmp_path}/a.tok", 17)
    for i, x in enumerate(docs):
        writer.add(np.array([i]), np.array([False]), np.array([len(x)]), x)
    assert writer.close() == len(docs)
    file, every = T.TokenFile(f"file://{tmp_path}/a.tok"), np.concatenate(docs)
    assert file.n_ids == len(every) and len(file.offsets) == -(-len(every) // T.BLOCK) + 1
    for start, n in ((0, 5), (65_530, 20), (131_072, 1), (100_000, 150_000), (len(every) - 3, 3), (7, 0)):
        assert (file.ids(start, n) == every[start : start + n]).all()


def test_cached_tokenizer_is_exact():
    ref, own, r = Tokenizer.from_file(PATH), T.WordCachedTokenizer(PATH), random.Random(2)
    chars = "abcdeABC theing 123!?.,'sst  \n\t\x1c\x1d\x85\xa0 éÉñßİΣς中ﬁǺ<|startoftext|>"
    texts = ["", " ", "A<|endoftext|>B", "<|ENDOFTEXT|>", "ΑΣ ΑΣΑ", "H\u0331 T\u0308x h\u0331 I\u0307", "a|b | || x|", *("".join(r.choice(chars) for _ in range(r.randrange(50))) for _ in range(3000))]
    want = [x.ids + [1] for x in ref.encode_batch(texts, add_special_tokens=False)]

    def encoded():
        return [x.tolist() for begin, end, ids, counts in own.encode(pa.array(texts), 1) for x in np.split(ids, np.cumsum(counts)[:-1])]

    assert encoded() == want
    own.cache.limit = 2000  # the cache gives way and the ids stay the same
    r.shuffle(texts)
    want = [x.ids + [1] for x in ref.encode_batch(texts, add_special_tokens=False)]
    own.SLICE = 500
    assert encoded() == want and encoded() == want


def test_token_query(spark, tables):
    got = sorted(T.op1(spark, tables).collect())
    ref, start = Tokenizer.from_file(PATH), 0
    docs = sorted(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for r, (doc_id, text) in zip(got, docs):
        ids = [*ref.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (None, "a b", 2), (5, "", 3), (9, "word " * 90_000, 4)], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in T.read_token_files(T.write_token_files(docs, work_dir(spark, "t"), PATH)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 5, 5, 9] and [r[2] for r in got] == [3, 1, 1, 90_001] and [r[1] for r in got] == [0, 3, 4, 5]
    assert T.read_token_files(T.write_token_files(docs.limit(0), work_dir(spark, "t"), PATH)).count() == 0


def test_files_roll(spark):
    """One doc_id holds most rows: its range rolls over several files, in order."""
    docs = spark.createDataFrame([(1 if i % 10 else i, f"word{i} " * 12) for i in range(200)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        manifest = T.write_token_files(docs, work_dir(spark, "t"), PATH, files=1, roll=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((tuple(r) for r in T.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert manifest.count() > 5 and len(got) == 200 and [r[0] for r in got] == sorted(r[0] for r in got)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(200)]


def test_png_and_tar_are_standard():
    payload = M.pad("héllo wörld".encode() * 50)
    assert M.from_png(M.to_png(payload)) == payload and len(payload) % 192 == 0 and M.pad(b"") == b" " * 192
    data = M.tar_header("x.png", 5) + b"12345".ljust(512, b"\0") + b"\0" * 1024
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        assert tar.extractfile("x.png").read() == b"12345"
    with pytest.raises(ValueError):
        M.from_png(M.to_png(payload)[:-20] + b"x" * 20)


def test_media_query(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = M.op5(spark, tables).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        payload = M.pad(docs[r.doc_id].encode())
        media = M.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(docs[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r.feature, r.width, r.height) == (M.feature(payload), 192, len(payload) // 192)


def test_media_odd_rows(spark):
    out = work_dir(spark, "m")
    rows = spark.createDataFrame([(1, None), (2, b""), (None, b"x"), (3, b"x"), (3, b"x"), (4, b"y" * 400_000)], "id long, payload binary")
    places = M.store(rows, out, shard_bytes=1)
    assert places.count() == 6 and M.index_of(places).count() == 3
    assert {(r.width, r.height, r.bit_depth, r.colour_type) for r in M.read_headers(M.index_of(places)).collect()} == {(192, 1, 8, 0), (192, 2084, 8, 0)}
    assert M.read_features(M.index_of(places)).agg(F.sum("payload_bytes")).first()[0] == 192 * 2086
    assert M.store(rows.limit(0), work_dir(spark, "m")).count() == 0


def test_warc_query(spark, tables):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    newest = {}
    for i, html in pages.items():
        newest[html] = max(i, newest.get(html, i))
    got = A.op6(spark, tables).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        payload, first = pages[r.page_id].encode(), newest[pages[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_warc_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "a\r\n\r\nb"), (7, "v w", "a\r\n\r\nb"), (7, "v w", "a\r\n\r\nb"), (None, "u", "a\r\n\r\nb"), (None, "z", "only"), (8, "u", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, frame int")
    got = A.read_bundles(A.write_bundles(pages, work_dir(spark, "w"))).collect()
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert len(got) == len(rows)
    assert kinds == {(1, 0): ("revisit", 2), (2, 0): ("response", None), (3, 6): ("revisit", 7), (7, 6): ("response", None), (None, 6): ("revisit", 7), (None, 4): ("response", None), (8, 600_000): ("response", None)}
    assert A.read_bundles(A.write_bundles(pages.limit(0), work_dir(spark, "w"))).count() == 0


def test_bundle_is_plain_zstandard(tmp_path):
    import zstandard

    bundle, places = A.Bundle(f"file://{tmp_path}/x.warc.zst"), []
    records = [A.record(i, "u", bytes([97 + i]) * 100_000, b"d" * 20, None) for i in range(6)]
    for x in records:
        places.append((*bundle.add(x), len(x)))
    bundle.close()
    data = (tmp_path / "x.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    reader = A.BundleReader(f"file://{tmp_path}/x.warc.zst")
    assert len(reader.frames) > 1 and all(reader.read(*p) == x for p, x in zip(reversed(places), reversed(records)))


def test_failed_writers_leave_nothing(tmp_path):
    shards = M.TarShards(f"file://{tmp_path}/shard-0", 1 << 10)
    for i in range(3):
        shards.add(f"{i}.png", b"x" * 700)
    shards.abandon()
    bundle = A.Bundle(f"file://{tmp_path}/bundle-0.warc.zst")
    bundle.add(b"y" * 100)
    bundle.file.abandon()
    assert not [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp") or "bundle" in p.name]
