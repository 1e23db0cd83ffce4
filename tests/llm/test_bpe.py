import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm.bpe import BacktrackingBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE, REF = BacktrackingBPE(PATH), Tokenizer.from_file(PATH)
ALPHABET = "abcdefghij theingon  \n\t\r\x1c\x85\xa0 　'sdtrevml0123456789!?.,-_éßñü中文日本ΣЖ😀́<|endoftext|>"


def same(text):
    ids = np.frombuffer(BPE.encode(text), "<u4").tolist()
    assert ids == REF.encode(text, add_special_tokens=False).ids, repr(text)
    assert BPE.decode(BPE.encode(text)).decode() == REF.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "  ", "   a", "a   b", "a \n b", "\n\n a", "x\n  y ", "don't we'll", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "　　a", "a\x1c b", " a\x85b  \x85 c", "0" * 500, "-" * 333 + "=" * 77])
def test_given_texts(text):
    same(text)


def test_random_strings():
    r = random.Random(5)
    for _ in range(4000):
        same("".join(r.choice(ALPHABET) for _ in range(r.randrange(60))))
    for _ in range(1500):
        same("".join(r.choice("ainersto th") for _ in range(r.randrange(90))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


def test_long_text_is_linear():
    same("theingontion" * 20_000)
    same("a" * 30_000)


def test_split_character_is_replaced():
    ids = BPE.encode("é😀")[:-4]
    assert BPE.decode(ids).decode() == REF.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_query(spark, tables):
    import hashlib

    from folioscope.llm.bpe import encode_decode, op8

    rows = op8(spark, tables).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = REF.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(REF.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, 1), (7, "", 2), (7, "ab", 3), (7, "ab", 3)], "doc_id long, text string, n_tokens int")
    out = encode_decode(odd, PATH, keep=True).collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(None, ""), (7, ""), (7, "ab"), (7, "ab")]
    assert encode_decode(odd.limit(0), PATH).count() == 0
