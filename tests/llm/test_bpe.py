import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hitsieve.llm import bpe

SEEDS = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "re", "1", "23", "!", "|", "<|endoftext|>", "<|", "endoftext", "t|", "é", "漢", "字",
         "　", "\xa0", "😀", "xyzzyqq", "ABC", ".", "\t", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_code_point(library):
    code = bpe.codec()
    for low in range(0, 0x110000, 256):
        text = "".join(f"a{chr(i)}b {chr(i)}1 {chr(i)}{chr(i)} x" for i in range(low, low + 256) if not 0xD800 <= i < 0xE000)
        if low < 0x3400 or low % 0x4000 == 0 or 0xF000 < low < 0x12000:
            assert code.encode(text).tolist() == ids(library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SEEDS), max_size=60).map("".join), st.integers(1, 30))
def test_tree_gives_the_same_ids(text, leaf):
    library = Tokenizer.from_file(bpe.VOCABULARY) if not hasattr(bpe, "_test") else bpe._test
    bpe._test = library
    got = bpe.encode_tree(bpe.codec(), text, leaf)
    assert got.tolist() == ids(library, text)
    assert bpe.codec().decode(got) == text == library.decode(got.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["abcdefghij" * 2000, "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(40000)),
                                  " " * 20000 + "x", "1" * 20000, "漢字" * 5000, "!?" * 9000, "<|endoftext|>" * 700])
def test_long_unsplit_texts(library, text):
    got = bpe.encode_tree(bpe.codec(), text, 500)
    assert got.tolist() == ids(library, text)


def test_broken_bytes_decode_as_the_library_does(library):
    some = [i for i, piece in enumerate(bpe.codec().pieces[:400]) if piece and piece[0] >= 0x80][:60]
    assert bpe.codec().decode(np.array(some, "<u4")) == library.decode(some, skip_special_tokens=False)


def test_documents(spark, library):
    texts = [None, "", "a", "hello world", "hello world", "word " * 300, "x" * 700, "é" * 333 + "<|endoftext|>" + "z" * 200]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encoded(docs, leaf=50).withColumn("back", bpe.decoder()("ids")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = np.array(ids(library, text or ""), "<u4")
        assert hashlib.sha256(got[i].ids).digest() == hashlib.sha256(want.tobytes()).digest()
        assert got[i].back == (text or "") and got[i].text == text
    assert bpe.encoded(docs.limit(0)).count() == 0
