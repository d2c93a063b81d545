"""The transducer against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import pytest

from foldwise.llm import bpe_stream as b
from foldwise.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return b.Tokenizer(vocabulary())


def ids_of(own, text):
    return np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()


def odd_texts():
    r = random.Random(5)
    letters = "abcdeéöñßÉÀ'!?#1289  \n\t ́ͅ字中文가각가🎉😀👩‍\u0085\x1cΣσςİıﬁ—…"
    out = ["", " ", "don't 'stop' we'll 'rehash", "<|endoftext|>x<|startoftext|><|endoftext|", "''''s''''", "a" * 3000, "é" * 2000, "ab" * 40000, "!?" * 5000 + "'s",
           "'" * 9000, "字" * 9000, "9" * 4000, "각" * 3000, "x" * 700 + "'t" + "y" * 700, "the" * 30000]
    return out + ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(400)]


def test_ids_and_text_are_the_librarys(library, own):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = ids_of(own, text)
        assert got == want, text[:80]
        d = b.Decoder(own)
        assert d.push(got) + d.close() == library.decode(want, skip_special_tokens=False)


def test_small_chunks_give_the_same_ids(library, own):
    r = random.Random(3)
    for text in odd_texts():
        text = "".join(text.split())[:6000]
        if "<|" in text or not text:
            continue
        got = np.frombuffer(b"".join(own.stream(text, r.choice([7, 50, 333]))), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_the_transducer_holds_a_bounded_tail(own):
    r, t = random.Random(9), b.Transducer(own.merges, step=64)
    letters = "".join(r.choice("thenigaor") for _ in range(30000))
    got = []
    for k in range(0, len(letters), 37):
        got += t.push(letters[k:k + 37])
        assert len(t.held) <= t.most
    assert got + t.close() == np.frombuffer(own.word(letters), "<u4").tolist()


def test_bytes_become_text_as_soon_as_they_are_whole(own):
    text = "naïve 🎉 字"
    d, out = b.Decoder(own, joined=False), ""
    for i in ids_of(own, text):
        out += d.push([i])
    assert (out + d.close()).split() == text.split()


def test_frame(spark, own):
    rows = [(1, "The the", 5), (None, None, 6), (1, "The the", 5), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    got = b.encode_decode(df, vocabulary())
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    out = sorted((r.doc_id or 0, tuple(r.ids), r.decoded) for r in got.collect())
    the = tuple(ids_of(own, "The the"))
    assert out == [(0, (), ""), (1, the, "the</w> the</w>"), (1, the, "the</w> the</w>"), (4, (), "")]
    sums = {r.n_tokens: (r.ids_sha256, r.decoded_sha256) for r in b.digests(df, vocabulary()).collect()}
    assert sums[0] == (hashlib.sha256().hexdigest(),) * 2
    assert sums[2] == (hashlib.sha256(np.array(the, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"the</w> the</w>").hexdigest())
    assert b.digests(df.limit(0), vocabulary()).count() == 0
