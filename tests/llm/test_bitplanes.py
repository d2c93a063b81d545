"""Files of planes: exact round trips, and the query's rows against the library."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import bitplanes as b
from foldwise.llm.queries import QUERIES, vocabulary
from foldwise.sources.tables import shared_path


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 8, 1000, 65536])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2 ** 32, n, dtype=np.uint32)
    assert (b.from_planes(b.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_file_round_trip_and_random_access(bits):
    r, out = np.random.default_rng(1), io.BytesIO()
    docs = [(k if k % 5 else None, r.integers(0, 49408, n, dtype=np.uint32)) for k, n in enumerate([0, 1, 63, 64, 65, 1000, 0, 3])]
    w = b.PlaneWriter(_Kept(out), bits, block_ids=64)
    for doc, ids in docs:
        w.add(doc, ids.astype("<u4").tobytes())
    w.close()
    source = pa.BufferReader(out.getvalue())
    reader = b.PlaneReader(source)
    assert [(d, n, np.concatenate([*runs, np.zeros(0, "<u4")]).tolist()) for d, n, runs in reader.documents()] == [(d, len(i), i.tolist()) for d, i in docs]
    whole = np.concatenate([i for _, i in docs])
    assert (reader.ids(60, 500) == whole[60:560]).all() and not len(reader.ids(0, 0))
    with pytest.raises(Exception):
        b.PlaneReader(pa.BufferReader(out.getvalue()[:-9]))


class _Kept:
    def __init__(self, to):
        self.write, self.close = to.write, lambda: None


def expected(rows):
    from tokenizers import Tokenizer
    t, start, out = Tokenizer.from_file(vocabulary()), 0, []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ties_nulls_and_small_files(spark):
    texts = ["the cat", None, "", "a" * 500 + " '<|endoftext|>'s", "über\x0bmaß", "the cat"]
    rows = [(3, texts[0], 1), (1, texts[1], 2), (None, texts[2], 3), (2, texts[3], 4), (2, texts[4], 5), (3, texts[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)
    files = b.write_planes(df, vocabulary(), 1, shared_path(spark, "test-planes"), block_ids=16, file_ids=40)
    got = sorted(map(tuple, b.read_planes(files).collect()), key=lambda r: r[1])
    assert got == expected([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))])
    assert files.count() > 1
    assert b.shuffled_ids(df.limit(0), vocabulary(), 1).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, QUERIES["op5_bit_planes"](spark, sf).collect())) == expected(map(tuple, rows))


def test_new_runs_are_joined_and_keep_their_ids():
    class Counted:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **options)

    odd = ["İstanbul", "ß", "ﬁn", "한글", "가", "ªº", "ʰ", "ΑΣ", "don't", "'s", "a<b", "<|endoftext|>", "x́y", "é", "１２", "½", "a1b", "UPPER", "ab\x1ccd", "日本", "中a", "́z", "l'ami", "à,b"]
    plain = [f"{a}{c}{d}" for a in "abcdefgh" for c in "xyzuv" for d in "qwertyuiopasdfghjklm"] + list("0123456789") + ["!!", "--", "&&("]
    e = b.LibraryEncoder(vocabulary())
    want = {w: e.pack(w) for w in odd + plain}
    e.library = Counted(e.library)
    e.learn(plain)
    assert e.library.texts <= len(plain) / 50
    e.learn(odd)
    assert {w: e.known[w] for w in want} == want
    again = b.LibraryEncoder(vocabulary())
    again.learn(plain[:300] + odd)
    assert all(again.known[w] == want[w] for w in plain[:300] + odd)
