"""Repeated substrings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foldwise.llm import bwt_merge as b
from foldwise.llm.queries import QUERIES


def brute(rows, length=200):
    count = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        count.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = 1
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab cdéx\n") for _ in range(n))
    shared, tail = text(260), text(199)
    rows = [(k, text(r.randint(0, 900))) for k in range(30)]
    rows += [(40 + k, text(r.randint(0, 90)) + shared[r.randint(0, 60):] + text(50)) for k in range(12)]
    rows += [(60, "z" * 700), (61, "zy" * 300), (62, text(100) + tail), (63, tail + text(99)), (64, shared + shared), (65, None), (66, ""), (None, rows[3][1] + "!" * 300)]
    base = rows[4][1] + text(600)
    rows += [(70 + k, base[:300 + k] + "#" + base[301 + k:]) for k in range(5)]
    return rows + [rows[5], rows[5], (99, rows[35][1])]


@pytest.mark.parametrize("shard", [1, 700, 1 << 20])
def test_merged_shards_find_the_repeats(shard):
    r = np.random.default_rng(shard)
    sizes = np.array([0, 3, 40, 45, 200, 90, 41])
    data = r.integers(0, 2, sizes.sum()).astype(np.uint8)
    flat = np.split(data, np.cumsum(sizes)[:-1])
    flat[4][:41] = flat[6]
    data = np.concatenate(flat)
    got, count = b.repeated_starts(data, sizes, length=20, rounds=5, shard=shard), Counter()
    for s in flat:
        count.update(s[i:i + 20].tobytes() for i in range(len(s) - 19))
    want = np.concatenate([np.r_[[count[s[i:i + 20].tobytes()] > 1 if i + 20 <= len(s) else False for i in range(len(s))], False] for s in flat])
    assert (got == want.astype(bool)).all()


def test_order_is_the_suffix_order_of_symbols():
    r = np.random.default_rng(2)
    sizes = np.array([50, 30, 70])
    s = b.Strings(r.integers(0, 2, 150).astype(np.uint8), sizes, length=10, rounds=5)
    merged = s.merge([s.shard(0, 51), s.shard(51, 82), s.shard(82, 153)])
    key = lambda p: [s.names[q] for k in range(5) if (q := p + 2 * k) < len(s.names) and s.left[p] >= 2 * (k + 1)]
    keys = [key(p) for p in merged]
    assert sorted(merged) == list(range(153)) and all(x <= y for x, y in zip(keys, keys[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_digests(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS t").repartition(4)
    assert sorted(map(tuple, b.digests(df).collect()), key=str) == brute(rows)
    assert b.digests(df.limit(0)).count() == 0


def test_segments_do_not_change_the_strings(monkeypatch):
    data = np.frombuffer("".join(random.Random(1).choice("abc ") for _ in range(5000)).encode(), np.uint8)
    bounds = np.array([0, 10, 900, 900, 5000])
    whole = {(int(h), int(a)): None for h, a, *_ in zip(*b.anchored_strings(data, bounds))}
    monkeypatch.setattr(b, "SEGMENT", 333)
    assert {(int(h), int(a)) for h, a, *_ in zip(*b.anchored_strings(data, bounds))} == set(whole)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_bwt_merge"](spark, sf).collect()), key=str) == brute(rows)
