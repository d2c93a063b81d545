"""Cover trees and the hard negatives found in them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import cover_tree as t
from foldwise.llm.queries import QUERIES


def brute(rows, is_anchor, positives=5, negatives=5, least=80):
    """rows: (id, label, whole vector); each once."""
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        others = sorted((-int(np.dot(v, x)), j, k) for j, k, x in rows if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:positives]:
            hard = [o for o in others if o[2] != label and least * -s <= 100 * -o[0] <= 100 * -s][:negatives]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_bounds_hold_and_windows_are_skipped():
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16)) * 200
    x = np.floor(np.concatenate([c + r.normal(size=(200, 16)) * 8 for c in centres])).astype(np.int64)
    norm2 = int((x * x).sum(axis=1).max())
    tree = t.CoverTree(x, norm2)
    q = x[::100]
    length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    nodes = np.arange(len(tree.centre))
    lo, hi = tree.bounds(q.astype(float), length, nodes)
    for k in nodes:
        s = q @ x[tree.order[tree.first[k]:tree.first[k] + tree.size[k]]].T
        assert (s >= lo[:, k:k + 1]).all() and (s <= hi[:, k:k + 1]).all()
    leaves = tree.children == 0
    assert tree.size[leaves].sum() == len(x) and sorted(tree.order) == list(range(len(x)))
    n = len(q)
    best = t.Best(n, 5)
    zero = np.zeros(n, np.int64)
    big = np.iinfo(np.int64).max // 2
    exact = t.search(tree, np.arange(len(x)), np.zeros(len(x), np.int64), q, np.full(n, -1), zero, np.arange(n), np.full(n, -big), np.full(n, big), True, best)
    best.settle()
    want = [np.lexsort((np.arange(len(x)), -(x @ v)))[:5].tolist() for v in q]
    assert [best.key[best.query == k].tolist() for k in range(n)] == want
    assert exact < 0.5 * n * len(x)  # most leaves were never opened


def test_large_products_stay_exact():
    a, b = np.array([[2 ** 27, 3]]), np.array([[2 ** 27, 1], [2 ** 27 - 1, 0]])
    assert t.products(a, b).tolist() == [[2 ** 54 + 3, 2 ** 54 - 2 ** 27]]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int))
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    assert want and found(QUERIES["op13_hard_negatives"](spark, sf)) == want


@pytest.mark.parametrize("block", [1, 1000])
def test_clusters_ties_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(t, "TREE", 150)
    r = np.random.default_rng(3)
    centres = r.integers(-6, 7, (6, 4))
    rows, seen = [], set()
    for i in range(700):
        v = centres[i % 6] + r.integers(-1, 2, 4) if i % 3 else centres[0]  # a third are one vector
        rows.append((i, int(r.integers(3)), v))
        seen.add(tuple(v))
    df = spark.createDataFrame([(i, k, [float(c) / 256 for c in v]) for i, k, v in rows], "vec_id long, label int, embedding array<double>")
    want = brute(rows, lambda i: i % 50 == 0)
    assert want and found(t.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block * 4)) == want


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [1.0, 0.0]), (1, "a", [0.9, 0.1]), (2, "b", [0.8, 0.0]), (3, "b", [0.85, 0.5]), (4, None, [1.0, 0.0]), (5, "b", None),
            (6, "b", [nan, 1.0]), (7, "b", [None, 1.0]), (8, "b", [0.9]), (None, "b", [0.9, 0.0]), (9, "b", []), (10, "b", [-1.0, 0.0]), (11, "c", [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS id", "3 AS v")
    got = found(t.hard_negatives(df, F.col("vec_id") % 100 == 0))
    s = lambda x, y: int(np.floor(256 * np.array(x)) @ np.floor(256 * np.array(y)))
    a, p = [1.0, 0.0], s([1.0, 0.0], [0.9, 0.1])
    assert got == [(0, 1, 1, 3, p, s(a, [0.85, 0.5])), (0, 1, 2, 2, p, s(a, [0.8, 0.0]))]
    assert t.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert t.hard_negatives(df, F.lit(False)).count() == 0
    assert t.hard_negatives(df.where("vec_id < 2"), F.col("vec_id") == 0).count() == 0
