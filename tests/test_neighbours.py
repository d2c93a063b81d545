"""Neighbour mutual information against brute force; contributions of a forest against its predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import contributions as C
from foldwise.operators import evaluate as E
from foldwise.operators import neighbours as N
from foldwise.operators import ranks as R


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))


def brute(v, y, k=3):
    v, y = np.array(v, float), np.array(y)
    keep = np.array([np.sum(y == c) > 1 for c in y])
    v, y = v[keep], y[keep]
    total = 0.0
    for i in range(len(v)):
        own = np.flatnonzero(y == y[i])
        kk = min(k, len(own) - 1)
        d = np.sort(np.abs(v[own[own != i]] - v[i]))[kk - 1]
        m = np.sum(v == v[i]) if d == 0 else max(1, np.sum((v > v[i] - d) & (v < v[i] + d)))
        total += psi(kk) - psi(len(own)) - psi(m)
    return max(0.0, psi(len(v)) + total / len(v))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equal_to_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(R, "bucket_count", lambda df: 40)  # buckets with fewer values than neighbours
    r = np.random.default_rng(k)
    y = r.choice(["a", "b", "c"], 260, p=[0.7, 0.25, 0.05])
    cols = {"far": np.round(r.normal(size=260) + 2 * (y == "b"), 3), "ties": r.integers(0, 5, 260).astype(float), "hot": np.where(r.random(260) < 0.4, 1.5, np.round(r.random(260), 2)),
            "same": np.full(260, 2.0), "alone": r.random(260)}
    y[0] = "single"
    df = spark.createDataFrame([(str(c), *(float(cols[n][i]) for n in cols)) for i, c in enumerate(y)], "y string, " + ", ".join(f"{n} double" for n in cols)).repartition(4)
    got = {x.feature: (x.n, x.mi) for x in N.neighbour_mi(df, list(cols), "y", k).collect()}
    for n, v in cols.items():
        assert got[n][0] == 259 and got[n][1] == pytest.approx(brute(v, y, k), abs=2e-6), n
    assert got["far"][1] > got["alone"][1]


def test_missing_values_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.5), (None, 1.0), ("a", None), ("b", nan), ("b", inf)]
    df = spark.createDataFrame(rows, "y string, v double")
    got = N.neighbour_mi(df, ["v"], "y").collect()
    assert [(r.n, r.mi) for r in got] == [(4, pytest.approx(brute([1, 1, 2, 2.5], list("aabb")), abs=1e-6))]
    assert N.neighbour_mi(df.limit(0), ["v"], "y").count() == 0 and N.neighbour_mi(df.where("y IS NULL"), ["v"], "y").count() == 0


def test_digamma(spark):
    got = spark.range(1, 200).select("id", N.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 2e-9 for r in got)


def test_contributions_sum_to_the_prediction(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(500):
        y = int(r.integers(3))
        rows.append((i, float(y), float(r.normal(2 * y)), float(r.normal()), "x" if (y == 1) ^ (r.random() < 0.1) else "z"))
    df = spark.createDataFrame(rows, "id int, label double, a double, b double, c string")
    score = E.forest(["a", "b"], "label", ["c"], trees=7, depth=4, weight=None)(df)
    names = ["a", "b", "c"]
    out = C.forest_contributions(score(df), score.forest, names)
    for x in out.collect():
        total = np.array(x.base) + np.sum(x.contributions, axis=0)
        assert np.allclose(total, x.probability, atol=1e-9) and abs(sum(x.base) - 1) < 1e-9
    ranks = {(x["class"], x["feature"]): x["rank"] for x in C.contribution_ranking(out, names, 3).collect()}
    assert len(ranks) == 9 and ranks[2, "a"] == 1 and all(ranks[c, "b"] == 3 for c in (0, 1, 2)) and ranks[1, "c"] == 1


def test_rows_of_the_same_leaves_are_counted(spark):
    import numpy as np
    from foldwise.operators import contributions as C
    tables, shares = [np.array([[[0.2, -0.2]], [[-0.1, 0.1]]]), np.array([[[0.4, -0.4]], [[0.0, 0.0]]])], np.array([0.5, 0.5])
    leaves = spark.createDataFrame([(0, 0)] * 3 + [(1, 1)] * 2 + [(0, 1)], "_t0 int, _t1 int")
    each = C.contribution_ranking(C.leaf_contributions(leaves, tables, shares), ["a"], 2)
    counted = leaves.groupBy("_t0", "_t1").count()
    got = C.contribution_ranking(C.leaf_contributions(counted, tables, shares), ["a"], 2, "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect()))
    assert each.where("class = 0").first().mean_abs == 0.183333
