"""Selection of order statistics against numpy."""

import math

import numpy as np
import pytest

from foldwise.operators import ranks as R
from foldwise.operators import select as S

PROBS = {"lo": 0.0, "a": 0.05, "b": 0.5, "c": 0.77, "hi": 1.0}


def check(spark, groups, monkeypatch=None, read_out=50):
    if monkeypatch:
        monkeypatch.setattr(S, "READ_OUT", read_out)
        monkeypatch.setattr(S, "PARTS", 64)
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = S.order_statistics(df, "v", PROBS, ["g"])
    assert set(found) == {(g,) for g in groups}
    for g, xs in groups.items():
        n, cells = found[(g,)]
        assert n == len(xs)
        with np.errstate(invalid="ignore"):
            want = np.quantile(np.array(xs, float), list(PROBS.values()))
        for p, w in zip(PROBS, want):
            assert cells[p] == w or cells[p] == pytest.approx(w, rel=1e-12) or math.isnan(w), (g, p)


def test_shapes_of_data(spark, monkeypatch):
    r = np.random.default_rng(1)
    check(spark, {
        "normal": r.normal(size=3000), "hot": np.concatenate([np.full(2000, 7.25), r.random(1000) * 10]), "one": [3.0], "two": [1.0, 2.0], "constant": [5.5] * 700,
        "scales": 10.0 ** r.uniform(-300, 300, 2000), "outlier": np.concatenate([r.random(1500), [1e308, -1e308]]), "near": 1.0 + np.arange(900) * 2.3e-16,
        "signs": np.concatenate([-(10.0 ** r.uniform(-9, 9, 400)), [0.0] * 100, 10.0 ** r.uniform(-9, 9, 400)]), "steps": r.integers(0, 4, 2500)}, monkeypatch)


def test_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (2.0,), (None,), (float("nan"),), (3.0,)], "v double")
    n, cells = S.order_statistics(df, "v", {"a": 0.0, "b": 0.5, "c": 1.0})[()]
    assert n == 5 and cells == {"a": -math.inf, "b": 2.0, "c": math.inf}
    only = spark.createDataFrame([(math.inf,)] * 3, "v double")
    assert S.order_statistics(only, "v", {"b": 0.5})[()] == (3, {"b": math.inf})
    mixed = spark.createDataFrame([(math.inf,), (-math.inf,)], "v double")
    assert S.order_statistics(mixed, "v", {"a": 0.0, "c": 1.0})[()] == (2, {"a": -math.inf, "c": math.inf})
    for rows in ([], [(None,)]):
        assert R.quantile_cells(spark.createDataFrame(rows, "v double"), "v", [0.5]) == []


def test_many_groups_are_ranked_instead(spark, monkeypatch):
    df = spark.createDataFrame([(i % 40, float(i * 7919 % 1000)) for i in range(2000)], "g int, v double")
    want = {r.g: (r.n_values, r.m) for r in R.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    monkeypatch.setattr(S, "GROUPS", 10)
    assert S.order_statistics(df, "v", {"m": 0.5}, ["g"]) is None
    got = {r.g: (r.n_values, r.m) for r in R.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == want and len(got) == 40


def test_missing_groups_and_types(spark):
    df = spark.createDataFrame([(None, 1.0), ("x", 2.0), ("x", 4.0), ("y", None)], "`a b` string, v double")
    rows = R.quantiles(df, "v", {"m": 0.5}, ["a b"]).collect()
    assert [tuple(r) for r in rows] == [("x", 2, 3.0)]


def test_a_round_shuffles_parts_not_values(spark):
    """The counted table of a round has as many rows for a million different values as for a thousand."""
    sizes = []
    for n in (2_000, 200_000):
        rows = spark.range(n).selectExpr("cast(id * 1.5 as double) AS _v")
        b = S.Bracket((), 0.0, 1.5 * (n - 1), 0, n, {n // 2})
        counted = S._attached(rows, [b], [], True).groupBy(S._part(S.F.col("_v"), 256)).count()
        sizes.append(counted.count())
    assert sizes == [256, 256]
