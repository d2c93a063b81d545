"""Algebraic identities, skew and partition invariance of the statistics."""

import math
from itertools import product

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.operators import assoc as A
from foldwise.operators import folds as H
from foldwise.operators import profile as P
from foldwise.operators import ranks as R

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def assoc(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "x string, y string")
    return A.association(A.joint_counts(df, ["x"], "y"), **kw).first()


def test_entropy_values(spark):
    labels = ["G"] * 6538 + ["Q"] * 2029 + ["S"] * 1433
    assert A.entropy(spark.createDataFrame([(x,) for x in labels], "y string"), "y").first()["h_nats"] == pytest.approx(0.8798, abs=2e-4)
    assert A.entropy(spark.createDataFrame([("a",), ("b",), ("c",)], "y string"), "y").first()["h_nats"] == pytest.approx(math.log(3), abs=1e-6)
    assert A.entropy(spark.createDataFrame([], "y string"), "y").first()["h_nats"] == 0.0


def test_independent_and_identical(spark):
    ind = assoc(spark, [p for p in product("abc", "xyz") for _ in range(50)])
    assert ind["mi"] == pytest.approx(0, abs=1e-9) and ind["cramers_v"] == 0.0
    same = assoc(spark, [(c, c) for c in "abc" for _ in range(100)])
    assert same["mi"] == pytest.approx(same["h_target"]) and same["cramers_v"] == pytest.approx(1.0, abs=1e-6)
    assert assoc(spark, [("a", c) for c in "xyz" for _ in range(5)])["cramers_v"] == 0.0


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), min_size=2, max_size=60))
def test_mi_is_bounded(spark, pairs):
    r = assoc(spark, pairs)
    assert -1e-12 <= r["mi"] <= r["h_target"] + 1e-9 and 0 <= r["cramers_v"] <= 1.0 + 1e-9


def test_duplicates_count_once_across_splits(spark):
    mk = lambda xs: spark.createDataFrame([(x,) for x in xs], "z double")
    assert tuple(P.duplicate_report(mk([0.5] * 3 + [0.6] * 2 + [0.7]), mk([0.9]), ["z"]).first()) == (3, 2, 0)
    assert tuple(P.duplicate_report(mk([0.5] * 3), mk([0.5]), ["z"]).first()) == (2, 1, 1)


def test_quantiles_with_hot_value_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(4000, 5.0), rng.normal(size=6000) * 100])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for parts in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        q = R.quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
        assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.95])))
        t = R.quantile_table(df, ["v"], [i / 16 for i in range(1, 16)])["v"]
        assert t == pytest.approx(list(np.quantile(v, [i / 16 for i in range(1, 16)])))
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_many_cuts_use_the_two_level_search(spark):
    cuts = [float(i) for i in range(0, 1000, 3)]
    df = spark.range(-2, 1005).select(F.col("id").cast("double").alias("x"))
    for strict in (False, True):
        got = df.select("x", R.bucket_of(F.col("x"), cuts, strict).alias("b")).collect()
        assert all(r["b"] == sum((c < r["x"]) if strict else (c <= r["x"]) for c in cuts) for r in got)
        small = df.select("x", R.bucket_of(F.col("x"), cuts[:50], strict).alias("b")).collect()
        assert all(r["b"] == sum((c < r["x"]) if strict else (c <= r["x"]) for c in cuts[:50]) for r in small)


def test_average_ranks_and_auc(spark):
    x = [1, 1, 2, 3, 3, 3]
    got = {r["x"]: r["avg_rank"] for r in R.value_ranks(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int")
    assert A.roc_auc(df, "s", F.col("y") == 1).first()["auc"] == pytest.approx(0.875)


def test_constant_column_correlation_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r["x"], r["y"]): r["r"] for r in A.pearson_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] == 1.0


def test_folds_are_balanced_whatever_the_skew(spark):
    df = spark.range(5000).withColumn("y", F.when(F.col("id") % 50 == 0, "rare").otherwise("hot"))
    ref = None
    for parts in (1, 4, 17):
        f = H.stratified_folds(df.repartition(parts), ["id"], "y", 5)
        rows = {r["id"]: r["fold"] for r in f.collect()}
        ref = ref or rows
        assert rows == ref and len(rows) == 5000
    sizes = H.stratified_folds(df, ["id"], "y", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in sizes if r["y"] == "rare"} == {20} and {r["count"] for r in sizes if r["y"] == "hot"} == {980}
    H.require_folds(H.stratified_folds(df, ["id"], "y", 5), ["id"], "y", k=5)


def test_fold_gate_negatives(spark):
    df = H.stratified_folds(spark.range(100).withColumn("y", F.col("id") % 2), ["id"], "y", 5)
    for bad in (df.withColumn("fold", F.when(F.col("id") > 2, F.col("fold"))), df.unionByName(df.limit(1)),
                df.withColumn("fold", F.when(F.col("y") == 1, 0).otherwise(F.col("fold")))):
        with pytest.raises(ValueError):
            H.require_folds(bad, ["id"], "y")


@SLOW
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40))
def test_class_weights_mean_one(spark, ys):
    w = H.class_weights(spark.createDataFrame([(y,) for y in ys], "y string"), "y").collect()
    assert sum(r["n"] * r["weight"] for r in w) / len(ys) == pytest.approx(1.0)
    for a in w:
        for b in w:
            assert a["weight"] / b["weight"] == pytest.approx(b["n"] / a["n"])


def test_empty_weights_are_empty(spark):
    assert H.class_weights(spark.createDataFrame([], "y string"), "y").count() == 0


def test_normality_keeps_short_features(spark):
    rows = P.normality(spark.createDataFrame([(float(i), None) for i in range(7)], "v double, w double"), ["v"]).collect()
    assert [(r.feature, r.n, r.k2, r.p_value) for r in rows] == [("v", 7, None, None)]


def test_missing_and_nan_have_no_bin(spark):
    from foldwise.operators.assoc import equal_width_bin
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,), (float("nan"),)], "v double")
    assert sorted(r.bin for r in equal_width_bin(df, "v", 2).collect() if r.bin is not None) == [0, 0, 1]
    h = {r["bin"]: r["n"] for r in P.histogram(df, "v", 2).collect()}
    assert h == {0: 1, 1: 2}


def test_yates_counts_beyond_nine_digits(spark):
    from foldwise.operators.assoc import association
    n = 4_000_000_000
    joint = spark.createDataFrame([("f", str(a), b, n + 5 * (a == b)) for a in (0, 1) for b in (0, 1)], "feature string, value string, _y int, n long")
    assert association(joint, yates=True).first()["n"] == 4 * n + 10


def test_importances_must_match_their_names(spark):
    from foldwise.operators.evaluate import mean_importances
    with pytest.raises(ValueError):
        mean_importances(spark, {0: [0.5, 0.25, 0.25]}, ["a", "b"])


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {tuple(r) for r in P.keep_first(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 2, "z")}
