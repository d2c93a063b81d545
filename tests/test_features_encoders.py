import math

import pytest
from pyspark.sql import functions as F

from foldwise.operators import encode as D
from foldwise.operators import features as X
from foldwise.operators.lookup import NotUniqueError, attach, left_chain


def sky(spark):
    return spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, z) for z in (-0.005, 0.0, 1.5, 0.3)], "u double, g double, r double, i double, z double, redshift double")


def test_differences_and_log(spark):
    df = X.add_engineered(sky(spark), ["redshift_log", "u_g"])
    assert df.columns[-2:] == ["u_g", "redshift_log"]
    rows = df.collect()
    assert {r["u_g"] for r in rows} == {-1.0}
    assert rows[0]["redshift_log"] == pytest.approx(math.log1p(0.005))
    again = X.add_engineered(df, ["u_g", "redshift_log"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    with pytest.raises(KeyError):
        X.add_differences(sky(spark), only=["nope"])
    with pytest.raises(KeyError):
        X.add_differences(sky(spark).drop("u"))
    with pytest.raises(KeyError):
        X.model_frame(sky(spark), ["u"], drop=["nope"])
    with pytest.raises(Exception, match="below the floor"):
        X.add_log(sky(spark).withColumn("redshift", F.lit(-1.0)), "redshift").collect()


def patient(**kw):
    base = dict(age=70, systolic_bp=85.0, heart_rate=120.0, respiratory_rate=0.5, temperature_c=None, spo2=87.0, gcs_total=8, news2_score=12, pain_score=5.0,
                pulse_pressure=30.0, mean_arterial_pressure=60.0, shock_index=1.2, num_comorbidities=3, num_prior_ed_visits_12m=2)
    base.update({c: 0 for c in X.HISTORY_COLUMNS})
    base.update(kw)
    return base


def test_clinical_block(spark):
    df = spark.createDataFrame([patient(hx_asthma=1, hx_hypertension=1)], ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in patient().items()))
    r = X.clinical_features(df).first()
    assert (r["elderly"], r["hypotensive"], r["febrile"], r["gcs_severe"], r["gcs_mild"], r["news2_critical"], r["pain_moderate"]) == (1, 1, 0, 1, 0, 1, 1)
    assert r["hr_rr_ratio"] == 120.0 and r["map_deficit"] == 5.0 and r["critical_flag"] == 1
    assert r["n_abnormal_vitals"] == 3 and r["resp_risk_score"] == 1 and r["total_hx_count"] == 2 and r["cv_risk_x_shock"] == pytest.approx(1.2)
    assert r["elderly_high_news2"] == 1 and r["comorbid_x_news2"] == 36


def test_text_and_keywords(spark):
    df = spark.createDataFrame([("Severe  CHEST pain, acute",), (None,), ("",)], "t string")
    a = X.keyword_flags(X.text_counts(df, "t", "cc"), "t", X.RISK_KEYWORDS, "cc_has_", "n").collect()
    assert [(r["cc_word_count"], r["cc_char_count"], r["n"]) for r in a] == [(4, 25, 3), (0, 0, 0), (0, 0, 0)]
    assert a[0]["cc_has_chest_pain"] == 1 and len([c for c in a[0].asDict() if c.startswith("cc_has_")]) == 20


def test_ordinal_map_defaults(spark):
    df = spark.createDataFrame([("walk-in",), ("rocket",), (None,)], "m string")
    assert [r[0] for r in df.select(X.ordinal_code(F.col("m"), X.ORDINAL_MAPS["arrival_mode"])).collect()] == [0, -1, -1]
    assert [r[0] for r in df.select(X.ordinal_code(F.col("m"), X.COMPLAINT_SYSTEMS, 13)).collect()] == [13, 13, 13]


def test_drop_leaky_keeps_unknown(spark):
    df = spark.createDataFrame([("p", "d", 1.0)], "patient_id string, disposition string, x double")
    assert X.drop_leaky(df).columns == ["x"] and X.drop_leaky(df, train=False).columns == ["disposition", "x"]


def test_group_median_falls_back(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None), (None, 100.0)]
    out = D.impute_group_median(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()
    assert sorted((r["g"] or "", r["v"]) for r in out) == [("", 2.5), ("", 100.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.5)]


def test_codes_and_frequencies_handle_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("é",), ("a",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("b",), ("é",), ("z",), (None,)], "c string")
    got = D.apply_codes(new, D.category_codes(fit, "c"), "c", "k").collect()
    assert {r["c"]: r["k"] for r in got} == {"a": 0, "b": 1, "é": 2, "z": -1, None: -1}
    f = D.apply_frequencies(new, D.frequencies(fit, "c"), "c", "f").collect()
    assert {r["c"]: r["f"] for r in f} == {"a": 0.5, "b": 0.25, "é": 0.25, "z": 0.0, None: 0.0}


def test_target_encoding_ignores_own_fold(spark):
    rows = [(i, "hot" if i % 3 else "cold", i % 4, float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, c string, fold int, t double")
    enc = lambda d: {r["id"]: r["e"] for r in D.target_encode_oof(d, ["c"], {"e": F.col("t")}, 4).where("fold = 0").collect()}
    assert enc(df) == enc(df.withColumn("t", F.when(F.col("fold") == 0, 99.0).otherwise(F.col("t"))))
    one = D.target_encode_oof(df, ["c"], {"e": F.col("t")}, 4).where("id = 1").first()["e"]
    others = [r for r in rows if r[2] != 1]
    prior = sum(r[3] for r in others) / len(others)
    mine = [r[3] for r in others if r[1] == "hot"]
    assert one == pytest.approx((sum(mine) + 10 * prior) / (len(mine) + 10))


def test_standardise_constant_column(spark):
    out = D.standardise(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted((r["a_z"], r["b_z"]) for r in out) == [(-1.0, 0.0), (1.0, 0.0)]


def test_lookup_limits_and_uniqueness(spark):
    big, small = spark.range(100).withColumn("k", F.col("id") % 10), spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for limit in (5, 100):
        assert attach(big, small, ["k"], limit=limit).agg(F.sum("v")).first()[0] == 900
    with pytest.raises(NotUniqueError):
        left_chain(big, small.unionByName(small), on=["k"])
