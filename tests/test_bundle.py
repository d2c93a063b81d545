"""Fit, save, load and apply; the triage build; digests of large files."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import bundle as U
from foldwise.operators import features as X
from foldwise.sources import files as S


@pytest.fixture(scope="module")
def triage(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        row = {"patient_id": f"p{i}", "site_id": f"s{r.integers(5)}", "triage_nurse_id": f"n{r.integers(9)}", "disposition": "home", "ed_los_hours": 2.5,
               "chief_complaint_raw": ["Severe chest pain", "sudden fall, worsening", None][i % 3], "chief_complaint_system": ["cardiac", "trauma", "unknown"][i % 3]}
        for c, codes in X.ORDINAL_MAPS.items():
            row[c] = list(codes)[int(r.integers(len(codes)))] if i % 17 else None
        for c in X.FREQUENCY_COLUMNS:
            row[c] = f"v{r.integers(3)}" if i % 11 else None
        for c in X.IMPUTED_VITALS:
            row[c] = float(np.round(r.normal(90, 20), 1)) if r.random() < 0.8 else None
        for c in ("heart_rate", "spo2", "age", "gcs_total", "news2_score", "pain_score", "num_comorbidities", "num_prior_ed_visits_12m", "num_prior_admissions_12m", "num_active_medications"):
            row[c] = float(r.integers(0, 15))
        for c in X.HISTORY_COLUMNS:
            row[c] = int(r.integers(2))
        rows.append(row)
    names = sorted(rows[0])
    kind = lambda c: "string" if isinstance(next(x[c] for x in rows if x[c] is not None), str) else "int" if c in X.HISTORY_COLUMNS else "double"
    return spark.createDataFrame([tuple(x[c] for c in names) for x in rows], ", ".join(f"{c} {kind(c)}" for c in names)), rows


def test_triage_build_equals_plain_python(spark, triage, tmp_path):
    df, rows = triage
    train, test = rows[:200], rows[200:]
    side = F.expr("cast(substring(patient_id, 2) as int) < 200")
    U.fit(df.where(side), U.TRIAGE).save(str(tmp_path / "bundle"))
    b = U.load(spark, str(tmp_path / "bundle"))
    assert b.n_rows == 200 and b.plan == U.TRIAGE and b.columns["site_id"] == "string"
    got = {}
    out = b.apply(df.where(~side))
    for r in out.collect():
        got[r.patient_id] = r
    assert len(got) == 100
    for c in X.IMPUTED_VITALS:
        groups = {}
        for x in train:
            if x[c] is not None and x["age_group"] and x["mental_status_triage"]:
                groups.setdefault((x["age_group"], x["mental_status_triage"]), []).append(x[c])
        med = {k: float(np.median(v)) for k, v in groups.items()}
        rest = float(np.median([v for x in train if (v := x[c] if x[c] is not None else med.get((x["age_group"], x["mental_status_triage"]))) is not None]))
        for x in test:
            want = x[c] if x[c] is not None else med.get((x["age_group"], x["mental_status_triage"]), rest)
            assert got[x["patient_id"]][c] == pytest.approx(want)
    for c in X.CODE_COLUMNS:
        codes = {v: i for i, v in enumerate(sorted({x[c] for x in train}))}
        assert all(got[x["patient_id"]][f"{c}_code"] == codes.get(x[c], -1) for x in test)
    for c in X.FREQUENCY_COLUMNS:
        seen = [x[c] for x in train if x[c] is not None]
        assert all(got[x["patient_id"]][f"{c}_share"] == pytest.approx(seen.count(x[c]) / len(seen) if x[c] else 0.0) for x in test)
    for c, codes in X.ORDINAL_MAPS.items():
        assert all(got[x["patient_id"]][f"{c}_ord"] == codes.get(x[c], -1) for x in test)
    assert all(got[x["patient_id"]]["bp_missing"] == int(x["systolic_bp"] is None) for x in test)
    full = U.triage_frame(df.where(~side), b)
    assert not set(full.columns) & {*X.IDENTIFIER_COLUMNS, *X.OUTCOME_COLUMNS} and {"cv_risk_x_shock", "n_risk_words", "n_temporal_words", "complaint_system_ord"} <= set(full.columns)
    assert full.count() == 100 and full.where("n_risk_words >= 2").count() > 0


def test_a_split_must_have_the_fitted_columns(spark, triage):
    df, _ = triage
    b = U.fit(df, U.Plan(codes=["site_id"], missing={"m": "spo2"}))
    with pytest.raises(U.SchemaMismatch, match="site_id: absent"):
        b.apply(df.drop("site_id"))
    with pytest.raises(U.SchemaMismatch, match="spo2: string"):
        b.apply(df.withColumn("spo2", F.col("spo2").cast("string")))
    with pytest.raises(U.SchemaMismatch):
        U.fit(df, U.Plan(codes=["nothing"]))


def test_empty_and_missing(spark):
    df = spark.createDataFrame([], "a double, g string")
    b = U.fit(df, U.Plan(medians={"a": ["g"]}, codes=["g"], shares=["g"]))
    one = spark.createDataFrame([(None, "x"), (2.0, None)], "a double, g string")
    assert sorted(map(tuple, b.apply(one).collect()), key=str) == sorted([(None, "x", -1, 0.0), (2.0, None, -1, 0.0)], key=str)


def test_large_files_are_digested_as_streams(spark, tmp_path):
    big = np.random.default_rng(0).integers(0, 256, 5_000_001, dtype=np.uint8).tobytes()
    (tmp_path / "big.bin").write_bytes(big)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.sha256, r.length) for r in S.file_fingerprints(spark, [str(tmp_path / "big.bin"), str(tmp_path / "empty.bin"), str(tmp_path / "none")], read=1 << 16).collect()}
    assert got == {"big.bin": (hashlib.sha256(big).hexdigest(), 5_000_001), "empty.bin": (hashlib.sha256(b"").hexdigest(), 0), "none": ("missing", None)}
    assert {r.sha256 for r in S.file_fingerprints(spark, [str(tmp_path)]).collect()} == {v for v, _ in got.values() if v != "missing"}
