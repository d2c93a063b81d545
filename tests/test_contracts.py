import pytest
from pyspark.sql import functions as F

from foldwise.operators import contracts as C
from foldwise.sources import files as S

SPECS = (C.ColumnSpec("id", "int"), C.ColumnSpec("alpha", "float", min_value=0.0, max_value=360.0),
         C.ColumnSpec("kind", "text", allowed=frozenset({"M", "A/F"})))


def frame(spark, rows=((1, 10.0, "M"), (2, 20.0, "A/F"), (3, 360.0, "M")), schema="id bigint, alpha double, kind string"):
    return spark.createDataFrame(list(rows), schema)


def checks(df):
    return {(r["check"], r["column_name"]) for r in C.violations(df, SPECS).collect()}


def test_valid_frame_passes(spark):
    assert checks(frame(spark)) == set()
    assert C.require(frame(spark), SPECS).count() == 3


def test_structure_negatives(spark):
    df = frame(spark)
    assert ("column_missing", "alpha") in checks(df.withColumnRenamed("alpha", "beta"))
    assert {("column_count", None), ("column_order", None)} <= checks(df.withColumn("extra", F.lit(1)))
    assert checks(df.select("alpha", "id", "kind")) == {("column_order", None)}
    assert ("column_type", "id") in checks(df.withColumn("id", F.col("id").cast("string")))


def test_value_negatives_reported_together(spark):
    df = frame(spark, [(1, -1.0, "M"), (2, 400.0, "Z"), (None, float("nan"), None)])
    got = {(r["check"], r["column_name"]): r for r in C.violations(df, SPECS).collect()}
    assert set(got) == {("null_share", "id"), ("null_share", "alpha"), ("null_share", "kind"), ("below_min", "alpha"), ("above_max", "alpha"), ("not_allowed", "kind")}
    assert got["above_max", "alpha"]["observed"] == 400.0 and got["not_allowed", "kind"]["detail"] == "Z"
    with pytest.raises(C.ContractError, match="6 contract violation"):
        C.require(df, SPECS)


def test_empty_frame_has_no_null_violation(spark):
    assert checks(frame(spark).where("false")) == set()


def test_unknown_split():
    with pytest.raises(KeyError):
        C.pick_contract({"train": SPECS}, "valid")


def test_chat_record_faults(spark):
    rows = [(1, [("user", "hi"), ("assistant", "yo")]), (2, []), (3, [("user", "hi")]), (4, [("assistant", "a")]), (5, [("user", " "), ("assistant", "x")])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role string, content string>>")
    got = dict(df.select("id", C.chat_record_faults(F.col("messages"))).collect())
    assert got == {1: "", 2: "empty", 3: "last_not_assistant,no_user_before", 4: "no_user_before", 5: "blank_content"}


def test_prediction_contract_raises(spark):
    truth = spark.createDataFrame([(1,), (2,)], "id int")
    good = spark.createDataFrame([(1, "A"), (2, "B")], "id int, label string")
    assert C.require_predictions(good, truth, "id", "label", ["A", "B"]) is good
    for bad in ([(1, "A")], [(1, "A"), (2, "B"), (2, "B")], [(1, "A"), (2, "C")], [(1, "A"), (2, None)], [(1, "A"), (3, "B")]):
        with pytest.raises(C.ContractError):
            C.require_predictions(spark.createDataFrame(bad, "id int, label string"), truth, "id", "label", ["A", "B"])


def test_csv_round_trip_and_missing(spark, tmp_path):
    S.write_csv(frame(spark), str(tmp_path / "c"))
    assert S.read_csv_contract(spark, str(tmp_path / "c"), SPECS).count() == 3
    with pytest.raises(FileNotFoundError):
        S.read_csv_contract(spark, str(tmp_path / "none"), SPECS)
    S.write_csv(frame(spark).withColumn("extra", F.lit(1)), str(tmp_path / "d"))
    with pytest.raises(C.ContractError, match="column_count"):
        S.read_csv_contract(spark, str(tmp_path / "d"), SPECS)


def test_jsonl_tripwire_and_discovery(spark, tmp_path):
    S.write_jsonl(spark.createDataFrame([(1, "é")], "id int, t string"), str(tmp_path / "j"))
    assert "é" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*"))
    with pytest.raises(C.ContractError):
        S.read_jsonl(spark, str(tmp_path / "j"), "id int, t string")
    assert S.read_jsonl(spark, str(tmp_path / "j"), "id int, t string", min_rows=1).count() == 1
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.jsonl").write_text("{}")
    with pytest.raises(FileNotFoundError):
        S.discover_one(spark, str(tmp_path), "x.jsonl")
    with pytest.raises(FileNotFoundError):
        S.discover_one(spark, str(tmp_path), "y.jsonl")
    assert S.discover_one(spark, str(tmp_path / "a"), "x.jsonl").endswith("a/x.jsonl")


def test_fingerprint_missing_marker_and_order(spark, tmp_path):
    import hashlib
    (tmp_path / "f").write_bytes(b"abc")
    rows = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in S.file_fingerprints(spark, [str(tmp_path / "f"), str(tmp_path / "g")]).collect()}
    assert rows == {"f": hashlib.sha256(b"abc").hexdigest(), "g": "missing"}
    df = spark.range(1000)
    assert S.table_fingerprint(df, ["id"]).first() == S.table_fingerprint(df.repartition(7).orderBy(F.desc("id")), ["id"]).first()


def test_materialise_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert S.materialise(spark, str(tmp_path / "m"), build).count() == S.materialise(spark, str(tmp_path / "m"), build).count() == 3
    assert calls == [1]


def test_materialise_rebuilds_an_unfinished_folder(spark, tmp_path):
    path = tmp_path / "half"
    spark.range(10).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert S.materialise(spark, str(path), lambda: spark.range(99)).count() == 99


def test_fingerprint_tells_where_a_cell_is_missing(spark):
    one = spark.createDataFrame([("a", None)], "x string, y string")
    other = spark.createDataFrame([(None, "a")], "x string, y string")
    assert S.table_fingerprint(one, ["x", "y"]).first() != S.table_fingerprint(other, ["x", "y"]).first()


def test_require_names_every_column(spark):
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(f"odd{k}" for _ in cols) for k in range(30)], ", ".join(f"{c} string" for c in cols))
    with pytest.raises(C.ContractError) as e:
        C.require(df, [C.ColumnSpec(c, "text", allowed=frozenset({"fine"})) for c in cols])
    assert all(c in str(e.value) for c in cols) and "29 more" in str(e.value)
