"""Models whose fit is a sum: fold models, subsets, rungs, permutations and counts against plain numpy; the fold queries against DuckDB."""

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from foldwise.operators import evaluate as E
from foldwise.operators import sufficient as S
from foldwise.plans import load

SF = "/root/testdata/sf0.001"
FAMILY = ["oof_least_squares", "oof_bayes", "fold_average_test", "refit_score", "grid_search", "search_reevaluation", "ablation", "fold_importance", "feature_pruning",
          "permutation_importance", "stacking", "seed_average", "adversarial_auc", "shift_decision"]
COLUMNS = [S.Scaled("a", -3, 3), S.Scaled("b", 0, 1), S.Indicator("c", "x")]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    out = []
    for i in range(400):
        y = int(r.integers(3))
        a = float(np.round(r.normal(y - 1, 0.6), 3))
        out.append((i, y, a if i % 29 else None, float(np.round(r.random(), 3)), "x" if (y == 2) ^ (r.random() < 0.2) else ("y" if i % 7 else None), i % 4))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c string, fold int").repartition(5)


def matrix(rows):
    return np.array([[1.0, 0.5 if a is None else (a + 3) / 6, b, float(c == "x")] for _, _, a, b, c, _ in rows])


def fitted(x, y, ridge, use):
    use = np.array([True, *use])
    w = np.array([1 / (3 * np.sum(y == c)) for c in y])
    x = x * use
    a = x.T @ (x * w[:, None]) + np.diag([0.0] + [ridge if u else 1.0 for u in use[1:]])
    return np.linalg.solve(a, np.stack([x.T @ (w * (y == c)) for c in range(3)], axis=1))


@pytest.mark.parametrize("name", FAMILY)
def test_query(spark, name):
    queries, sql = load()
    assert oracle.compare(queries[name](spark, SF), oracle.connect(SF), sql[name]) is None


def test_fold_models_are_the_total_less_the_fold(df, rows):
    x, y, fold = matrix(rows), np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
    got = S.least_squares(S.cross_products(df, COLUMNS, "y"), [S.setting("all", COLUMNS), S.setting("two", COLUMNS, ["a", "c"], 0.5)], 3, range(4))
    for name, ridge, use in (("all", S.RIDGE, (True,) * 3), ("two", 0.5, (True, False, True))):
        for f in range(4):
            assert np.allclose(got[name][f], fitted(x[fold != f], y[fold != f], ridge, use), atol=1e-9)
        assert np.allclose(got[name][S.ALL], fitted(x, y, ridge, use), atol=1e-9)
    oof = {r.id: r.probability for r in S.linear_out_of_fold(df, COLUMNS, "y", 3, 4).collect()}
    for i, r in enumerate(rows):
        assert np.allclose(oof[r[0]], x[i] @ got["all"][r[5]], atol=1e-8)


def balanced(y, p):
    return float(np.mean([np.mean(p[y == c] == c) for c in sorted(set(y))]))


def test_ablation_equals_separate_fits(df, rows):
    x, y, fold = matrix(rows), np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
    configs = {"baseline": ["a", "b", "c"], "weak": ["b"], "one": ["a"]}
    got = {r.config: r for r in S.linear_ablation(df, COLUMNS, "y", 3, 4, configs).collect()}
    for name, use in configs.items():
        mask = [c.name in use for c in COLUMNS]
        scores = [balanced(y[fold == f], np.argmax(np.round(x[fold == f] @ fitted(x[fold != f], y[fold != f], S.RIDGE, mask), 9), axis=1)) for f in range(4)]
        assert got[name].mean == pytest.approx(np.mean(scores), abs=1e-6) and got[name].std == pytest.approx(np.std(scores), abs=1e-6)
    assert got["weak"].diff_mean < 0 and not got["weak"].defensible and got["baseline"].diff_mean is None
    with pytest.raises(KeyError):
        S.linear_ablation(df, COLUMNS, "y", 3, 4, {"x": ["a"]})


def test_search_finds_the_planted_draw_and_prunes(df):
    planted = S.setting("2", COLUMNS, ridge=1e-3)
    draws = [S.setting("0", COLUMNS, ["b"], 1.0), S.setting("1", COLUMNS, ["c"], 5.0), planted, S.setting("3", COLUMNS, ["a"]), S.setting("4", COLUMNS, ["b"], 1e-2)]
    trials = S.pruned_search(df, COLUMNS, "y", 3, 4, draws)
    assert S.best_trial(trials) == 2 and trials[2]["folds"] == 4 and trials[2]["reason"] == "completed"
    assert any(t["reason"] == "pruned" and t["folds"] < 4 for t in trials) and all(len(t["scores"]) == t["folds"] for t in trials)
    row = S.re_evaluated(df, COLUMNS, "y", 3, 4, planted, S.setting("d", COLUMNS, ["b"])).first()
    assert row.best_mean > row.default_mean and row.diff_mean == pytest.approx(row.best_mean - row.default_mean, abs=2e-6) and row.n_folds == 4


def test_permutation_takes_all_columns_in_one_pass(df, rows):
    columns = COLUMNS[:2]
    models = S.least_squares(S.cross_products(df, columns, "y"), [S.setting("all", columns)], 3, [])["all"]
    got = {r.feature: r for r in S.permutation_drops(df, ["id"], "y", columns, lambda cs: S.linear_scores(cs, models, None)).collect()}
    assert set(got) == {"a", "b"} and got["a"].base == got["b"].base
    assert got["a"].drop > 0.2 and abs(got["b"].drop) < 0.05


def test_counts_bayes_and_gains(df, rows):
    specs = [S.Bins("a", -3, 3, 6), S.Values("c", ("x", "y"))]
    counts = S.bin_counts(df, specs, "y")
    place = lambda r: (6 if r[2] is None else int(min(5, max(0, np.floor((r[2] + 3) / 6 * 6)))), {"x": 0, "y": 1}.get(r[4], 2))
    for f in (0, 3, S.ALL):
        side = [r for r in rows if r[5] != f]
        tables = [np.zeros((7, 3)), np.zeros((3, 3))]
        for r in side:
            for t, b in zip(tables, place(r)):
                t[b, r[1]] += 1
        for got, t in zip(S.bayes(counts, specs, 3, range(4))[f], tables):
            assert np.allclose(got, np.log((t + 1) / (t.sum(axis=0) + len(t))))
    gains = S.split_gains(counts, specs, 3, range(4))
    assert len(gains) == 8 and all(g >= 0 for *_, g in gains)
    oof = S.bayes_out_of_fold(df, specs, "y", 3, 4)
    assert all(abs(sum(r.probability) - 1) < 1e-6 for r in oof.collect())
    assert E.oof_scores(oof, "y").agg(F.avg("score")).first()[0] > 0.7


def test_odd_rows(spark, df):
    odd = spark.createDataFrame([(1000, None, 1.0, 0.5, "x", 0), (1001, 1, None, None, None, None), (1002, 2, 1e9, -5.0, "new", 3)], df.schema)
    both = df.union(odd)
    got = {r.id: r for r in S.linear_out_of_fold(both, COLUMNS, "y", 3, 4).collect()}
    assert len(got) == 403 and got[1001].probability == [None] * 3 and got[1000].probability[0] is not None
    empty = S.linear_out_of_fold(df.limit(0), COLUMNS, "y", 3, 4) if S.cross_products(df.limit(0), COLUMNS, "y") else None
    assert empty is None


def test_forest_importances_are_summed_by_column(spark, df):
    kept: dict = {}
    train = df.where("a IS NOT NULL").withColumn("y", F.col("y").cast("double"))
    E.forest(["a", "b"], "y", ["c"], trees=5, depth=3, weight=None, keep=kept)(train)
    table = {r.feature: r.importance for r in E.mean_importances(spark, kept, ["a", "b", "c"]).collect()}
    assert table["a"] > table["c"] > table["b"] and sum(table.values()) == pytest.approx(1, abs=1e-5)


def test_logistic_out_of_fold_equals_separate_fits(df):
    train = df.where("a IS NOT NULL").withColumn("y", F.col("y").cast("double")).persist()
    model = E.logistic(["a", "b"], "y", max_iter=20)
    oof, test = E.out_of_fold(train, ["id"], "y", 4, model, test=train.where("fold = 0"), n_classes=3)
    assert oof.count() == train.count() == oof.select("id").distinct().count()
    from foldwise.operators.folds import class_weights, with_weights
    parts = []
    for f in range(4):
        side = train.where(F.col("fold") != f)
        score = model(with_weights(side, class_weights(side, "y"), "y"))
        parts.append({r.id: r.probability for r in score(train.where("fold = 0")).select("id", "probability").collect()})
    got = {r.id: r.probability for r in test.collect()}
    for k, p in got.items():
        assert np.allclose(p, np.mean([q[k] for q in parts], axis=0), atol=1e-6)
    own = {r.id: r.probability for r in oof.where("fold = 0").collect()}
    assert all(np.allclose(own[k], parts[0][k], atol=1e-6) for k in own)
    trials = E.grid_search(train, ["a", "b"], "y", "fold", 4, [{"regParam": 1e-3}, {"regParam": 50.0}], max_iter=10).collect()
    assert trials[0].trial == 0 and trials[0].score >= trials[1].score


def test_log_scores_stand_once_in_a_softmax(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.0],)], "s array<double>")
    out = d.select(S.softmax(F.transform("s", lambda x: F.hypot(x, F.lit(0.0)))).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("hypot") == 1
    assert [round(x, 4) for x in out.first()["p"]] == [0.09, 0.2447, 0.6652]


def test_rows_are_placed_once_and_counted_by_code(spark, monkeypatch):
    from foldwise.operators import folds
    from foldwise.plans import models
    made = []
    monkeypatch.setattr(folds, "order_key", lambda key, seed, f=folds.order_key: made.append(seed) or f(key, seed))
    df = spark.range(500).selectExpr("id", "id % 3 AS y", "id * 2 AS v", "'x' AS wide")
    plain = {(x.v, x.fold) for x in folds.stratified_folds(df, ["id"], "y", 3).collect()}
    narrow = folds.stratified_folds(df, ["id"], "y", 3, carry=["v"])
    assert narrow.columns == ["y", "v", "fold"] and {(x.v, x.fold) for x in narrow.collect()} == plain
    assert "InMemoryTableScan" in narrow._jdf.queryExecution().executedPlan().toString() and len(made) == 2
    sf = "/root/testdata/sf0.001"
    cells, specs = models.folded_cells(spark, sf)
    rows = models.folded_rows(spark, sf, [*models.FEATURES, "l_linestatus"])
    assert models.S.bin_counts(cells, specs, "y", n="n") == models.S.bin_counts(rows, models.BINNED, "y")
    assert cells.agg({"n": "sum"}).first()[0] == rows.count()


# ---- folds of several seeds side by side ---------------------------------------------------

def lineitem(spark, path, times):
    """A table folder with the lines of sf0.001 repeated under other order keys."""
    copies = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    copies.withColumn("l_orderkey", F.col("l_orderkey") + F.col("_i") * 1_000_000).drop("_i").coalesce(2).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_seed_average_keeps_counts_and_no_rows(spark, tmp_path):
    from foldwise.operators import lookup
    path = lineitem(spark, tmp_path, 30)
    lookup.release()
    got = load()[0]["seed_average"](spark, path).first()
    n = spark.read.parquet(f"{path}/lineitem.parquet").count()
    assert got.n == n and sum(d.count() for d in lookup._KEPT) < n / 2


def test_seed_average_pairs_rows_that_share_a_key(spark, tmp_path):
    import duckdb
    duckdb.execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber,
      CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice)
      FROM '{SF}/lineitem.parquet', range(3) r(i) WHERE i = 0 OR l_orderkey % 5 = 0) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    queries, sql = load()
    assert oracle.compare(queries["seed_average"](spark, str(tmp_path)), con, sql["seed_average"]) is None


def test_seed_counts_have_the_folds_of_each_seed(spark):
    from foldwise.operators.folds import seed_counts, stratified_folds
    d = spark.range(3000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    alone = seed_counts(d, ["id"], "y", 4, (3, 4, 9), ["id"])
    assert alone.where("twin IS NOT NULL").count() == 0
    for s in (3, 4, 9):
        want = {(r.id, r.fold) for r in stratified_folds(d, ["id"], "y", 4, seed=s).collect()}
        assert {(r.id, r[f"fold_{s}"]) for r in alone.collect()} == want
    twice = seed_counts(d.unionAll(d.where("id < 10")), ["id"], "y", 4, (3, 4), ["id"]).collect()
    assert {r.id for r in twice if r.twin is not None} == set(range(10)) and len({bytes(r.twin) for r in twice if r.twin is not None}) == 10
    assert sum(r.n for r in twice) == 3010 and {len(r.twin) for r in twice if r.twin is not None} == {16}
