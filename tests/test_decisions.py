import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import blend as B
from foldwise.operators import evaluate as E
from foldwise.operators import folds as H
from foldwise.operators import metrics as M

NAMES = ["w0", "w1", "w2"]


def oof(spark, seed=0, n=120, corrupt=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y, fold = i % 3, (i // 3) % 3
        ps = []
        for m in range(3):
            p = rng.dirichlet([1, 1, 1]) + np.eye(3)[y] * (0.2 + 0.3 * m)
            if corrupt == fold:
                p = p[::-1]
            ps += list(map(float, p / p.sum()))
        rows.append((i, fold, y, *ps))
    cols = ", ".join(f"p{m}_{c} double" for m in range(3) for c in range(3))
    return spark.createDataFrame(rows, f"id int, fold int, y int, {cols}"), rows


MATS = [[f"p{m}_{c}" for c in range(3)] for m in range(3)]


def brute(rows, inner, w):
    hit = {}
    for r in rows:
        if r[1] in inner:
            p = sum(w[m] * np.array(r[3 + 3 * m:6 + 3 * m]) for m in range(3))
            hit.setdefault(r[2], []).append(int(np.argmax(p / p.sum())) == r[2])
    return np.mean([np.mean(v) for v in hit.values()])


def test_simplex_has_equal_weights():
    g = B.simplex(3)
    assert len(g) == 91 and (4, 4, 4) in g and all(sum(v) == 12 for v in g)


def test_nested_selection_matches_brute_force_and_ignores_the_held_out_fold(spark):
    df, rows = oof(spark)
    grid = [tuple(v / 12 for v in c) for c in B.simplex(3)]
    got = {r["fold"]: r for r in B.nested_selection(B.blend_counts(df, MATS, "y"), NAMES, "y", 1 / 3, 3).collect()}
    for k in range(3):
        inner = [f for f in range(3) if f != k]
        best = max(brute(rows, inner, w) for w in grid)
        chosen = tuple(got[k][n] for n in NAMES)
        assert brute(rows, inner, chosen) == pytest.approx(best) and got[k]["inner_score"] == pytest.approx(best)
        assert got[k]["score"] == pytest.approx(brute(rows, [k], chosen))
    bad, _ = oof(spark, corrupt=1)
    again = {r["fold"]: tuple(r[n] for n in NAMES) for r in B.nested_selection(B.blend_counts(bad, MATS, "y"), NAMES, "y", 1 / 3, 3).collect()}
    assert again[1] == tuple(got[1][n] for n in NAMES)


def test_flat_objective_gives_equal_weights(spark):
    rows = [(i, i % 2, i % 3, *([1.0 if c == i % 3 else 0.0 for c in range(3)] * 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, fold int, y int, " + ", ".join(f"{c} double" for m in MATS for c in m))
    b = B.best_candidate(B.surface(B.blend_counts(df, MATS, "y"), NAMES, "y"), NAMES, 1 / 3).first()
    assert [b[n] for n in NAMES] == pytest.approx([1 / 3] * 3)


def test_blend_arithmetic_and_errors(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5], [0.6, 0.2, 0.2])], "a array<double>, b array<double>")
    r = B.soft_blend(df, ["a", "b"]).withColumn("l", B.decode_label(F.col("p_blend"), ["x", "y", "z"])).first()
    assert r["p_blend"] == pytest.approx([0.4, 0.25, 0.35]) and r["l"] == "x"
    for w in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            B.soft_blend(df, ["a", "b"], w)
    with pytest.raises(ValueError):
        B.blend_columns([])


def test_ordinal_thresholds_never_lose_to_argmax(spark):
    rng = np.random.default_rng(1)
    rows = [(int(y), *map(float, rng.dirichlet(np.ones(5) + 3 * np.eye(5)[y] + np.eye(5)[min(y + 1, 4)]))) for y in rng.integers(0, 5, 300)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"q{i} double" for i in range(5)))
    q = [F.col(f"q{i}") for i in range(5)]
    t = B.ordinal_thresholds(df, B.expected_value(q), B.ordinal_decode(q, []), F.col("y"), 5).first()
    ts = [t[f"t{i}"] for i in range(1, 5)]
    direct = M.qwk(df.withColumn("p", B.ordinal_decode(q, ts)), "y", "p").first()["qwk"]
    assert direct == pytest.approx(t["qwk"], abs=2e-3) and ts == sorted(ts)


def test_qwk_and_recall(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 0)], "y int, p int")
    assert M.qwk(df, "y", "p").first()["qwk"] == pytest.approx(1 - 4 / 6.5)
    got = {r["label"]: r["recall"] for r in M.class_recall(df, "y", "p", [0, 1, 2, 3]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0}
    assert M.balanced_accuracy(df, "y", "p").first()["score"] == pytest.approx(2.5 / 3)


def scores(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "fold int, score double")


def test_paired_delta(spark):
    ref = scores(spark, [0.9] * 5)
    d = M.paired_delta(scores(spark, [0.91, 0.92, 0.91, 0.92, 0.91]), ref).first()
    x = np.array([0.01, 0.02, 0.01, 0.02, 0.01])
    assert d["diff_mean"] == pytest.approx(x.mean(), abs=1e-6) and d["diff_sem"] == pytest.approx(x.std(ddof=1) / 5 ** 0.5, abs=1e-6) and d["defensible"]
    same = M.paired_delta(ref, ref).first()
    assert same["diff_mean"] == 0 and not same["defensible"]
    with pytest.raises(ValueError):
        M.require_matched(M.paired_delta(scores(spark, [0.9] * 4), ref))
    with pytest.raises(ValueError):
        M.require_matched(M.paired_delta(scores(spark, [0.9] * 6), ref))


def test_gates(spark):
    one = spark.createDataFrame([(0.75005,)], "score double")
    assert M.require_no_drift(one, 0.75).first()["passed"]
    with pytest.raises(ValueError):
        M.require_no_drift(one, 0.76)
    assert not M.require_no_drift(one, 0.76, enforce=False).first()["passed"]
    assert not M.score_fidelity(scores(spark, [0.9, 0.9]), scores(spark, [0.9, 0.91])).first()["passed"]


def test_answer_grading(spark):
    rows = [("0101", "0101", True), ("101", "0101", False), ("10.05", "10.0", True), ("11", "12.5", False), ("Cat ", "cat", True), (None, "x", False)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean")
    assert all(r["ok"] == r["want"] for r in df.withColumn("ok", M.answer_correct(F.col("p"), F.col("t"))).collect())


def test_out_of_fold_never_trains_on_scored_rows(spark):
    df = H.stratified_folds(spark.range(60).withColumns({"label": (F.col("id") % 2).cast("double"), "x": (F.col("id") % 2 + F.col("id") / 100)}), ["id"], "label", 3)

    def spy(train):
        seen = {r["id"] for r in train.select("id").collect()}
        weights = train.groupBy("label").agg(F.max("weight")).collect()
        assert len(weights) == 2

        def score(d):
            assert not seen & {r["id"] for r in d.select("id").collect()}
            return d.withColumn("probability", F.array(1 - F.col("label"), F.col("label")))
        return score

    out, test = E.out_of_fold(df, ["id"], "label", 3, spy, test=spark.range(1000, 1010).withColumn("label", F.lit(1.0)))
    assert out.count() == out.select("id").distinct().count() == 60 and test.count() == 10
    assert {round(r["score"], 6) for r in E.oof_scores(out, "label").collect()} == {1.0}
    model = E.logistic(["x"], "label", max_iter=5)
    assert E.out_of_fold(df, ["id"], "label", 3, model)[0].count() == 60


def test_shuffled_column_is_a_permutation(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    out = E.shuffled_column(df, ["id"], "v").collect()
    assert sorted(r["v"] for r in out) == [i * 3 for i in range(500)] and sum(r["v"] == r["id"] * 3 for r in out) < 50


def test_ablation_needs_a_baseline(spark):
    with pytest.raises(KeyError):
        E.ablation(spark.range(3), ["id"], "label", 2, {"x": ["a"]}, lambda c: None)


def test_search_draws_stay_in_range():
    draws = E.random_params({"regParam": (1e-4, 1e-1), "elasticNetParam": (0.1, 1.0)}, 64)
    assert len(draws) == 64 and all(1e-4 <= d["regParam"] <= 1e-1 and 0.1 <= d["elasticNetParam"] <= 1.0 for d in draws)


def kappa(y, p):
    y, p = np.array(y, float), np.array(p, float)
    under = (y * y).sum() + (p * p).sum() - 2 * y.sum() * p.sum() / len(y)
    return 1 - ((y - p) ** 2).sum() / under if under else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_thresholds_equal_full_enumeration(seed):
    from itertools import combinations_with_replacement
    r = np.random.default_rng(seed)
    y = r.integers(0, 5, 60)
    b = np.clip(np.round(y * r.choice([3, 6, 10]) + r.normal(0, 6, 60) + r.choice([0, 25])), -5, 60).astype(int)
    cells = {}
    for x, c in zip(b.tolist(), y.tolist()):
        cells[x, c] = cells.get((x, c), 0.0) + 1.0
    at, q = B.ordered_optimum(cells, 5, 10)
    grid = sorted({*np.unique(b).tolist(), int(b.max()) + 1, int(b.min())})  # positions between bins change nothing
    best = max(kappa(y, sum((b >= t).astype(int) for t in ts)) for ts in combinations_with_replacement(grid, 4))
    assert at == sorted(at) and q == pytest.approx(best, abs=1e-9) == kappa(y, sum((b >= t).astype(int) for t in at))


def test_twenty_classes_and_one_bin():
    r = np.random.default_rng(1)
    y = r.integers(0, 20, 4000)
    b = np.round(y * 10 + r.normal(0, 8, 4000) + 40).astype(int)  # far from the midpoints
    cells = {}
    for x, c in zip(b.tolist(), y.tolist()):
        cells[x, c] = cells.get((x, c), 0.0) + 1.0
    at, q = B.ordered_optimum(cells, 20, 10)
    assert q > 0.98 and at == sorted(at) and all(abs(t - (m * 10 + 45)) <= 6 for m, t in enumerate(at))
    one, _ = B.ordered_optimum({(7, 2): 5.0}, 3, 10)  # one bin of one class: kappa is not defined
    assert one == sorted(one) and set(one) <= {7, 8}


def test_rank_buckets_follow_the_counts(spark, monkeypatch):
    from foldwise.operators import ranks as R
    df = spark.range(3000).selectExpr("id", "if(id < 2500, 'big', concat('g', id % 7)) AS g", "md5(cast(id AS string)) AS h")
    want = {r.id: (r.rank, r.rank_total) for r in R.hash_rank(df, "h", ["g"]).collect()}
    monkeypatch.setattr(R, "BUCKET_ROWS", 3)
    assert R.radix_digits(df, ["g"]) == 3 and R.radix_digits(df.where("g <> 'big'"), ["g"]) == 2
    assert R.radix_digits(df.limit(0)) == 2
    assert {r.id: (r.rank, r.rank_total) for r in R.hash_rank(df, "h", ["g"]).collect()} == want
    monkeypatch.setattr(R, "BUCKET_ROWS", 0)
    monkeypatch.setattr(R, "MOST_DIGITS", 9)
    assert {r.id: (r.rank, r.rank_total) for r in R.hash_rank(df, "h", ["g"]).collect()} == want


def test_equal_rows_are_blended_once(spark):
    df = spark.createDataFrame([(0, 1, 0.2, 0.8, 0.6, 0.4)] * 50 + [(1, 0, 0.7, 0.3, 0.1, 0.9)] * 30, "fold int, y int, a0 double, a1 double, b0 double, b1 double")
    c = B.blend_counts(df, [["a0", "a1"], ["b0", "b1"]], "y")
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
    got = {(r["w0"], r["fold"]): (r["hits"], r["n"]) for r in c.collect()}
    assert got[(1.0, 0)] == (50, 50) and got[(0.0, 0)] == (0, 50) and got[(1.0, 1)] == (30, 30) and got[(0.0, 1)] == (0, 30) and len(got) == 26
