"""Metric, comparison and fairness tables, each one mergeable aggregation over the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import r6

SIGMAS = 2.0  # Fixed value: a paired gain must exceed this many standard errors.


def confusion(df: DataFrame, y: str, yhat: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Counts and row percent for every label pair in a fixed order, absent cells as zero."""
    by = list(by)
    c = df.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("n"))
    # At most labels^2 entries per group; values outside the label set have no cell.
    m = c.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col(y).isin(*labels) & F.col(yhat).isin(*labels), F.struct(
        F.concat_ws("|", F.col(y).cast("string"), F.col(yhat).cast("string")), F.col("n"))))).alias("m"))
    grid = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("p")) for a in labels for b in labels])
    cell = lambda a, b: F.coalesce(F.try_element_at("m", F.concat_ws("|", a.cast("string"), b.cast("string"))), F.lit(0))
    cells = m.select(*by, "m", F.explode(grid).alias("g"))
    row_total = F.aggregate(F.array(*[F.lit(x) for x in labels]), F.lit(0).cast("bigint"), lambda acc, b: acc + cell(F.col("g.y"), b))
    n = cell(F.col("g.y"), F.col("g.p"))
    return cells.select(*by, F.col("g.y").alias("actual"), F.col("g.p").alias("predicted"), n.alias("n"),
                        F.round(F.coalesce(F.try_divide(n * 100.0, row_total), F.lit(0.0)), 4).alias("row_pct"))


def class_recall(df: DataFrame, y: str, yhat: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Recall per label, zero for an absent class."""
    c = confusion(df, y, yhat, labels, by)
    return c.groupBy(*by, F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"),
        r6(F.coalesce(F.try_divide(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))) * 1.0, F.sum("n")), F.lit(0.0))).alias("recall"))


def balanced_accuracy(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Mean recall over the classes that occur, per group; with `n` each row stands for that many."""
    hit = (F.col(y) == F.col(yhat)).cast("double")
    per = df.groupBy(*by, y).agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("n")) if n is None else (
        df.groupBy(*by, y).agg((F.sum(hit * F.col(n)) / F.sum(F.when(hit.isNotNull(), F.col(n)))).alias("recall"), F.sum(n).alias("n")))
    return per.groupBy(*by).agg(F.avg("recall").alias("score"), F.sum("n").alias("n"))


def fold_summary(scores: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.groupBy(*by).agg(F.count(score).alias("n_folds"), r6(F.avg(score)).alias("mean"), r6(F.stddev_pop(score)).alias("std"))


def qwk(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa from moments: 1 - sum (y-p)^2 / (sum y^2 + sum p^2 - 2 sum y sum p / n)."""
    a, b = F.col(y).cast("double"), F.col(yhat).cast("double")
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((a - b) * (a - b)).alias("d"), F.sum(a * a + b * b).alias("s2"),
                            F.sum(a).alias("sa"), F.sum(b).alias("sb"))
    e = F.col("s2") - 2.0 * F.col("sa") * F.col("sb") / F.col("n")
    return m.select(*by, "n", (1.0 - F.try_divide(F.col("d"), e)).alias("qwk"))


def class_report(df: DataFrame, y: str, yhat: str, labels: Sequence) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro F1 and accuracy rows."""
    c = confusion(df, y, yhat, labels)
    hit = F.col("actual") == F.col("predicted")
    sides = c.select(F.explode(F.array(
        F.struct(F.col("actual").cast("string").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("pred"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("predicted").cast("string").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("pred").alias("pred"), F.sum("tp").cast("double").alias("tp"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pred") + F.col("support")), F.lit(0.0))
    per = g.select("label", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "tp")
    macro = per.agg(F.lit("macro avg").alias("label"), F.sum("support").alias("support"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    acc = per.agg(F.lit("accuracy").alias("label"), F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("f1"))
    none = F.lit(None).cast("double")
    acc = acc.select("label", "support", none.alias("precision"), none.alias("recall"), "f1")
    return per.drop("tp").unionByName(macro).unionByName(acc).select(
        "label", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def paired_delta(candidate: DataFrame, reference: DataFrame, fold: str = "fold", score: str = "score",
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean paired difference, its standard error and whether it clears two standard errors.

    A fold present on one side only makes the comparison invalid: statistics are missing
    and `matched` is false. Equal vectors give a zero difference, which is not defensible.
    """
    b = reference.select(F.col(fold), F.col(score).alias("_b"))
    j = candidate.select(*by, F.col(fold), F.col(score).alias("_a")).join(b, fold, "left")
    d = F.col("_a") - F.col("_b")
    n_ref = reference.agg(F.count(F.lit(1))).scalar()
    s = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.count(d).alias("_nd"),
                           F.avg(d).alias("m"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    s = s.withColumn("matched", (F.col("_nd") == F.col("n_folds")) & (F.col("n_folds") == n_ref))
    ok = F.col("matched")
    return s.select(*by, "n_folds", "matched", r6(F.when(ok, F.col("m"))).alias("diff_mean"), r6(F.when(ok, F.col("se"))).alias("diff_sem"),
                    F.coalesce(ok & (F.col("m") > SIGMAS * F.col("se")), F.lit(False)).alias("defensible"))


def require_matched(delta: DataFrame) -> DataFrame:
    if delta.where(~F.col("matched")).limit(1).count():
        raise ValueError("fold mismatch between candidate and reference")
    return delta


def ship_decision(equal: DataFrame, nested: DataFrame) -> DataFrame:
    """Ship the equal blend if defensible, else the nested one if defensible, else nothing."""
    both = equal.select(F.lit("equal").alias("blend"), "diff_mean", "diff_sem", "defensible").unionByName(
        nested.select(F.lit("nested_weights").alias("blend"), "diff_mean", "diff_sem", "defensible"))
    one = both.agg(F.max(F.when(F.col("blend") == "equal", F.col("defensible"))).alias("e"),
                   F.max(F.when(F.col("blend") == "nested_weights", F.col("defensible"))).alias("n"),
                   F.max(F.when(F.col("blend") == "equal", F.col("diff_mean"))).alias("equal_gain"),
                   F.max(F.when(F.col("blend") == "nested_weights", F.col("diff_mean"))).alias("nested_gain"))
    return one.select("equal_gain", "nested_gain", F.when(F.col("e"), "equal").when(F.col("n"), "nested_weights").otherwise("none").alias("shipped"))


def drift_gate(observed: DataFrame, canonical: float, value: str = "score", tolerance: float = 1e-4) -> DataFrame:
    """Compare a one-row mean score with the recorded one."""
    gap = F.abs(F.col(value) - F.lit(canonical))
    return observed.select(r6(F.col(value)).alias("observed"), F.lit(canonical).alias("canonical"), r6(gap).alias("gap"),
                           (gap <= tolerance).alias("passed"))


def require_no_drift(observed: DataFrame, canonical: float, value: str = "score", tolerance: float = 1e-4, enforce: bool = True) -> DataFrame:
    gate = drift_gate(observed, canonical, value, tolerance)
    if enforce:
        row = gate.first()
        if not row["passed"]:
            raise ValueError(f"score drifted: {row.asDict()}")
    return gate


def score_fidelity(new: DataFrame, ref: DataFrame, fold: str = "fold", score: str = "score", atol: float = 1e-4,
                   rtol: float = 1e-5) -> DataFrame:
    """Whether fold scores agree: |a - b| <= atol + rtol * |b| on every fold of either side."""
    j = new.select(fold, F.col(score).alias("_a")).join(ref.select(fold, F.col(score).alias("_b")), fold, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    ok = F.coalesce(gap <= F.lit(atol) + F.lit(rtol) * F.abs("_b"), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(ok).alias("n_close"), r6(F.max(gap)).alias("max_gap"), F.bool_and(ok).alias("passed"))


def error_types(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Counts of under-triage (predicted above the truth), over-triage, and where each class went wrong."""
    kind = F.when(F.col(yhat) > F.col(y), "under").when(F.col(yhat) < F.col(y), "over")
    return df.where(F.col(y) != F.col(yhat)).groupBy(kind.alias("error"), F.col(y).alias("actual"), F.col(yhat).alias("predicted")
                                                     ).agg(F.count(F.lit(1)).alias("n"))


def fairness_table(df: DataFrame, dims: Sequence[str], y: str, yhat: str, critical) -> DataFrame:
    """Accuracy, under-prediction rate and critical-class recall per group, with the accuracy gap per dimension."""
    hit = (F.col(y) == F.col(yhat)).cast("double")
    lf = df.select(hit.alias("_hit"), (F.col(yhat) > F.col(y)).cast("double").alias("_under"), (F.col(y) == critical).alias("_crit"),
                   *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(["_hit", "_under", "_crit"], list(dims), "dimension", "level")
    g = lf.where("level is not null").groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("acc"), F.avg("_under").alias("under"),
        F.count_if("_crit").alias("n_critical"), F.avg(F.when(F.col("_crit"), F.col("_hit"))).alias("crit"))
    gap = g.groupBy("dimension").agg((F.max("acc") - F.min("acc")).alias("gap"))
    return g.join(gap, "dimension").select("dimension", "level", "n", r6(F.col("acc")).alias("accuracy"), r6(F.col("under")).alias("under_rate"),
                                           "n_critical", r6(F.col("crit")).alias("critical_recall"), r6(F.col("gap")).alias("accuracy_gap"))


def label_shift(train: DataFrame, pred: DataFrame, y: str, yhat: str, labels: Sequence) -> DataFrame:
    """Share of each label among predictions and among training rows."""
    both = train.select(F.col(y).alias("label"), F.lit(1).alias("_t"), F.lit(0).alias("_p")).unionByName(
        pred.select(F.col(yhat).alias("label"), F.lit(0).alias("_t"), F.lit(1).alias("_p")))
    c = both.groupBy("label").agg(F.sum("_t").alias("t"), F.sum("_p").alias("p"))
    sums = c.agg(F.struct(F.sum("t").alias("t"), F.sum("p").alias("p"),
                          F.map_from_entries(F.collect_list(F.when(F.col("label").isin(*labels), F.struct("label", F.struct("t", "p"))))).alias("m")).alias("s"))
    row = sums.select("s.*", F.explode(F.array(*[F.lit(v) for v in labels])).alias("label"))
    e = F.try_element_at("m", F.col("label"))
    n_t, n_p = F.coalesce(e["t"], F.lit(0)), F.coalesce(e["p"], F.lit(0))
    st, sp = F.try_divide(n_t * 1.0, F.col("t")), F.try_divide(n_p * 1.0, F.col("p"))
    return row.select("label", n_t.alias("n_train"), n_p.alias("n_predicted"), r6(st).alias("train_share"), r6(sp).alias("predicted_share"), r6(sp - st).alias("shift"))


def answer_correct(pred: Column, truth: Column, rel_tol: float = 1e-2) -> Column:
    """Free-text answer grading: digit strings of 0 and 1 exactly, numbers within a relative tolerance,
    anything else ignoring case."""
    p, t = F.trim(pred), F.trim(truth)
    pn, tn = p.try_cast("double"), t.try_cast("double")
    close = F.abs(pn - tn) <= F.lit(rel_tol) * F.greatest(F.abs(tn), F.lit(1e-9))
    res = (F.when(t.rlike("^[01]+$"), p == t).when(pn.isNotNull() & tn.isNotNull(), close).otherwise(F.lower(p) == F.lower(t)))
    return F.coalesce(res, F.lit(False))
