"""Models whose fit is a sum: all fold models come from one aggregate of the rows.

Least squares needs only the cross products of its columns, naive Bayes only counts.
Both are kept for each (fold, class), so the model of a fold is the total less what
the fold itself adds, with class weights from its training side alone. Any subset of
the columns and any ridge is a part of the same cross products, so a whole ablation
or search costs one aggregate to fit and one scan to score.

What reaches the driver are folds * classes matrices of columns squared, or folds *
classes * bins counts; neither depends on the number of rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import argmax_array, let, order_key, r6
from foldwise.operators.metrics import balanced_accuracy, paired_delta
from foldwise.operators.ranks import hash_rank

#: Scores are compared after rounding, so that the order of a sum does not decide between classes.
DIGITS = 9
RIDGE = 1e-3
ALL = -1


# ---- columns -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Scaled:
    """A number mapped so that lo is 0 and hi is 1; a missing one is in the middle."""
    name: str
    lo: float
    hi: float

    def sql(self) -> str:
        return f"coalesce((CAST({self.name} AS DOUBLE) - {self.lo:.17e}) / {self.hi - self.lo:.17e}, 5.0e-1)"


@dataclass(frozen=True)
class Indicator:
    """1 where the column has the value, else 0."""
    name: str
    value: str

    def sql(self) -> str:
        return f"CASE WHEN {self.name} = '{self.value}' THEN 1.0e0 ELSE 0.0e0 END"


@dataclass(frozen=True)
class Bins:
    """Bin of a number in n equal parts of [lo, hi], outliers in the first and last; n for a missing one."""
    name: str
    lo: float
    hi: float
    n: int

    @property
    def size(self) -> int:
        return self.n + 1

    def sql(self) -> str:
        return (f"CASE WHEN {self.name} IS NULL THEN {self.n} ELSE CAST(greatest(0.0e0, least({self.n - 1:.17e}, "
                f"floor((CAST({self.name} AS DOUBLE) - {self.lo:.17e}) / {self.hi - self.lo:.17e} * {self.n:.17e}))) AS INT) END")


@dataclass(frozen=True)
class Values:
    """Place of a value in a list; the list's length for others and a missing one."""
    name: str
    values: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.values) + 1

    def sql(self) -> str:
        return "CASE " + " ".join(f"WHEN {self.name} = '{v}' THEN {i}" for i, v in enumerate(self.values)) + f" ELSE {len(self.values)} END"


@dataclass(frozen=True)
class Coded:
    """The place that a column has in a code made by `code_sql`."""
    name: str
    size: int
    step: int

    def sql(self) -> str:
        return f"CAST(({self.name} DIV {self.step}) % {self.size} AS INT)"


def code_sql(specs: Sequence) -> str:
    """The places of all columns as one number. There are no more codes than the product of the columns' sizes."""
    out, step = [], 1
    for s in specs:
        out.append(f"CAST({s.sql()} AS BIGINT) * {step}L")
        step *= s.size
    return " + ".join(out)


def coded(specs: Sequence, name: str) -> list[Coded]:
    """The columns, read from their code."""
    steps = [math.prod(s.size for s in specs[:i]) for i in range(len(specs))]
    return [Coded(name, s.size, step) for s, step in zip(specs, steps)]


# ---- least squares ------------------------------------------------------------------------

@dataclass(frozen=True)
class Setting:
    """One configuration: which of the columns take part, and the ridge."""
    name: str
    use: tuple[bool, ...]
    ridge: float = RIDGE


def setting(name: str, columns: Sequence, use: Sequence[str] | None = None, ridge: float = RIDGE) -> Setting:
    """A configuration by column names; all columns by default."""
    return Setting(name, tuple(use is None or c.name in use for c in columns), ridge)


def _vector(columns: Sequence) -> list[Column]:
    return [F.lit(1.0), *[F.expr(c.sql()) for c in columns]]


def cross_products(df: DataFrame, columns: Sequence, label: str, fold: str = "fold") -> dict[tuple[int, int], np.ndarray]:
    """{(fold, class): sum of the outer products of (1, columns)} in one aggregate. Rows without a class are left out, rows without a fold are in no
    fold and train every model."""
    names = [f"_x{i}" for i in range(len(columns) + 1)]
    x = df.where(F.col(label).isNotNull()).select(F.col(fold).alias("_f"), F.col(label).cast("int").alias("_y"), *[v.alias(n) for n, v in zip(names, _vector(columns))])
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = {}
    for r in x.groupBy("_f", "_y").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in at]).collect():  # folds * classes rows
        m = np.zeros((len(names), len(names)))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[-2 if r["_f"] is None else r["_f"], r["_y"]] = m
    return out


def least_squares(products: dict[tuple[int, int], np.ndarray], settings: Sequence[Setting], n_classes: int, folds: Sequence[int]) -> dict[str, dict[int, np.ndarray]]:
    """{setting: {fold: coefficients, one column for each class}}; fold ALL is fitted on everything. Classes weigh the same on every training side."""
    size = len(next(iter(products.values()))) if products else 0
    out: dict[str, dict[int, np.ndarray]] = {s.name: {} for s in settings}
    for own in [*folds, ALL]:
        by = [sum((m for (f, y), m in products.items() if f != own and y == c), np.zeros((size, size))) for c in range(n_classes)]
        total = sum(m[0, 0] for m in by) if size else 0
        weight = [total / (n_classes * m[0, 0]) / total if size and m[0, 0] else 0.0 for m in by]
        for s in settings:
            if not total:
                out[s.name][own] = np.zeros((size, n_classes))
                continue
            use = np.array([True, *s.use])
            a = sum(w * m for w, m in zip(weight, by)) * np.outer(use, use)
            a = a + np.diag([0.0 if i == 0 else s.ridge if u else 1.0 for i, u in enumerate(use)])
            b = np.stack([w * m[:, 0] * use for w, m in zip(weight, by)], axis=1)
            out[s.name][own] = np.linalg.solve(a, b)
    return out


def _class_scores(columns: Sequence, w: Column, size: int, k: int) -> Column:
    x = _vector(columns)
    return F.array(*[F.round(sum((F.get(w, F.lit(i * k + c)) * x[i] for i in range(1, size)), F.get(w, F.lit(c))), DIGITS) for c in range(k)])


def _weights(model: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in model.ravel()])


def linear_scores(columns: Sequence, models: dict[int, np.ndarray], fold: str | None = "fold") -> Column:
    """Array of one score for each class: by the model of the row's fold, or with fold None by the one fitted on everything."""
    size, k = next(iter(models.values())).shape
    own = F.get(F.array(*[_weights(models[f]) for f in sorted(f for f in models if f != ALL)]), F.col(fold)) if fold else _weights(models[ALL])
    return _class_scores(columns, own, size, k)


def linear_out_of_fold(df: DataFrame, columns: Sequence, label: str, n_classes: int, k: int, ridge: float = RIDGE, fold: str = "fold") -> DataFrame:
    """df with `probability`, the scores of each row by the model that did not see it."""
    s = setting("all", columns, ridge=ridge)
    models = least_squares(cross_products(df, columns, label, fold), [s], n_classes, range(k))[s.name]
    return df.withColumn("probability", linear_scores(columns, models, fold))


def setting_scores(df: DataFrame, columns: Sequence, models: dict[str, dict[int, np.ndarray]], label: str, fold: str = "fold") -> DataFrame:
    """(setting, fold, score, n): balanced accuracy of every setting on every fold, in one scan."""
    size, k = next(iter(next(iter(models.values())).values())).shape
    folds = sorted({f for m in models.values() for f in m if f != ALL})
    each = F.array(*[F.struct(F.lit(name).alias("setting"), F.array(*[_weights(m[f]) for f in folds]).alias("w")) for name, m in models.items()])
    rows = df.where(F.col(label).isNotNull()).select("*", F.explode(each).alias("_s")).withColumn("_w", F.get("_s.w", F.col(fold)))
    scored = rows.select(F.col(fold), F.col(label).cast("int").alias("_y"), F.col("_s.setting").alias("setting"),
                         argmax_array(_class_scores(columns, F.col("_w"), size, k)).alias("_pred"))
    return balanced_accuracy(scored, "_y", "_pred", ["setting", fold])


def linear_ablation(df: DataFrame, columns: Sequence, label: str, n_classes: int, k: int, configs: dict[str, Sequence[str]], baseline: str = "baseline",
                    fold: str = "fold") -> DataFrame:
    """Mean and spread of each column set's fold scores, and its paired comparison with the baseline set."""
    if baseline not in configs:
        raise KeyError(f"no {baseline!r} configuration")
    settings = [setting(name, columns, use) for name, use in configs.items()]
    models = least_squares(cross_products(df, columns, label, fold), settings, n_classes, range(k))
    table = setting_scores(df, columns, models, label, fold).withColumnRenamed("setting", "config").select("config", fold, "score")
    rows = df.sparkSession.createDataFrame(table.collect(), table.schema)  # settings * folds rows
    mean = rows.groupBy("config").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    d = paired_delta(rows.where(F.col("config") != baseline), rows.where(F.col("config") == baseline), fold, by=["config"])
    return mean.join(d, "config", "left").select("config", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "diff_mean", "diff_sem", "defensible")


# ---- search in rungs -------------------------------------------------------------------------

def random_settings(columns: Sequence, n: int, low: float, high: float, seed: int = 42) -> list[Setting]:
    """Seeded draws: a ridge from a log-uniform range, and at most one column left out."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ridge = float(f"{math.exp(rng.uniform(math.log(low), math.log(high))):.6g}")
        gone = rng.randrange(len(columns) + 1)
        out.append(Setting(str(i), tuple(j != gone for j in range(len(columns))), ridge))
    return out


def pruned_search(df: DataFrame, columns: Sequence, label: str, n_classes: int, k: int, draws: Sequence[Setting], fold: str = "fold") -> list[dict]:
    """Trials of a search that gives folds in rungs: in rung r the draws still running are scored on fold r, and those whose mean so far is below the
    median of the rung end there. Each rung reads the rows of its fold only; the fits come from one aggregate.

    Returns a row for each draw: trial, ridge, n_columns, folds (how many it was given), reason (completed or pruned), scores and their mean.
    """
    models = least_squares(cross_products(df, columns, label, fold), draws, n_classes, range(k))
    scores: dict[str, list[float]] = {d.name: [] for d in draws}
    running = [d.name for d in draws]
    for r in range(k):
        got = {x["setting"]: x["score"] for x in setting_scores(df.where(F.col(fold) == r), columns, {n: models[n] for n in running}, label, fold).collect()}
        for n in running:
            scores[n].append(got.get(n, 0.0))
        mean = {n: round(sum(scores[n]) / len(scores[n]), DIGITS) for n in running}
        if r + 1 < k:
            middle = median(mean.values())
            running = [n for n in running if mean[n] >= middle - 10.0 ** -DIGITS]
    return [{"trial": i, "ridge": d.ridge, "n_columns": sum(d.use), "folds": len(scores[d.name]), "reason": "completed" if d.name in running else "pruned",
             "scores": scores[d.name], "mean": sum(scores[d.name]) / max(1, len(scores[d.name]))} for i, d in enumerate(draws)]


def best_trial(trials: Sequence[dict]) -> int:
    """Of the completed trials the best by mean, of equal ones the first."""
    done = [t for t in trials if t["reason"] == "completed"]
    return max(done, key=lambda t: (round(t["mean"], DIGITS), -t["trial"]))["trial"]


def trial_table(spark, trials: Sequence[dict]) -> DataFrame:
    best = best_trial(trials)
    rows = [(t["trial"], t["ridge"], t["n_columns"], t["folds"], t["reason"], t["mean"], t["trial"] == best) for t in trials]
    out = spark.createDataFrame(rows, "trial int, ridge double, n_columns int, folds int, reason string, score double, best boolean")
    return out.withColumn("score", r6(F.col("score")))


def re_evaluated(df: DataFrame, columns: Sequence, label: str, n_classes: int, k: int, best: Setting, default: Setting, fold: str = "fold") -> DataFrame:
    """The best draw and the default fitted and scored anew on every fold, compared in pairs."""
    both = [Setting("best", best.use, best.ridge), Setting("default", default.use, default.ridge)]
    models = least_squares(cross_products(df, columns, label, fold), both, n_classes, range(k))
    table = setting_scores(df, columns, models, label, fold).select("setting", fold, "score")
    rows = df.sparkSession.createDataFrame(table.collect(), table.schema)
    side = {n: rows.where(F.col("setting") == n) for n in ("best", "default")}
    mean = rows.groupBy().agg(*[r6(F.avg(F.when(F.col("setting") == n, F.col("score")))).alias(f"{n}_mean") for n in side])
    return mean.crossJoin(paired_delta(side["best"], side["default"], fold).drop("matched"))  # one row each


# ---- importance by permutation ------------------------------------------------------------------

def permutation_drops(valid: DataFrame, key: Sequence[str], label: str, columns: Sequence, score: Callable[[Sequence], Column], seed: int = 7) -> DataFrame:
    """Drop in balanced accuracy when one column's values come from another row, for all columns in one pass.

    One join by position gives every row a donor row; each row is then scored once as it is and once for each column taken from the donor. `score`
    makes the array of class scores from columns.
    """
    names = list(dict.fromkeys(c.name for c in columns))
    a = hash_rank(valid.withColumn("_h", order_key(key, seed)).select("_h", F.col(label).cast("int").alias("_y"), *names), "_h", [], out="_p", once=True).drop("_p_total")
    b = hash_rank(valid.withColumn("_h", order_key(key, seed + 1)).select("_h", F.struct(*names).alias("_d")), "_h", [], out="_p", once=True).select("_p", "_d")
    both = a.join(b, "_p")
    swapped = [F.struct(F.lit("(none)").alias("feature"), *[F.col(n).alias(n) for n in names])]
    swapped += [F.struct(F.lit(n).alias("feature"), *[(F.col(f"_d.{m}") if m == n else F.col(m)).alias(m) for m in names]) for n in names]
    rows = both.select("_y", F.explode(F.array(*swapped)).alias("s")).select("_y", "s.*")
    acc = balanced_accuracy(rows.withColumn("_pred", argmax_array(score(columns))), "_y", "_pred", ["feature"])
    one = acc.agg(F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("m"))  # one entry for each column
    return one.select("m", F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")).select(
        "feature", r6(F.col("m")["(none)"]).alias("base"), r6(F.col("m")["(none)"] - F.col("m")[F.col("feature")]).alias("drop"))


# ---- counts: naive Bayes and importances ---------------------------------------------------------

def bin_counts(df: DataFrame, specs: Sequence, label: str, fold: str = "fold", n: str | None = None) -> dict[tuple[int, int, int, int], int]:
    """{(fold, class, column, bin): rows} in one aggregate; with `n` each row stands for that many."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.expr(s.sql()).cast("int").alias("b")) for i, s in enumerate(specs)])
    x = df.where(F.col(label).isNotNull()).select(F.coalesce(F.col(fold), F.lit(-2)).alias("_f"), F.col(label).cast("int").alias("_y"),
                                              (F.col(n) if n else F.lit(1)).alias("_n"), F.explode(each).alias("e"))
    return {(r["_f"], r["_y"], r["c"], r["b"]): r["n"] for r in x.groupBy("_f", "_y", "e.c", "e.b").agg(F.sum("_n").alias("n")).collect()}  # folds * classes * bins


def _of_side(counts: dict, specs: Sequence, n_classes: int, own: int) -> list[np.ndarray]:
    """For each column [bins, classes] of the rows outside fold `own`."""
    out = [np.zeros((s.size, n_classes)) for s in specs]
    for (f, y, c, b), n in counts.items():
        if f != own:
            out[c][b, y] += n
    return out


def bayes(counts: dict, specs: Sequence, n_classes: int, folds: Sequence[int], smooth: float = 1.0) -> dict[int, list[np.ndarray]]:
    """{fold: for each column the log share of each bin in each class}. Classes have equal priors, as with balanced weights."""
    out = {}
    for own in [*folds, ALL]:
        side = _of_side(counts, specs, n_classes, own)
        out[own] = [np.log((m + smooth) / (m.sum(axis=0) + smooth * len(m))) for m in side]
    return out


def bayes_scores(specs: Sequence, models: dict[int, list[np.ndarray]], fold: str | None = "fold") -> Column:
    """Array of one log score for each class, by the model of the row's fold or the one of everything."""
    own = [ALL] if fold is None else sorted(f for f in models if f != ALL)
    k = next(iter(models.values()))[0].shape[1]
    at = F.lit(0) if fold is None else F.col(fold)
    parts = []
    for i, s in enumerate(specs):
        table = F.array(*[F.array(*[F.lit(float(v)) for v in models[f][i].ravel()]) for f in own])
        parts.append((F.get(table, at), F.expr(s.sql()).cast("int")))
    return F.array(*[F.round(sum((F.get(t, b * k + c) for t, b in parts), F.lit(0.0)), DIGITS) for c in range(k)])


def bayes_out_of_fold(df: DataFrame, specs: Sequence, label: str, n_classes: int, k: int, fold: str = "fold") -> DataFrame:
    """df with `probability`: log scores of each row by the model that did not see it, as probabilities."""
    models = bayes(bin_counts(df, specs, label, fold), specs, n_classes, range(k))
    return df.withColumn("probability", softmax(bayes_scores(specs, models, fold)))


def softmax(logs: Column) -> Column:
    """Probabilities from an array of log scores, which are computed once a row."""
    exps = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(e, lambda x: F.round(x / n, DIGITS)))
    return let(let(logs, exps), shares)


def split_gains(counts: dict, specs: Sequence, n_classes: int, folds: Sequence[int]) -> list[tuple[int, str, float]]:
    """(fold, column, gain): how much parting the training side by the column's bins lowers the Gini impurity."""
    out = []
    for own in folds:
        for s, m in zip(specs, _of_side(counts, specs, n_classes, own)):
            n = m.sum()
            gini = lambda v: 1.0 - float(((v / v.sum()) ** 2).sum()) if v.sum() else 0.0
            out.append((own, s.name, float(gini(m.sum(axis=0)) - sum(float(v.sum()) / n * gini(v) for v in m)) if n else 0.0))
    return out


def mean_gains(spark, gains: Sequence[tuple[int, str, float]], top: int = 30) -> DataFrame:
    """Mean gain over the fold models, largest first."""
    t = spark.createDataFrame(list(gains), "fit int, feature string, importance double")
    return t.groupBy("feature").agg(r6(F.avg("importance")).alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(top)
