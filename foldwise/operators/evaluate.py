"""Model evaluation jobs around pyspark.ml: out-of-fold scoring, refits, search, ablation, importances.

A model is a callable `fit(train) -> score(df)`: it sees only the training side of
a fold. Loops run over folds, seeds or configurations, never over data.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import argmax_array, order_key, r6
from foldwise.operators.assoc import roc_auc
from foldwise.operators.folds import class_weights, stratified_folds, with_weights
from foldwise.operators.metrics import balanced_accuracy, paired_delta
from foldwise.operators.ranks import hash_rank

Score = Callable[[DataFrame], DataFrame]
Model = Callable[[DataFrame], Score]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}__v" for c in categorical]], outputCol="raw_features", handleInvalid="keep"))
    return stages


def logistic(numeric: Sequence[str], label: str, categorical: Sequence[str] = (), max_iter: int = 10, reg: float = 1e-3,
             weight: str | None = "weight") -> Model:
    """Logistic regression, which standardises inside the fit; every stage is fitted on the training side only."""
    def fit(train: DataFrame) -> Score:
        lr = LogisticRegression(featuresCol="raw_features", labelCol=label, maxIter=max_iter, regParam=reg)
        if weight:
            lr = lr.setWeightCol(weight)
        m = Pipeline(stages=[*_stages(numeric, categorical), lr]).fit(train)
        return lambda d: m.transform(d).withColumn("probability", vector_to_array("probability"))
    return fit


def by_source(metadata: dict, importances: Sequence[float], numeric: Sequence[str], categorical: Sequence[str]) -> list[float]:
    """Importances of the assembled slots summed for the columns they come from, in the order [*numeric, *categorical]."""
    names = {a["idx"]: a.get("name", "") for group in metadata.get("ml_attr", {}).get("attrs", {}).values() for a in group}
    total = dict.fromkeys([*numeric, *categorical], 0.0)
    for i, v in enumerate(importances):
        slot = names.get(i, "")
        source = slot if slot in numeric else next((c for c in sorted(categorical, key=len, reverse=True) if slot.startswith(f"{c}__v_")), None)
        if source is None:
            raise ValueError(f"slot {i} ({slot!r}) comes from no column")
        total[source] += float(v)
    return list(total.values())


def forest(numeric: Sequence[str], label: str, categorical: Sequence[str] = (), trees: int = 10, depth: int = 5, seed: int = 42,
           weight: str | None = "weight", keep: dict | None = None) -> Model:
    """Random forest; with `keep` the fitted importances are added under the fit's number."""
    def fit(train: DataFrame) -> Score:
        rf = RandomForestClassifier(featuresCol="raw_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
        if weight:
            rf = rf.setWeightCol(weight)
        m = Pipeline(stages=[*_stages(numeric, categorical), rf]).fit(train)
        if keep is not None:
            keep[len(keep)] = by_source(m.transform(train).schema["raw_features"].metadata, m.stages[-1].featureImportances.toArray(), numeric, categorical)
        score = lambda d: m.transform(d).withColumn("probability", vector_to_array("probability"))
        score.forest = m.stages[-1]
        return score
    return fit


def out_of_fold(df: DataFrame, key: Sequence[str], label: str, k: int, model: Model, fold: str = "fold",
                test: DataFrame | None = None, n_classes: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """Each row scored once by the model that did not see it; and test probabilities averaged over the folds."""
    parts, tests = [], []
    for i in range(k):
        train = df.where(F.col(fold) != i)
        score = model(with_weights(train, class_weights(train, label), label))
        parts.append(score(df.where(F.col(fold) == i)).select(*key, fold, label, "probability"))
        if test is not None:
            tests.append(score(test).select(*key, "probability"))
    return union_all(parts), average_probabilities(tests, key, n_classes) if tests else None


def average_probabilities(parts: Sequence[DataFrame], key: Sequence[str], n_classes: int) -> DataFrame:
    """Mean class probabilities per id over models, folds or seeds, in one shuffle on the id."""
    n = len(parts)
    both = union_all([p.select(*key, *[F.get("probability", F.lit(c)).alias(f"_p{c}") for c in range(n_classes)]) for p in parts])
    return both.groupBy(*key).agg(F.array(*[F.sum(f"_p{c}") / n for c in range(n_classes)]).alias("probability"))


def oof_scores(oof: DataFrame, label: str, fold: str = "fold", n: str | None = None) -> DataFrame:
    scored = oof.withColumn("pred", argmax_array(F.col("probability")))
    return balanced_accuracy(scored.withColumn("_y", F.col(label).cast("int")), "_y", "pred", [fold], n)


def refit_and_score(train: DataFrame, test: DataFrame, key: Sequence[str], label: str, model: Model) -> DataFrame:
    """Fit once on every training row and score the test rows."""
    score = model(with_weights(train, class_weights(train, label), label))
    return score(test).select(*key, "probability", argmax_array(F.col("probability")).alias("pred"))


def random_params(space: dict[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """Seeded draws from log-uniform ranges."""
    from math import exp, log
    rng = random.Random(seed)
    return [{p: exp(rng.uniform(log(lo), log(hi))) for p, (lo, hi) in sorted(space.items())} for _ in range(n)]


def grid_search(df: DataFrame, numeric: Sequence[str], label: str, fold: str, k: int, draws: Sequence[dict[str, float]],
                max_iter: int = 5) -> DataFrame:
    """Mean over folds of the balanced accuracy of each parameter draw, best first. Class weights come from the training folds alone."""
    df = df.withColumn("_row", F.monotonically_increasing_id())
    scores = []
    for i, d in enumerate(draws):
        model = logistic(numeric, label, max_iter=max_iter, reg=d.get("regParam", 1e-3))
        oof, _ = out_of_fold(df, ["_row"], label, k, model, fold)
        scores.append(oof_scores(oof, label, fold).agg(F.avg("score").alias("score")).select(
            F.lit(i).alias("trial"), "score", F.lit(",".join(f"{p}={v:.6g}" for p, v in sorted(d.items()))).alias("params")))
    return union_all(scores).orderBy(F.col("score").desc(), "trial")


def ablation(df: DataFrame, key: Sequence[str], label: str, k: int, configs: dict[str, Sequence[str]],
             make: Callable[[Sequence[str]], Model], baseline: str = "baseline", fold: str = "fold") -> DataFrame:
    """Fold scores of each column set and its paired comparison with the baseline set."""
    if baseline not in configs:
        raise KeyError(f"no {baseline!r} configuration")
    scores = []
    for name, cols in configs.items():
        oof, _ = out_of_fold(df, key, label, k, make(cols), fold)
        scores.append(oof_scores(oof, label, fold).select(F.lit(name).alias("config"), fold, "score"))
    table = union_all(scores).persist()
    mean = table.groupBy("config").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    d = paired_delta(table.where(F.col("config") != baseline), table.where(F.col("config") == baseline), fold, by=["config"])
    return mean.join(d, "config", "left").select("config", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                                                 "diff_mean", "diff_sem", "defensible")


def mean_importances(spark, kept: dict[int, list[float]], names: Sequence[str], top: int = 30) -> DataFrame:
    """Mean importance over fold models, largest first."""
    rows = [(f, n, float(v)) for f, vs in kept.items() for n, v in zip(names, vs, strict=True)]
    t = spark.createDataFrame(rows, "fit int, feature string, importance double")
    return t.groupBy("feature").agg(r6(F.avg("importance")).alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(top)


def pruned_features(importances: DataFrame, n: int) -> list[str]:
    """Names of the n most important features."""
    return [r["feature"] for r in importances.orderBy(F.col("importance").desc(), "feature").limit(n).collect()]


def shuffled_column(df: DataFrame, key: Sequence[str], column: str, seed: int = 7) -> DataFrame:
    """Replace a column by its values in another md5 order: two position tables joined on the position."""
    a = hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [], out="_p").drop("_h", "_p_total", column)
    b = hash_rank(df.select(*key, column).withColumn("_h", order_key(key, seed + 1)), "_h", [], out="_p").select("_p", column)
    return a.join(b, "_p").drop("_p")


def permutation_importance(valid: DataFrame, key: Sequence[str], label: str, score: Score, features: Sequence[str], seed: int = 7) -> DataFrame:
    """Drop in balanced accuracy when one column is shuffled."""
    def acc(d: DataFrame, name: str) -> DataFrame:
        s = score(d).withColumns({"pred": argmax_array(F.col("probability")), "_y": F.col(label).cast("int")})
        return balanced_accuracy(s, "_y", "pred").select(F.lit(name).alias("feature"), "score")

    rows = union_all([acc(valid, "(none)"), *[acc(shuffled_column(valid, key, f, seed), f) for f in features]])
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("m"))
    return one.select("m", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")).select(
        "feature", r6(F.col("m")["(none)"]).alias("base"), r6(F.col("m")["(none)"] - F.col("m")[F.col("feature")]).alias("drop"))


def stack(parts: dict[str, DataFrame], key: Sequence[str], label: str, n_classes: int, k: int, fold: str = "fold") -> DataFrame:
    """Out-of-fold logistic meta-model over the base models' out-of-fold probabilities."""
    base, cols = None, []
    for name, p in parts.items():
        mine = [f"{name}_{c}" for c in range(n_classes)]
        cols += mine
        x = p.select(*key, fold, label, *[F.get("probability", F.lit(c)).alias(m) for c, m in enumerate(mine)])
        base = x if base is None else base.join(x.drop(fold, label), list(key))
    base = base.persist()
    return out_of_fold(base, key, label, k, logistic(cols, label), fold)[0]


def seed_average(df: DataFrame, key: Sequence[str], label: str, k: int, models: Sequence[Model], n_classes: int,
                 fold: str = "fold") -> DataFrame:
    """Mean out-of-fold probabilities over several seeds."""
    avg = average_probabilities([out_of_fold(df, key, label, k, m, fold)[0] for m in models], key, n_classes)
    return df.select(*key, fold, label).join(avg, list(key))


def adversarial_auc(train: DataFrame, test: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                    k: int = 5, ordinal: bool = False, max_iter: int = 10) -> DataFrame:
    """Out-of-fold AUC of a linear model telling train rows from test rows; identifiers and target stay out."""
    cols = [*key, *numeric, *categorical]
    both = train.select(*cols, F.lit(0.0).alias("is_test")).unionByName(test.select(*cols, F.lit(1.0).alias("is_test")))
    both = stratified_folds(both, key, "is_test", k).persist()
    num, cat = list(numeric), list(categorical)
    if ordinal and cat:
        m = Pipeline(stages=[StringIndexer(inputCol=c, outputCol=f"{c}__o", stringOrderType="alphabetAsc", handleInvalid="keep") for c in cat]).fit(both)
        both, num, cat = m.transform(both), num + [f"{c}__o" for c in cat], []
    model = logistic(num, "is_test", cat, max_iter, weight=None)
    parts = []
    for i in range(k):
        score = model(both.where(F.col("fold") != i))
        parts.append(score(both.where(F.col("fold") == i)).select(F.get("probability", F.lit(1)).alias("p"), "is_test"))
    oof = union_all(parts).persist()
    return shift_decision(roc_auc(oof, "p", F.col("is_test") == 1.0))


def shift_decision(auc: DataFrame, ok: float = 0.55, investigate: float = 0.6) -> DataFrame:
    """No shift up to 0.55, investigate above 0.6."""
    a = F.col("auc")
    return auc.withColumn("decision", F.when(a <= ok, "ok").when(a > investigate, "investigate").otherwise("watch"))
