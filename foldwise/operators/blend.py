"""Probability post-processing: blends, weight search, ordinal decoding and decision rules.

Candidate searches expand a short literal grid per row and reduce it at once to
(candidate, fold, class) counts, so the shuffle carries only that count table.
Every later step, nested selection included, reads the counts and not the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import argmax_columns, r6, total
from foldwise.operators.lookup import attach, keep
from foldwise.operators.ranks import long_form, value_ranks

GRID_STEPS = 12  # Fixed value: simplex resolution; a multiple of the number of models keeps equal weights on the grid.


def check_weights(weights: Sequence[float], n: int) -> list[float]:
    """Normalised weights, or an error for a wrong length, a negative weight or a zero sum."""
    if n == 0:
        raise ValueError("a blend needs at least one model")
    if len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} models")
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    if sum(weights) == 0:
        raise ValueError("weights sum to zero")
    return [w / sum(weights) for w in weights]


def blend_columns(models: Sequence[Sequence[Column]], weights: Sequence[float | Column] | None = None) -> list[Column]:
    """Weighted mean probability per class, renormalised over the row; missing where a row's probabilities sum to zero."""
    if not models:
        raise ValueError("a blend needs at least one model")
    if len({len(m) for m in models}) != 1:
        raise ValueError("models must have the same classes")
    if weights is None:
        weights = [1.0] * len(models)
    if all(not isinstance(w, Column) for w in weights):
        weights = check_weights(weights, len(models))
    ws = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    raw = [total([w * m[c] for w, m in zip(ws, models)]) for c in range(len(models[0]))]
    s = total(raw)
    return [F.try_divide(r, s) for r in raw]


def soft_blend(df: DataFrame, models: Sequence[str], weights: Sequence[float] | None = None, n_classes: int = 3,
               out: str = "p_blend") -> DataFrame:
    """Blend array columns of class probabilities."""
    cols = blend_columns([[F.col(m)[i] for i in range(n_classes)] for m in models], weights)
    return df.withColumn(out, F.array(*cols))


def decode_label(p: Column, labels: Sequence[str]) -> Column:
    """Label of the first maximum."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def simplex(n_models: int, steps: int = GRID_STEPS) -> list[tuple[int, ...]]:
    """Integer weight vectors with a fixed sum, in lexicographic order."""
    return [v for v in product(range(steps + 1), repeat=n_models) if sum(v) == steps]


def candidate_counts(df: DataFrame, candidates: Sequence[tuple], names: Sequence[str], class_scores, y: str,
                     fold: str = "fold", weight: Column | None = None) -> DataFrame:
    """hits and n per (candidate, fold, class). `weight` is how many rows a row stands for, one by default.

    `class_scores` maps the candidate's columns to one score column per class; the
    first maximum is the prediction. The grid is a literal array exploded in the
    scan stage and counted map-side.
    """
    grid = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, cand)]) for cand in candidates])
    rows = df.withColumn("_g", F.explode(grid))
    scores = class_scores([F.col("_g")[n] for n in names])
    weight = F.lit(1) if weight is None else weight
    pre = rows.select(*[F.col("_g")[n].alias(n) for n in names], fold, y,
                      (argmax_columns(scores) == F.col(y)).cast("bigint").alias("_hit"), weight.cast("bigint").alias("_n"))
    return pre.groupBy(*names, fold, y).agg(F.sum(F.col("_hit") * F.col("_n")).alias("hits"), F.sum("_n").alias("n"))


def blend_counts(df: DataFrame, models: Sequence[Sequence[str]], y: str, fold: str = "fold", steps: int = GRID_STEPS) -> DataFrame:
    """Counts for every blend weight on the simplex; columns w0, w1, ... hold the weights. Rows with the same probabilities are blended once."""
    names = [f"w{i}" for i in range(len(models))]
    cands = [tuple(v / steps for v in c) for c in simplex(len(models), steps)]
    mats = [[F.col(c) for c in m] for m in models]
    same = df.groupBy(fold, y, *dict.fromkeys(c for m in models for c in m)).agg(F.count(F.lit(1)).alias("_rows"))
    return candidate_counts(same, cands, names, lambda w: blend_columns(mats, w), y, fold, F.col("_rows"))


def _distance(names: Sequence[str], centre: float) -> Column:
    return total([(F.col(n) - centre) * (F.col(n) - centre) for n in names])


def surface(counts: DataFrame, names: Sequence[str], y: str) -> DataFrame:
    """Balanced accuracy of each candidate over all folds."""
    per = counts.groupBy(*names, y).agg((F.sum("hits") / F.sum("n")).alias("recall"))
    return per.groupBy(*names).agg(F.avg("recall").alias("score"))


def best_candidate(scored: DataFrame, names: Sequence[str], centre: float, by: Sequence[str] = ()) -> DataFrame:
    """Highest score; ties within 1e-12 go to the candidate nearest the neutral one, then to the smallest vector."""
    top = scored.groupBy(*by).agg(F.max_by(
        F.struct(*names, "score"),
        F.struct(F.round("score", 12), -F.round(_distance(names, centre), 12), *[-F.col(n) for n in names])).alias("b"))
    return top.select(*by, *[F.col(f"b.{n}").alias(n) for n in names], F.col("b.score").alias("score"))


def nested_selection(counts: DataFrame, names: Sequence[str], y: str, centre: float, k: int, fold: str = "fold") -> DataFrame:
    """For each fold: the candidate chosen on the other folds, and its score on this fold.

    Inner counts are the class totals minus the fold's own counts, so one count
    table serves every fold.
    """
    # Per candidate and class: totals and a map with at most k folds.
    per = counts.groupBy(*names, y).agg(F.sum("hits").alias("h_all"), F.sum("n").alias("n_all"), F.map_from_entries(
        F.collect_list(F.struct(F.col(fold), F.struct("hits", "n")))).alias("m"))
    grid = per.select(*names, y, "h_all", "n_all", "m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
    own = F.try_element_at("m", F.col(fold))
    h, n = F.coalesce(own["hits"], F.lit(0)), F.coalesce(own["n"], F.lit(0))
    sides = grid.select(*names, fold, F.try_divide(F.col("h_all") - h, F.col("n_all") - n).alias("inner"), F.try_divide(h * 1.0, n).alias("outer"))
    scored = sides.groupBy(*names, fold).agg(F.avg("inner").alias("score"), F.avg("outer").alias("held_out"))
    best = scored.groupBy(fold).agg(F.max_by(
        F.struct(*names, "score", "held_out"),
        F.struct(F.round("score", 12), -F.round(_distance(names, centre), 12), *[-F.col(x) for x in names])).alias("b"))
    return best.select(fold, *[F.col(f"b.{x}").alias(x) for x in names], F.col("b.score").alias("inner_score"),
                       F.col("b.held_out").alias("score"))


def softmax(scores: DataFrame, score: str, temperature: float = 1.0, out: str = "weight") -> DataFrame:
    """exp((s - max) / T), normalised, over a table with one row per model."""
    w = Window.partitionBy(F.lit(0))
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_array(s: Column, temperature: float) -> Column:
    """Temperature softmax of an array of class scores."""
    m = F.array_max(s)
    e = F.transform(s, lambda v: F.exp((v - m) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def expected_value(p: Sequence[Column]) -> Column:
    """Mean class index under the probabilities."""
    return total([F.lit(float(i)) * c for i, c in enumerate(p)])


def digitise(x: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds not above x."""
    return total([(x >= t).cast("int") for t in sorted(thresholds)])


def ordinal_decode(p: Sequence[Column], thresholds: Sequence[float]) -> Column:
    """Class from the expected value, or the argmax when there are no thresholds."""
    return digitise(expected_value(p), thresholds) if len(thresholds) else argmax_columns(p)


def ordered_optimum(cells: dict[tuple[int, int], float], n_classes: int, scale: int) -> tuple[list[int], float]:
    """Ordered positions p_0 <= p_1 <= ... over the whole observed range that maximise kappa, and that kappa; a row of bin b is above p if b >= p.

    With ordered thresholds the cost and the chance cost of kappa are both constants plus one term for each threshold. For a fixed ratio of the two the best
    positions come from prefix minima, one pass over the bins for each threshold; the ratio they have is taken next, until it stands. Ties go to the
    positions nearest to the midpoints between classes, then to the smallest.
    """
    lo, hi = min(b for b, _ in cells), max(b for b, _ in cells) + 1
    size, top = hi - lo + 1, n_classes - 1
    n, sy, sy2 = sum(cells.values()), sum(c * y for (_, y), c in cells.items()), sum(c * y * y for (_, y), c in cells.items())
    cost, chance = [[0.0] * size for _ in range(top)], [[0.0] * size for _ in range(top)]
    below = [[0.0] * n_classes for _ in range(size)]
    for (b, y), c in cells.items():
        below[b - lo + 1][y] += c
    for i in range(1, size):
        for y in range(n_classes):
            below[i][y] += below[i - 1][y]
    for m in range(top):
        for i in range(size):
            moved = sum(below[i])
            cost[m][i] = sum(c * ((y - m) ** 2 - (y - m - 1) ** 2) for y, c in enumerate(below[i]))
            chance[m][i] = moved * (m * m - (m + 1) ** 2) + 2.0 * sy * moved / n
    whole_cost = sum(c * (y - top) ** 2 for (_, y), c in cells.items())
    whole_chance = sy2 + n * top * top - 2.0 * sy * top
    middle = [round((m + 0.5) * scale) - lo for m in range(top)]
    ratio, chosen = 1.0, None
    for _ in range(100):
        best: list[tuple] = [(0.0, 0, ())] * size
        for m in range(top):
            least, row = None, []
            for i in range(size):
                least = best[i] if least is None else min(least, best[i])
                value = least[0] + cost[m][i] - ratio * chance[m][i]
                row.append((round(value, 6), least[1] + (i - middle[m]) ** 2, (*least[2], i)))
            best = row
        found = min(best)[2]
        above = whole_cost + sum(cost[m][i] for m, i in enumerate(found))
        under = whole_chance + sum(chance[m][i] for m, i in enumerate(found))
        now = above / under if under else 0.0
        if found == chosen or now >= ratio and chosen is not None:
            break
        chosen, ratio = found, now
    return [i + lo for i in chosen], 1.0 - ratio


def ordinal_thresholds(df: DataFrame, expected: Column, argmax: Column, y: Column, n_classes: int, step: float = 0.1) -> DataFrame:
    """Decision thresholds on the expected value that maximise quadratic weighted kappa, one row; none for an empty table.

    The rows are reduced once to counts of (bin, class), which are as many as classes times bins of the expected value's range. Every threshold can lie
    anywhere in the observed range. The argmax is kept when nothing beats it. Rows without an expected value or a class are left out.
    """
    scale = round(1 / step)
    # Floor in units of the step; the small shift keeps a value that sits on a grid point in its own bin.
    b = F.floor(expected * scale + 1e-9).cast("int")
    base = df.select(b.alias("b"), y.cast("int").alias("y"), argmax.cast("int").alias("a")).dropna(subset=["b", "y"])
    a, c = F.col("a"), F.col("y")
    cells = base.groupBy("b", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((a - c) * (a - c)).cast("double").alias("da"), F.sum("a").cast("double").alias("sa"),
                                       F.sum(a * a).cast("double").alias("sa2")).collect()
    names = [f"t{m + 1}" for m in range(n_classes - 1)]
    schema = ", ".join([*(f"{n} double" for n in names), "qwk double, argmax_qwk double, use_thresholds boolean"])
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    at, q = ordered_optimum({(r["b"], r["y"]): r["n"] for r in cells}, n_classes, scale)
    n, sy, sy2 = sum(r["n"] for r in cells), sum(r["n"] * r["y"] for r in cells), sum(r["n"] * r["y"] ** 2 for r in cells)
    da, sa, sa2 = (sum(r[k] or 0.0 for r in cells) for k in ("da", "sa", "sa2"))
    under = sy2 + sa2 - 2.0 * sy * sa / n
    base_q = 1.0 - da / under if under else None
    row = (*(round(p * step, 6) for p in at), q, base_q, base_q is None or q > base_q)
    return df.sparkSession.createDataFrame([row], schema).withColumns({k: r6(F.col(k)) for k in ("qwk", "argmax_qwk")})


def multiplier_grid(n_classes: int, values: Sequence[float]) -> list[tuple[float, ...]]:
    """Class multipliers with the first class fixed at one."""
    return [(1.0, *v) for v in product(values, repeat=n_classes - 1)]


def multiplier_counts(df: DataFrame, probs: Sequence[str], y: str, values: Sequence[float], fold: str = "fold") -> DataFrame:
    """Counts for every vector of class multipliers m0, m1, ..."""
    names = [f"m{i}" for i in range(len(probs))]
    return candidate_counts(df, multiplier_grid(len(probs), values), names,
                            lambda m: [F.col(p) * w for p, w in zip(probs, m)], y, fold)


def rank_average(df: DataFrame, scores: Sequence[str], out: str = "rank_score") -> DataFrame:
    """Mean over models of average rank / n."""
    ranks = keep(value_ranks(long_form(df, scores), "value", ["feature"], per="feature"))
    parts = []
    for i, s in enumerate(scores):
        r = ranks.where(F.col("feature") == s).select(F.col("value").alias(s), (F.col("avg_rank") / F.col("n_total")).alias(f"_r{i}"))
        df = attach(df, r, [s])
        parts.append(F.col(f"_r{i}"))
    return df.withColumn(out, total(parts) / len(parts)).drop(*[f"_r{i}" for i in range(len(parts))])


def linear_contributions(df: DataFrame, coefs: dict[str, dict[str, float]], fit: DataFrame | None = None) -> DataFrame:
    """Mean absolute contribution coef * (x - mean) per class and feature, with the mean over classes."""
    base = fit if fit is not None else df
    feats = sorted({f for c in coefs.values() for f in c})
    means = base.agg(F.struct(*[F.avg(f).alias(f) for f in feats]).alias("m")).scalar()
    one = df.agg(*[F.avg(F.abs(F.col(f) - means[f])).alias(f) for f in feats])
    cells = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(f).alias("feature"), (F.abs(F.lit(float(v))) * F.col(f)).alias("v"))
                      for k, c in coefs.items() for f, v in c.items()])
    per = one.select(F.explode(cells).alias("c")).select("c.*")
    return per.select("class", "feature", r6(F.col("v")).alias("mean_abs"), r6(F.avg("v").over(Window.partitionBy("feature"))).alias("global_abs"))
