"""Association, leakage and drift statistics, all from counts or moments over every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import nln, present, r6
from foldwise.operators.lookup import attach, keep
from foldwise.operators.ranks import bucket_of, long_form, quantile_table, value_ranks


def _pearson(x: str, y: str) -> Column:
    """Pearson over rows where both are present; missing when one side is constant."""
    bx = F.when(F.col(y).isNotNull(), F.col(x))
    by = F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(bx) * F.stddev_pop(by))


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Symmetric k x k correlation table from one aggregation over the pairs."""
    cols = list(cols)
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = num.agg(*[_pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
                  *[(F.count(c) > 0).alias(f"d{i}") for i, c in enumerate(cols)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [(a, b, F.col(f"p{i}")), (b, a, F.col(f"p{i}"))]
    cells += [(c, c, F.when(F.col(f"d{i}"), F.lit(1.0))) for i, c in enumerate(cols)]
    arr = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r6(v).alias("r")) for a, b, v in cells])
    return one.select(F.explode(arr).alias("c")).select("c.*")


def ranked_columns(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank, one (key, feature, rank) row per cell."""
    lf = long_form(df, cols, key)
    ranks = value_ranks(lf, "value", ["feature"], per="feature")
    return lf.join(ranks.select("feature", "value", "avg_rank"), ["feature", "value"])


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Spearman = Pearson over average ranks.

    Ranks come from distinct values with running totals. They are attached per
    column; a value held by very many rows is a skewed join key that adaptive
    execution splits, or the rank table is broadcast after its size is checked.
    """
    out = df.select(*key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=list(cols))
    ranks = keep(value_ranks(long_form(out, cols), "value", ["feature"], per="feature"))
    for c in cols:
        one = ranks.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("avg_rank").alias(f"{c}__r"))
        out = attach(out, one, [c])
    return pearson_matrix(out.select(*[F.col(f"{c}__r").alias(c) for c in cols]), cols)


def target_correlation(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson of each feature with the target, pairwise complete, strongest first."""
    t = F.col(target).cast("double")
    lf = long_form(df.withColumn("_t", t), cols, ["_t"])
    c = lf.groupBy("feature").agg(F.count_if(F.col("value").isNotNull() & F.col("_t").isNotNull()).alias("n"),
                                  _pearson("value", "_t").alias("r"))
    return c.select("feature", "n", r6(F.col("r")).alias("r"), r6(F.abs("r")).alias("abs_r")).orderBy(
        F.col("abs_r").desc_nulls_last(), "feature")


def entropy(df: DataFrame, label: str) -> DataFrame:
    """Shannon entropy of a label in nats, zero for an empty input."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.sum("n").alias("n"), F.sum(nln(F.col("n"))).alias("s"))
    h = F.when(F.col("n") > 0, F.ln("n") - F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    return s.select(F.coalesce("n", F.lit(0)).alias("n"), r6(F.greatest(h, F.lit(0.0))).alias("h_nats"))


def joint_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value, target, n) counts of several categorical columns in one shuffle."""
    lf = df.select(F.col(target).alias("_y"), *[F.col(f).cast("string").alias(f) for f in features]
                   ).unpivot(["_y"], list(features), "feature", "value")
    return lf.where("value is not null and _y is not null").groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("n"))


def association(joint: DataFrame, yates: bool = False) -> DataFrame:
    """Mutual information, entropies and bias-corrected Cramer's V per feature from joint counts.

    The window over (feature, value) holds at most one row per class. With `yates`
    the continuity correction is applied to 2 x 2 tables.
    """
    joint = keep(joint)
    w = Window.partitionBy("feature", "value")
    cells = joint.withColumns({"nx": F.sum("n").over(w), "first_x": F.row_number().over(w.orderBy("_y")) == 1})
    per_y = joint.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    n_all = per_y.groupBy("feature").agg(F.sum("ny").alias("n_all"), F.count(F.lit(1)).alias("k"),
                                         F.sum(nln(F.col("ny"))).alias("sy"))
    cells = attach(cells, per_y.join(n_all, "feature"), ["feature", "_y"], "inner")
    nx, ny, n, tot = F.col("nx"), F.col("ny"), F.col("n"), F.col("n_all")
    expected = nx.cast("double") * ny / tot
    off = F.abs(n - expected)
    s = cells.groupBy("feature").agg(
        F.max("n_all").cast("double").alias("n"), F.max("k").cast("double").alias("k"), F.max("sy").alias("sy"),
        F.sum(F.when(F.col("first_x"), F.lit(1.0)).otherwise(0.0)).alias("r"),
        F.sum(nln(n)).alias("sxy"), F.sum(F.when(F.col("first_x"), nln(nx)).otherwise(0.0)).alias("sx"),
        F.sum(n.cast("double") * n / (nx.cast("double") * ny)).alias("q"),
        F.sum(F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) / expected).alias("chi_yates"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi2 = F.col("q") - 1
    if yates:
        phi2 = F.when((r == 2) & (k == 2), F.col("chi_yates") / n).otherwise(phi2)
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((k - 1) * (r - 1), n - 1))
    rc = r - F.try_divide((r - 1) * (r - 1), n - 1)
    kc = k - F.try_divide((k - 1) * (k - 1), n - 1)
    den = F.least(kc - 1, rc - 1)
    v = F.when((r > 1) & (k > 1) & (den > 0), F.sqrt(phi2c / den)).otherwise(F.lit(0.0))
    mi = F.greatest(F.lit(0.0), F.ln(n) + (F.col("sxy") - F.col("sx") - F.col("sy")) / n)
    return s.select("feature", n.cast("bigint").alias("n"), r.cast("bigint").alias("n_values"),
                    (F.ln(n) - F.col("sy") / n).alias("h_target"), mi.alias("mi"), v.alias("cramers_v"))


def effect_band(v: Column) -> Column:
    """Effect-size bands 0.1 / 0.3 / 0.5."""
    return (F.when(v.isNull(), "n/a").when(v < 0.1, "negligible").when(v < 0.3, "small")
            .when(v < 0.5, "medium").otherwise("large"))


def equal_width_bin(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed equal-width bins over the observed range, lowest value included. NULL and NaN have no bin."""
    v = present(F.col(value))
    rng = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
    width = (rng["hi"] - rng["lo"]) / bins
    pos = F.when(v.isNotNull(), F.coalesce(F.ceil(F.try_divide(v - rng["lo"], width)), F.lit(1)))
    return df.withColumn(out, F.when(pos.isNotNull(), F.least(F.greatest(pos, F.lit(1)), F.lit(bins)).cast("int") - 1))


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int, suffix: str = "__bin") -> DataFrame:
    """Bins cut at exact quantiles: the number of edges below the value. Edges of all columns come from one pass."""
    edges = quantile_table(df, cols, [i / bins for i in range(1, bins)])
    below = lambda c: F.when(F.col(c).isNotNull(), bucket_of(F.col(c).cast("double"), sorted(set(edges[c])), strict=True))
    return df.withColumns({f"{c}{suffix}": below(c) for c in cols})


def leakage_audit(df: DataFrame, target: str, categorical: Sequence[str] = (), numeric: Sequence[str] = (),
                  id_col: str | None = None, numeric_bins: int = 32, id_bins: int = 256,
                  review_at: float = 0.95) -> DataFrame:
    """One row per feature: MI, MI / H(target), Cramer's V with its band, and a verdict."""
    work, cols = df, list(categorical)
    if numeric:
        work = quantile_bins(work, numeric, numeric_bins)
    if id_col:
        work = equal_width_bin(work, id_col, id_bins, f"{id_col}__bin")
    binned = {f"{c}__bin": c for c in [*numeric, *([id_col] if id_col else [])]}
    a = association(joint_counts(work, [*cols, *binned], target))
    name = F.col("feature")
    for b, c in binned.items():
        name = F.when(F.col("feature") == b, c).otherwise(name)
    is_cat = F.col("feature").isin(*cols) if cols else F.lit(False)
    share = F.coalesce(F.try_divide(F.col("mi"), F.col("h_target")), F.lit(0.0))
    v = F.when(is_cat, F.col("cramers_v"))
    verdict = (F.when(F.col("feature") == f"{id_col}__bin", "DROP").when(share >= review_at, "REVIEW").otherwise("USE"))
    return a.select(name.alias("feature"), r6(F.col("mi")).alias("mi_nats"), r6(share).alias("mi_fraction"),
                    r6(v).alias("cramers_v"), effect_band(v).alias("band"), verdict.alias("verdict"))


def deterministic_values(df: DataFrame, features: Sequence[str], target: str, floor: float = 0.99,
                         min_support: int = 1) -> DataFrame:
    """Largest class share per feature value; a value that fixes the class is flagged."""
    j = joint_counts(df, features, target)
    g = j.groupBy("feature", "value").agg(F.sum("n").alias("support"), F.max("n").alias("_m"),
                                          F.min(F.struct((-F.col("n")).alias("neg"), F.col("_y").alias("y"))).alias("_s"))
    share = F.col("_m") / F.col("support")
    return g.select("feature", "value", "support", F.col("_s.y").alias("top_class"), r6(share).alias("max_share"),
                    ((share >= floor) & (F.col("support") >= min_support)).alias("flagged"))


def ks_drift(train: DataFrame, test: DataFrame, cols: Sequence[str], limit: float = 0.05, terms: int = 20) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column with the asymptotic p-value, largest first."""
    both = train.select(*cols, F.lit(0).alias("_s")).unionByName(test.select(*cols, F.lit(1).alias("_s")))
    t = value_ranks(long_form(both, cols, ["_s"]), "value", ["feature"],
                    {"a": F.count_if(F.col("_s") == 0), "b": F.count_if(F.col("_s") == 1)}, per="feature")
    fa = F.try_divide(F.col("a_before") + F.col("a"), F.col("a_total"))
    fb = F.try_divide(F.col("b_before") + F.col("b"), F.col("b_total"))
    d = t.groupBy("feature").agg(F.max(F.abs(fa - fb)).alias("d"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"))
    lam = F.col("d") * F.col("d") * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    p = F.lit(0.0)
    for j in range(1, terms + 1):
        p = p + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam)
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    # Below this distance the alternating series has not converged and p is one to many digits.
    p = F.when(lam < 0.04, F.lit(1.0)).otherwise(p)
    return d.select("feature", "n1", "n2", r6(F.col("d")).alias("ks"), r6(p).alias("p_value"),
                    (F.col("d") > limit).alias("drift")).orderBy(F.col("ks").desc(), "feature")


def kruskal_wallis(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Tie-corrected H per column over the classes, with epsilon squared."""
    lf = long_form(df.where(F.col(label).isNotNull()), cols, [label]).where("value is not null")
    per = keep(lf.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("m")))
    ranks = value_ranks(per, "value", ["feature"], {"n": F.sum("m")}, per="feature")
    ties = ranks.groupBy("feature").agg(
        F.max("n_total").cast("double").alias("n"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("t"))
    sums = (per.join(ranks.select("feature", "value", "avg_rank"), ["feature", "value"])
            .groupBy("feature", label).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("avg_rank")).alias("rs")))
    q = sums.groupBy("feature").agg(F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k"))
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3.0 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("t") / (F.pow(n, F.lit(3.0)) - n))
    return q.join(ties, "feature").select("feature", n.cast("bigint").alias("n"), "k", F.round(h, 4).alias("h"),
                                          r6(F.try_divide(h, n - 1)).alias("epsilon_sq"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with ties counted half (Mann-Whitney)."""
    t = value_ranks(df, score, by, {"pos": F.count_if(positive), "neg": F.count_if(~positive)})
    u = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    a = t.groupBy(*by).agg(u.alias("u"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))
    return a.select(*by, "n_pos", "n_neg", r6(F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))
