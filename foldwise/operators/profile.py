"""Data profiling: null accounting, distributions, per-class summaries, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import clip_high, kurt_corrected, missing, present, r6, skew_corrected, total
from foldwise.operators.lookup import sized
from foldwise.operators.ranks import long_form, quantile_cells, quantiles


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, from one aggregation."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(missing(F.col(c), types[c])).alias(c) for c in cols])
    return (one.unpivot(["_n"], cols, "column_name", "n_null")
            .select("column_name", "n_null", r6(F.coalesce(F.try_divide(F.col("n_null") * 100.0, F.col("_n")), F.lit(0.0))).alias("pct_null")))


def missing_rate_by(df: DataFrame, label: str, conds: dict[str, Column]) -> DataFrame:
    """Share of rows per class for which a missing / not-recorded condition holds."""
    one = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"),
                                *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in conds.items()])
    return (one.unpivot([label, "n_rows"], list(conds), "column_name", "_r")
            .select(label, "n_rows", "column_name", r6(F.col("_r")).alias("rate")))


def repeated_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with `count`. Hashes are counted first, and only rows whose hash repeats are shuffled whole."""
    h = F.xxhash64(*df.columns)
    often = df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    suspects = df.withColumn("_h", h).join(sized(often), "_h", "left_semi").drop("_h")
    return suspects.groupBy(*df.columns).count().where("count > 1")


def quality_report(df: DataFrame, label: str) -> DataFrame:
    """Tidy (metric, label, value) rows: size, nulls, duplicate rows, class counts and shares, imbalance."""
    types = dict(df.dtypes)
    base = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.lit(float(len(df.columns))).alias("columns"),
                  F.sum(total([missing(F.col(c), types[c]).cast("int") for c in df.columns])).cast("double").alias("nulls"))
    dup = repeated_rows(df).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("duplicate_rows"))
    classes = class_distribution(df, label)
    imb = classes.agg(F.round(F.max("n") / F.min("n"), 4).alias("imbalance"))
    none = F.lit(None).cast("string").alias("label")

    def tidy(d, cols):
        return d.unpivot([], cols, "metric", "value").select("metric", none, "value")

    out = tidy(base, ["rows", "columns", "nulls"]).unionByName(tidy(dup, ["duplicate_rows"])).unionByName(tidy(imb, ["imbalance"]))
    cls = classes.select(F.col(label).cast("string").alias("label"),
                         F.explode(F.array(F.struct(F.lit("class_count").alias("metric"), F.col("n").cast("double").alias("value")),
                                           F.struct(F.lit("class_share").alias("metric"), F.col("share").alias("value")))).alias("s"))
    return out.unionByName(cls.select("s.metric", "label", "s.value"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class among non-missing labels."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, so the unpartitioned window sees only the class table.
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", r6(F.col("n") / whole).alias("share"))


def numeric_by_class(df: DataFrame, value: str, label: str) -> DataFrame:
    """count, mean, median, sample std, 5 % and 95 % quantiles, min and max of one column per class."""
    basic = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df.select(label, F.col(value).cast("double").alias(value)), value,
                  {"q05": 0.05, "median": 0.5, "q95": 0.95}, [label])
    return basic.join(q, label, "left").select(
        label, "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "q05", "q95", "min", "max")])


def feature_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of many columns in one pass over an unpivoted frame."""
    lf = long_form(df, cols, by)
    return quantiles(lf, "value", probs, ["feature", *by], per="feature")


def median_matrix(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Class x feature medians in long form."""
    q = feature_quantiles(df, cols, {"median": 0.5}, [label])
    return q.select(label, "feature", r6(F.col("median")).alias("median"))


def crosstab_normalised(df: DataFrame, row: str, label: str, labels: Sequence[str], scale: float = 1.0,
                        digits: int = 4) -> DataFrame:
    """Row-normalised contingency table in a fixed class order, absent cells as zero."""
    base = df.where(F.col(row).isNotNull() & F.col(label).isNotNull())
    cells = base.groupBy(row).agg(F.count(F.lit(1)).alias("n_rows"),
                                  *[F.count_if(F.col(label) == v).alias(f"_{i}") for i, v in enumerate(labels)])
    return cells.select(row, "n_rows", *[F.round(F.col(f"_{i}") * scale / F.col("n_rows"), digits).alias(str(v))
                                         for i, v in enumerate(labels)])


def rater_table(df: DataFrame, rater: str, value: str, min_rows: int = 100) -> DataFrame:
    """Mean, sample std and count per rater with enough rows."""
    return (df.where(F.col(rater).isNotNull()).groupBy(rater)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
            .where(F.col("n") >= min_rows)
            .select(rater, "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std")))


def group_gap(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Lowest and highest group mean, their gap and the number of groups, per grouping column."""
    lf = df.select(*[F.col(g).cast("string").alias(g) for g in groups], F.col(value).cast("double").alias("_v")
                   ).unpivot(["_v"], list(groups), "dimension", "level")
    means = lf.where("level is not null").groupBy("dimension", "level").agg(F.avg("_v").alias("m"))
    return means.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_groups"), r6(F.min("m")).alias("lowest"), r6(F.max("m")).alias("highest"),
        r6(F.max("m") - F.min("m")).alias("gap"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column; exact through two aggregations, or sketched."""
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot([], list(cols), "column_name", "n_distinct")
    lf = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
    seen = lf.where("v is not null").groupBy("column_name", "v").agg(F.lit(1).alias("_one"))
    return seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def univariate_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, sample std, corrected skewness and excess kurtosis, null share per column."""
    lf = long_form(df, cols)
    m = lf.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))
    n = F.col("n").cast("double")
    m = m.select("feature", "n", "mean", "std", skew_corrected(F.col("_g1"), n).alias("skew"),
                 kurt_corrected(F.col("_g2"), n).alias("kurtosis"), ((F.col("_rows") - n) / F.col("_rows")).alias("null_share"))
    q = quantiles(lf, "value", {"median": 0.5}, ["feature"], per="feature")
    return m.join(q.select("feature", "median"), "feature", "left").select(
        "feature", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "skew", "kurtosis", "null_share")])


def normality(df: DataFrame, cols: Sequence[str], min_rows: int = 8) -> DataFrame:
    """D'Agostino-Pearson omnibus test from moments over all rows; a feature with fewer values keeps its row, with statistics missing."""
    s = long_form(df, cols).groupBy("feature").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("g1"), (F.kurtosis("value") + 3).alias("b2"))
    s = s.withColumn("n_enough", F.when(F.col("n") >= min_rows, F.col("n")))
    n, g1, b2 = F.col("n_enough"), F.col("g1"), F.col("b2")
    # Skewness transformed to a normal score.
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    s = s.withColumns({"w2": w2, "y": y})
    a = F.sqrt(2 / (F.col("w2") - 1))
    z1 = F.log(F.col("y") / a + F.sqrt(F.pow(F.col("y") / a, F.lit(2.0)) + 1)) / F.sqrt(0.5 * F.log(F.col("w2")))
    # Kurtosis transformed to a normal score.
    e = 3.0 * (n - 1) / (n + 1)
    v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    sq = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s = s.withColumns({"z1": z1, "x": (b2 - e) / F.sqrt(v),
                       "A": 6.0 + 8.0 / sq * (2.0 / sq + F.sqrt(1 + 4.0 / (sq * sq)))})
    s = s.withColumn("d", 1 + F.col("x") * F.sqrt(2.0 / (F.col("A") - 4)))
    t = F.signum("d") * F.pow((1 - 2.0 / F.col("A")) / F.abs("d"), F.lit(1.0 / 3.0))
    z2 = (1 - 2.0 / (9.0 * F.col("A")) - t) / F.sqrt(2.0 / (9.0 * F.col("A")))
    s = s.withColumn("k2", F.col("z1") * F.col("z1") + z2 * z2)
    return s.select("feature", F.col("n").cast("bigint").alias("n"), F.round("k2", 4).alias("k2"), r6(F.exp(-F.col("k2") / 2)).alias("p_value"))


def histogram(df: DataFrame, value: str, bins: int = 80, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the observed range; the maximum belongs to the last bin. NULL and NaN are in no bin."""
    v = present(F.col(value))
    rng = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
    w = (rng["hi"] - rng["lo"]) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(v - rng["lo"], w)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "bin", r6(rng["lo"] + F.col("bin") * w).alias("left_edge"), "n")


def integer_density(df: DataFrame, value: str, by: str) -> DataFrame:
    """Share of each integer value inside its class."""
    c = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, F.floor(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(by).agg(F.sum("n").alias("_t"))
    return c.join(t, by).select(by, "bin", "n", r6(F.col("n") / F.col("_t")).alias("density"))


def box_stats(df: DataFrame, value: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values within the fences) and outlier count per class."""
    src = df.select(by, F.col(value).cast("double").alias(value)).dropna()
    q = quantiles(src, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    lo = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    fenced = q.select(by, "q1", "median", "q3", lo.alias("_lo"), hi.alias("_hi"))
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    stats = src.join(sized(fenced), by).groupBy(by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    return stats.select(by, "n", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


def clipped_histogram(df: DataFrame, value: str, by: str, upper: float = 0.99, bins: int = 80) -> DataFrame:
    """Histogram per class after clipping at a high quantile of all values."""
    src = df.select(by, F.col(value).cast("double").alias(value))
    cap = quantile_cells(src, value, [upper])[0]
    return histogram(src.withColumn(value, clip_high(F.col(value), cap)), value, bins, [by])


def duplicate_report(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Extra copies and duplicated groups inside train, and distinct rows present in both splits.

    Both splits are counted in one grouping, so copies never multiply.
    """
    both = train.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        test.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = both.groupBy(*cols).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return g.agg(F.coalesce(F.sum(F.greatest(F.col("a") - 1, F.lit(0))), F.lit(0)).alias("extra_rows"),
                 F.count_if(F.col("a") > 1).alias("duplicated_groups"),
                 F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("cross_split"))


def cross_split_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct feature rows present in both splits, as rows."""
    return train.select(*cols).intersect(test.select(*cols))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by an order; a mergeable minimum, so a hot key is never sorted in one task."""
    rest = [c for c in df.columns if c not in set(keys)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def group_text_rollup(df: DataFrame, group: str, text: str, target: str) -> DataFrame:
    """Count, mean target and mean text length per text group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col(target).cast("double"))).alias("mean_target"),
        r6(F.avg(F.length(F.coalesce(F.col(text), F.lit(""))).cast("double"))).alias("mean_chars"))
