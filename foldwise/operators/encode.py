"""Imputers and encoders with an explicit fit side.

Every fitted table is an aggregation over the fit frame, attached by a checked
join. No window runs over a category, so a category holding a third of the rows
is reduced map-side before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import total
from foldwise.operators.lookup import attach, keep, sized
from foldwise.operators.ranks import bucket_of, quantile_cells, quantiles, running_totals, text_cuts, value_ranks


def group_medians(fit: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return quantiles(fit.select(*keys, F.col(value).cast("double").alias(value)), value, {f"{value}__med": 0.5}, keys).drop("n_values")


def impute_group_median(df: DataFrame, value: str, keys: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill with the group median, then with the median of the already filled column.

    Rows whose keys are missing, and groups without any value, fall to the second
    level. Fitted on `fit` when given, otherwise on the frame itself.
    """
    def first_level(d: DataFrame, med: DataFrame) -> DataFrame:
        return d.join(med, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.col(f"{value}__med"))).drop(f"{value}__med")

    base = fit if fit is not None else df
    med = sized(group_medians(base, value, keys))
    cell = quantile_cells(first_level(base, med), value, [0.5])
    out = first_level(df, med)
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(cell[0]))) if cell else out


def category_codes(fit: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Dense zero-based codes of the sorted distinct values, numbered range by range."""
    v = keep(fit.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(column)).agg(F.lit(1).cast("bigint").alias("one")))
    bucket = bucket_of(F.col(column), text_cuts(v, column))
    return running_totals(v, column, [], ["one"], bucket).select(column, F.col("one_before").cast("int").alias(out))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Unseen or missing values get -1."""
    c = codes.select(F.col(column), F.col("code").alias("_code"))
    return attach(df, c, [column]).withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code")


def frequencies(fit: DataFrame, column: str) -> DataFrame:
    """Share of each value among non-missing rows."""
    src = fit.where(F.col(column).isNotNull())
    counts = src.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, (F.col("n") / src.agg(F.count(F.lit(1))).scalar()).alias("freq"))


def apply_frequencies(df: DataFrame, freq: DataFrame, column: str, out: str) -> DataFrame:
    f = freq.select(F.col(column), F.col("freq").alias("_freq"))
    return attach(df, f, [column]).withColumn(out, F.coalesce("_freq", F.lit(0.0))).drop("_freq")


def target_encode_oof(df: DataFrame, keys: Sequence[str], targets: dict[str, Column], k: int, fold: str = "fold",
                      smoothing: float = 10.0) -> DataFrame:
    """Out-of-fold smoothed mean of each target per category, without the row's own fold.

    One aggregation by (category, fold) gives every sum; each category keeps a map with
    at most k folds, and the held-out part is subtracted from its totals.
    `targets` maps output names to numeric columns; several keys form a combined category.
    """
    keys = list(keys)
    work = df.withColumns({f"_t_{n}": c.cast("double") for n, c in targets.items()})
    cells = work.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_t_{n}").alias(f"s_{n}") for n in targets])
    names = ["n", *[f"s_{n}" for n in targets]]
    # k rows: sums outside each fold, which give its priors.
    everything = Window.partitionBy(F.lit(0))
    outside = cells.groupBy(fold).agg(*[F.sum(c).alias(c) for c in names]).select(
        fold, *[(F.sum(c).over(everything) - F.col(c)).alias(f"out_{c}") for c in names])
    cats = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct(*names)))).alias("_m"),
                                    *[F.sum(c).alias(f"all_{c}") for c in names])
    table = cats.select(*keys, "_m", *[f"all_{c}" for c in names], F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
    table = table.join(F.broadcast(outside), fold)
    own = F.try_element_at("_m", F.col(fold))
    others = lambda c: F.col(f"all_{c}") - F.coalesce(own[c], F.lit(0))
    enc = table.select(*keys, fold, *[
        F.coalesce(F.try_divide(others(f"s_{n}") + smoothing * F.try_divide(F.col(f"out_s_{n}"), F.col("out_n")), others("n") + smoothing),
                   F.lit(0.0)).alias(n) for n in targets])
    return attach(df, enc, [*keys, fold])


def group_stats(df: DataFrame, fit: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """Mean, sample std, min and max of a numeric per category, attached to the rows."""
    s = fit.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(value).alias(f"{prefix}_mean"), F.stddev_samp(value).alias(f"{prefix}_std"),
        F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"))
    return attach(df, s, [key])


def percentile_ranks(df: DataFrame, value: str, out: str, fit: DataFrame | None = None) -> DataFrame:
    """(rows below) / (n - 1) in the value's distribution."""
    base = fit if fit is not None else df
    r = value_ranks(base.select(F.col(value).cast("double").alias(value)), value)
    pr = F.coalesce(F.try_divide(F.col("n_before"), F.col("n_total") - 1), F.lit(0.0))
    return attach(df.withColumn("_v", F.col(value).cast("double")), r.select(F.col(value).alias("_v"), pr.alias(out)), ["_v"]).drop("_v")


def digit_features(df: DataFrame, value: str, decimals: int, n_digits: int, prefix: str) -> DataFrame:
    """Digits of the fixed-decimal rendering, least significant first."""
    units = F.round(F.abs(F.col(value)) * (10 ** decimals)).cast("bigint")
    return df.withColumns({f"{prefix}_{i}": (F.call_function("div", units, F.lit(10 ** i)) % 10).cast("int") if i else (units % 10).cast("int")
                           for i in range(n_digits)})


def standardise(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std; a constant column becomes zero."""
    base = fit if fit is not None else df
    stats = base.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).alias("r")).scalar()
    return df.withColumns({f"{c}{suffix}": F.when(F.col(c).isNotNull(), F.coalesce(
        F.try_divide(F.col(c) - stats[c]["m"], stats[c]["s"]), F.lit(0.0))) for c in cols})


def polynomial(df: DataFrame, cols: Sequence[str], sep: str = "__") -> DataFrame:
    """Squares and pairwise products."""
    out = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out[f"{a}{sep}{b}"] = F.col(a) * F.col(b)
    return df.withColumns(out)


def embedding_join(df: DataFrame, emb: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Attach an embedding by id; rows without one get zeros. Both sides shuffle on the id."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.join(emb.select(key, vector), key, "left").withColumns(
        {"has_embedding": F.col(vector).isNotNull().cast("int"), vector: F.coalesce(vector, zeros)})


def l2_normalise(c: Column) -> Column:
    """Scale a vector to unit length; a zero vector stays zero."""
    x = F.transform(c, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(x)
