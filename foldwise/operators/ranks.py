"""Ranks, running totals and exact quantiles without a single-task global sort.

Values are first collapsed to (group, value, weights). The value axis is cut at
approximate quantiles of the distinct values, read once as a short list of literals, so that every bucket is an independent window partition. Per-bucket totals, at most
groups x buckets rows, supply the offsets. Results are exact whatever the cuts
are; the cuts only decide how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.lookup import keep, sized
from foldwise.operators.select import order_statistics


def bucket_count(df: DataFrame) -> int:
    return max(8, min(2048, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(table: DataFrame, value: str, per: str | None = None) -> dict[str | None, list[float]]:
    """Increasing approximate quantiles of a numeric column, one short list per name on the driver.

    `per` is a column with few distinct values, such as the name of an unpivoted column.
    """
    n = bucket_count(table)
    q = F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 1000).alias("q")
    rows = table.groupBy(per).agg(q).collect() if per else table.agg(q).collect()
    return {(r[per] if per else None): sorted(set(r["q"] or [])) for r in rows}


def bucket_of(x: Column, cuts: Sequence, strict: bool = False) -> Column:
    """Number of cuts not above x, or below x when strict.

    Up to 128 cuts become a binary tree of comparisons inside generated code; more
    are searched in two levels, so the cost grows with the root of their number.
    """
    if len(cuts) <= 128:
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            left = (x <= cuts[mid]) if strict else (x < cuts[mid])
            return F.when(left, tree(lo, mid)).otherwise(tree(mid + 1, hi))
        return tree(0, len(cuts))
    passed = (lambda c: c < x) if strict else (lambda c: c <= x)
    step = int(len(cuts) ** 0.5)
    coarse, every = F.array(*[F.lit(c) for c in cuts[::step]]), F.array(*[F.lit(c) for c in cuts])
    ci = F.size(F.filter(coarse, passed))
    inner = F.slice(every, (ci - 1) * step + 1, step)
    return F.when(ci == 0, F.lit(0)).otherwise((ci - 1) * step + F.size(F.filter(inner, passed)))


def running_totals(table: DataFrame, order: str, by: Sequence[str], weights: Sequence[str],
                   bucket: Column) -> DataFrame:
    """Add `<w>_before` (sum over smaller values) and `<w>_total` per group for each weight.

    `table` has one row per (group, value); `bucket` must not decrease with the value.
    """
    by = list(by)
    t = table.withColumn("_b", bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({f"{w}_in": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    per_bucket = (table.withColumn("_b", bucket).groupBy(*by, "_b")
                  .agg(*[F.sum(w).alias(f"{w}_sum") for w in weights]))
    # One row per group and bucket: bounded by the cut list, not by the data.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_bucket.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"{w}_sum").over(upto), F.lit(0)).alias(f"{w}_off") for w in weights],
        *[F.sum(f"{w}_sum").over(whole).alias(f"{w}_total") for w in weights],
    )
    out = t.join(off, [*by, "_b"])
    return (out.withColumns({f"{w}_before": F.col(f"{w}_in") + F.col(f"{w}_off") for w in weights})
            .drop("_b", *[f"{w}_in" for w in weights], *[f"{w}_off" for w in weights]))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None,
                per: str | None = None) -> DataFrame:
    """One row per (group, value): `n`, further weights, and their running totals.

    Groups and values that are missing are left out. `avg_rank` is the rank with
    ties averaged. The rows are read once: the (group, value) table is kept, and cut
    points, offsets and windows all come from it. `per` names a group column that
    gets its own cut points.
    """
    by = list(by)
    weights = {"n": F.count(F.lit(1)), **(weights or {})}
    table = keep(df.dropna(subset=[*by, value]).groupBy(*by, value).agg(*[e.alias(k) for k, e in weights.items()]))
    bucket = F.lit(0)
    for name, cuts in cut_points(table, value, per).items():
        mine = bucket_of(F.col(value), cuts)
        bucket = mine if per is None else F.when(F.col(per) == name, mine).otherwise(bucket)
    out = running_totals(table, value, by, list(weights), bucket)
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "feature",
              value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (name, value) rows as doubles."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(keep), list(cols), name, value)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
              per: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per entry of `probs`.

    Few groups are answered by selection, which shuffles no values; with many groups each is small and its values are ranked.
    """
    by = list(by)
    found = order_statistics(df, value, probs, by)
    if found is None:
        return ranked_quantiles(df, value, probs, by, per)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in by), "n_values long", *(f"{quoted(p)} double" for p in probs)])
    return df.sparkSession.createDataFrame([(*g, n, *(cells[p] for p in probs)) for g, (n, cells) in found.items()], schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ranked_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                     per: str | None = None) -> DataFrame:
    """The same by ranking every different value of every group."""
    by = list(by)
    ranked = value_ranks(df, value, by, per=per)
    v, before, after = F.col(value), F.col("n_before"), F.col("n_before") + F.col("n")
    aggs = []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.max(F.when((before <= lo) & (lo < after), v)).alias(f"{name}__lo"),
                 F.max(F.when((before <= hi) & (hi < after), v)).alias(f"{name}__hi"),
                 F.max(h - lo).alias(f"{name}__w")]
    got = ranked.groupBy(*by).agg(F.max("n_total").alias("n_values"), *aggs)
    return got.select(*by, "n_values", *[
        (F.col(f"{k}__lo") + (F.col(f"{k}__hi") - F.col(f"{k}__lo")) * F.col(f"{k}__w")).alias(k) for k in probs])


def quantile_cells(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column as Python numbers (a handful of values)."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    found = order_statistics(df, value, names) or {}
    return [found[()][1][k] for k in names] if () in found else []


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns at many probabilities: columns x probabilities cells, selected in common rounds."""
    names = {f"q{i}": float(p) for i, p in enumerate(probs)}
    found = order_statistics(long_form(df, cols), "value", names, ["feature"]) or {}
    return {c: [found[(c,)][1][n] for n in names] if (c,) in found else [] for c in cols}


#: Rows that a bucket of md5 order holds, about; digits at least, so that small tables are spread too, and at most.
BUCKET_ROWS, LEAST_DIGITS, MOST_DIGITS = 50_000, 2, 12


def radix_digits(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Hex digits that cut the largest group into buckets of about BUCKET_ROWS rows. The counts are one small aggregate."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    digits = LEAST_DIGITS
    while digits < MOST_DIGITS and n > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def hash_rank(df: DataFrame, md5_col: str, by: Sequence[str] = (), digits: int | None = None, out: str = "rank",
              limit: Column | None = None, once: bool = False) -> DataFrame:
    """Zero-based position of each row in md5 order inside its group.

    An md5 is uniform, so its leading digits cut even one huge group into equal
    buckets, as many digits as the largest group needs; the window runs inside a bucket and bucket counts give the offsets.
    Rows with one md5, those of one key, share a bucket whatever the digits.
    Adds `<out>` and `<out>_total`. With `limit`, an expression over `<out>_total`,
    only positions below it are returned, and buckets that start beyond it are
    dropped before any row is shuffled. With `once` the rows, without the md5, are kept as soon as they are placed in their buckets, so that the md5s, the
    shuffle and the sort are not repeated for the counts or by any later reader; give it no more columns than are read.
    """
    by = list(by)
    digits = radix_digits(df, by) if digits is None else digits
    t = df.withColumn("_b", F.substring(md5_col, 1, digits))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(md5_col)) - 1
    if once:
        t = keep(t.withColumn("_in", inside).drop(md5_col))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = t.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # About rows / BUCKET_ROWS, or 16^LEAST_DIGITS for each group.
    off = counts.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k_b"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias(f"{out}_total"))
    cond = F.col("_b") == F.col("_k_b")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    if once:
        return t.join(sized(off), cond).select(*[c for c in df.columns if c != md5_col], (F.col("_in") + F.col("_off")).alias(out), f"{out}_total")
    if limit is None:
        # The window has already placed the rows by group and bucket, so the join moves only the counts.
        j = t.withColumn("_in", inside).join(off, cond)
        return j.select(*df.columns, (F.col("_in") + F.col("_off")).alias(out), f"{out}_total")
    j = t.join(sized(off), cond).where(F.col("_off") < limit)
    return j.select(*df.columns, (inside + F.col("_off")).alias(out), f"{out}_total").where(F.col(out) < limit)


def text_cuts(table: DataFrame, column: str, per_cut: int = 32) -> list[str]:
    """Cut points of a text column from a fixed-size md5-ordered sample of its distinct values."""
    n = bucket_count(table)
    rows = table.select(column).orderBy(F.md5(column)).limit(n * per_cut).collect()
    return sorted((r[0] for r in rows), key=lambda v: v.encode())[per_cut::per_cut]
