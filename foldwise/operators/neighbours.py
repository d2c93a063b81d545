"""Mutual information of a number and a class by nearest neighbours.

For a row, d is the distance to its k-th nearest other row of its own class, and m the
number of rows of any class nearer than d, itself included. Rows are first collapsed
to (column, class, value, count). The value axis is cut into buckets; the k values at
the edges of a bucket go to its neighbours as a halo, so no class and no
column has to be in one task. m is a difference of running totals at v - d and v + d.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.num import r6
from foldwise.operators.lookup import keep
from foldwise.operators.ranks import bucket_of, cut_points, long_form, running_totals

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """Digamma of a number of 1 or more: six steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y)
    return series - sum((1 / (x + j) for j in range(1, 6)), 1 / x)


def _bucket(column: str, cuts: dict, name: Column) -> Column:
    out = F.lit(0)
    for c, own in cuts.items():
        out = F.when(name == c, bucket_of(F.col(column), own)).otherwise(out)
    return out


def kth_distances(cells: DataFrame, cuts: dict, k: int) -> DataFrame:
    """cells (feature, y, value, n, n_class) with d, the distance of a row of the cell to the k-th nearest other row of its class; k is less where a class has
    fewer rows. Classes of one row are left out."""
    by = ["feature", "y", "_b"]
    c = cells.where("n_class > 1").withColumn("_b", _bucket("value", cuts, F.col("feature")))
    own = F.struct(F.col("value").alias("v"), F.col("n"))
    inside = Window.partitionBy(*by).orderBy("value")
    c = c.withColumns({"_near": F.collect_list(own).over(inside.rowsBetween(-k, k)), "_i": F.row_number().over(inside),
                       "_j": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value")))})
    # The edges of a bucket are at most 2 k rows; the k nearest buckets with rows hold the halo.
    edges = c.where((F.col("_i") <= k) | (F.col("_j") <= k)).groupBy(*by).agg(
        F.collect_list(F.when(F.col("_i") <= k, own)).alias("_first"), F.collect_list(F.when(F.col("_j") <= k, own)).alias("_last"))
    along = Window.partitionBy("feature", "y").orderBy("_b")
    halo = edges.select(*by, F.concat(F.flatten(F.collect_list("_last").over(along.rowsBetween(-k, -1))), F.flatten(F.collect_list("_first").over(along.rowsBetween(1, k)))).alias("_halo"))
    c = c.join(halo, by)
    wanted = F.least(F.lit(k).cast("bigint"), F.col("n_class") - 1)
    apart = F.transform(F.concat("_near", "_halo"), lambda x: F.struct(F.abs(x["v"] - F.col("value")).alias("d"), F.when(x["v"] == F.col("value"), x["n"] - 1).otherwise(x["n"]).alias("n")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda a, x: F.when(a["n"] >= F.col("_k"), a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.when(x["n"] > 0, x["d"]).otherwise(a["d"]).alias("d")))
    c = c.withColumn("_k", wanted).withColumn("d", F.aggregate(F.array_sort(apart), start, step, lambda a: a["d"]))
    return c.select("feature", "y", "value", "n", "n_class", F.col("_k").alias("k"), "d")


def neighbour_mi(df: DataFrame, cols: Sequence[str], target: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, n, mi): mutual information in nats of each numeric column with the class, never below 0.

    Rows without a class or a value (NaN too), and rows alone in their class, take no part; of a column without rows there is none. Equal values are at
    distance 0, and rows at distance 0 have all their equals as neighbours. Infinite values are not supported and left out.
    """
    rows = long_form(df.where(F.col(target).isNotNull()), cols, [target]).dropna(subset=["value"])
    rows = rows.where((F.col("value") > float("-inf")) & (F.col("value") < float("inf")))
    cells = rows.groupBy("feature", F.col(target).alias("y"), "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("feature", F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n_class"))  # columns times classes rows
    cells = keep(cells.join(F.broadcast(sizes), ["feature", "y"]).where("n_class > 1"))
    cuts = cut_points(cells, "value", "feature")
    far = keep(kth_distances(cells, cuts, k).withColumns({"lo": F.col("value") - F.col("d"), "hi": F.col("value") + F.col("d")}))
    marks = far.select("feature", F.explode(F.array("lo", "hi")).alias("value")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    axis = cells.select("feature", "value", "n").union(marks).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    axis = keep(running_totals(axis, "value", ["feature"], ["n"], _bucket("value", cuts, F.col("feature"))).select("feature", "value", "n", "n_before"))
    low = axis.select("feature", F.col("value").alias("lo"), (F.col("n") + F.col("n_before")).alias("upto"), F.col("n").alias("same"))
    high = axis.select("feature", F.col("value").alias("hi"), F.col("n_before").alias("below"))
    m = F.when(F.col("d") == 0, F.col("same")).otherwise(F.col("below") - F.col("upto"))
    each = far.join(low, ["feature", "lo"]).join(high, ["feature", "hi"]).withColumn("m", F.greatest(m, F.lit(1)))
    n = F.col("n").cast("double")
    total = F.sum("n")
    mean = lambda x: F.sum(n * digamma(x)) / total
    out = each.groupBy("feature").agg(total.alias("n"), (digamma(total) + mean(F.col("k")) - mean(F.col("n_class")) - mean(F.col("m"))).alias("mi"))
    return out.select("feature", "n", r6(F.greatest(F.col("mi"), F.lit(0.0))).alias("mi"))
