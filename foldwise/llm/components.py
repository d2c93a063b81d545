"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import last_written, unwrite, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of its component.

    Each round joins every node with its least neighbour, first towards larger and then towards smaller nodes, so paths halve and a hub needs one
    row in the grouped side; the number of rounds grows with the logarithm of the longest path. Nulls and loops are dropped. Every round is
    written to the shared folder, and the one before deleted.
    """
    e = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, path = None, last_written()
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select("v", "m").toDF("u", "v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").union(least.select("u", "m")).distinct(), "edges")
        unwrite(e.sparkSession, path)
        path = last_written()
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return e.toDF("node", "root").union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
