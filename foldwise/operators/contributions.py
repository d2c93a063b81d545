"""Additive contributions of the columns to the predictions of a fitted forest.

A forest is saved by Spark as a table of nodes. On the way from the root of a tree to a
leaf the class shares change at every split; the change belongs to the column that
is split. A row's contributions are those of the leaves it ends in, averaged over the
trees, and with the shares at the roots they sum to the predicted probabilities.
Which leaf that is, is an expression compiled from the tree; what a leaf contributes is a literal table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.functions.num import r6
from foldwise.sources.tables import shared_path


@dataclass(frozen=True)
class Node:
    shares: np.ndarray
    slot: int
    goes_left: tuple[float, ...]
    by_category: bool
    left: int
    right: int


def node_table(spark: SparkSession, forest) -> list[dict[int, Node]]:
    """The nodes of every tree by number, from the model's own saved table. Trees times nodes rows, whatever the data."""
    path = shared_path(spark, "forest")
    forest.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, Node]] = {}
    for r in rows:
        stats = np.array(r["impurityStats"], float)
        s = r["split"]
        trees.setdefault(r["treeID"], {})[r["id"]] = Node(stats / stats.sum(), s["featureIndex"], tuple(s["leftCategoriesOrThreshold"] or ()), s["numCategories"] > 0,
                                                          r["leftChild"], r["rightChild"])
    return [trees[t] for t in sorted(trees)]


def slots_to_columns(metadata: dict, columns: Sequence[str]) -> list[int]:
    """For each slot of the assembled vector the place of the column that it comes from; encoded slots are named column__v_value."""
    names = {a["idx"]: a.get("name", "") for group in metadata.get("ml_attr", {}).get("attrs", {}).values() for a in group}
    return [next(k for k, c in sorted(enumerate(columns), key=lambda x: -len(x[1])) if names[i] == c or names[i].startswith(f"{c}__v_")) for i in range(len(names))]


def _compiled(tree: dict[int, Node], x: Column, of: Sequence[int], n_columns: int) -> tuple[Column, np.ndarray]:
    """(expression for the number of the leaf, [leaves, columns, classes] contributions)."""
    leaves = []

    def walk(i: int, gone: np.ndarray) -> Column:
        node = tree[i]
        if node.left < 0:
            leaves.append(gone)
            return F.lit(len(leaves) - 1)
        ways = []
        for child in (node.left, node.right):
            own = gone.copy()
            own[of[node.slot]] += tree[child].shares - node.shares
            ways.append(walk(child, own))
        value = F.get(x, F.lit(node.slot))
        left = value.isin(*node.goes_left) if node.by_category else value <= node.goes_left[0]
        return F.when(left, ways[0]).otherwise(ways[1])

    leaf = walk(0, np.zeros((n_columns, len(tree[0].shares))))
    return leaf, np.array(leaves)


def forest_leaves(scored: DataFrame, forest, columns: Sequence[str], features: str = "raw_features") -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """(scored with the number of the leaf of each tree as `_t<tree>`, for each tree what its leaves contribute, class shares before any split).

    `scored` holds the assembled vector that the forest reads. Rows that end in the same leaves have the same contributions, so they can be counted first.
    """
    trees = node_table(scored.sparkSession, forest)
    of = slots_to_columns(scored.schema[features].metadata, columns)
    compiled = [_compiled(tree, F.col("_x"), of, len(columns)) for tree in trees]
    out = scored.withColumn("_x", vector_to_array(features)).withColumns({f"_t{t}": leaf for t, (leaf, _) in enumerate(compiled)}).drop("_x")
    return out, [table for _, table in compiled], np.mean([tree[0].shares for tree in trees], axis=0)


def leaf_contributions(leaves: DataFrame, tables: Sequence[np.ndarray], shares: np.ndarray) -> DataFrame:
    """leaves (columns `_t<tree>`) with `base` and `contributions`, an array of one array of class changes for each column."""
    n, k = tables[0].shape[1:]
    names = [f"_t{t}" for t in range(len(tables))]
    cells = [F.array(*[F.array(*[F.lit(float(v)) for v in row.ravel() / len(tables)]) for row in table]) for table in tables]
    flat = F.transform(F.sequence(F.lit(0), F.lit(n * k - 1)), lambda i: sum((F.get(f"_c{t}", i) for t in range(len(tables))), F.lit(0.0)))
    out = leaves.withColumns({f"_c{t}": F.get(c, F.col(name)) for t, (c, name) in enumerate(zip(cells, names))}).withColumn("_flat", flat)
    base = F.array(*[F.lit(float(v)) for v in shares])
    return out.withColumns({"base": base, "contributions": F.array(*[F.slice("_flat", i * k + 1, k) for i in range(n)])}).drop("_flat", *[f"_c{t}" for t in range(len(tables))])


def forest_contributions(scored: DataFrame, forest, columns: Sequence[str], features: str = "raw_features") -> DataFrame:
    """scored with `base` (class shares before any split) and `contributions`, an array of one array of class changes for each column.

    base plus the contributions of all columns is the forest's probability, class by class. `scored` holds the assembled vector that the forest reads.
    """
    leaves, tables, shares = forest_leaves(scored, forest, columns, features)
    return leaf_contributions(leaves, tables, shares).drop(*[f"_t{t}" for t in range(len(tables))])


def contribution_ranking(contributed: DataFrame, columns: Sequence[str], n_classes: int, n: str | None = None) -> DataFrame:
    """(class, feature, mean_abs, mean_signed, rank): how much each column moves each class over all rows, in one aggregate; with `n` each row stands for that many."""
    mean = F.avg if n is None else lambda x: F.sum(x * F.col(n)) / F.sum(n)
    at = [(i, c) for i in range(len(columns)) for c in range(n_classes)]
    cell = lambda i, c: F.get(F.get("contributions", F.lit(i)), F.lit(c))
    one = contributed.agg(*[mean(F.abs(cell(i, c))).alias(f"a{i}_{c}") for i, c in at], *[mean(cell(i, c)).alias(f"s{i}_{c}") for i, c in at])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(columns[i]).alias("feature"), r6(F.col(f"a{i}_{c}")).alias("mean_abs"),
                                                   r6(F.col(f"s{i}_{c}")).alias("mean_signed")) for i, c in at])).alias("r")).select("r.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mean_abs"), "feature")))
