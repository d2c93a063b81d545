"""Fold, sample and weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.num import r6
from foldwise.operators import folds as H
from foldwise.plans.common import FO, K, LINE_KEY, SC, folded, model_columns, query, scored_folds
from foldwise.sources.tables import table

KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("stratified_folds", f"WITH {FO} SELECT {KEY_SQL}, l_returnflag, fold FROM fo")
def stratified_folds(spark, sf):
    return folded(spark, sf).select(*LINE_KEY, "l_returnflag", "fold")


@query("stratified_folds_imbalanced", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', doc_id, '7'))) - 1) % 10 AS INTEGER) AS fold FROM labels""")
def stratified_folds_imbalanced(spark, sf):
    return H.stratified_folds(table(spark, sf, "labels"), ["doc_id"], "quality", 10, seed=7).select("doc_id", "quality", "fold")


@query("fold_sizes", f"WITH {FO} SELECT fold, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train, count(*) AS n_val FROM fo GROUP BY fold")
def fold_sizes(spark, sf):
    return H.fold_sizes(folded(spark, sf))


@query("fold_accessors", f"""
WITH {FO} SELECT side, l_returnflag, count(*) AS n FROM (SELECT CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS side, l_returnflag FROM fo) GROUP BY 1, 2""")
def fold_accessors(spark, sf):
    d = folded(spark, sf)
    t = H.train_side(d, 2).select(F.lit("train").alias("side"), "l_returnflag")
    return t.unionByName(H.valid_side(d, 2).select(F.lit("valid").alias("side"), "l_returnflag")).groupBy("side", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def ranked(seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"(SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', {KEY_SQL}, '{seed}'))) - 1 AS r, count(*) OVER ({part.strip()}) AS tot FROM lineitem)")


@query("stratified_sample", f"SELECT {KEY_SQL}, l_returnflag FROM {ranked(11, 'l_returnflag')} WHERE r < round_even(tot * 0.1::DOUBLE, 0)")
def stratified_sample(spark, sf):
    return H.stratified_sample(table(spark, sf, "lineitem"), LINE_KEY, "l_returnflag", 0.1, seed=11).select(*LINE_KEY, "l_returnflag")


@query("seeded_sample", f"SELECT {KEY_SQL} FROM {ranked(5)} WHERE r < 5000")
def seeded_sample(spark, sf):
    return H.seeded_sample(table(spark, sf, "lineitem"), LINE_KEY, 5000, seed=5).select(*LINE_KEY)


@query("shuffle_key", f"SELECT {KEY_SQL}, r AS position FROM {ranked(42)}")
def shuffle_key(spark, sf):
    return H.shuffle_position(table(spark, sf, "lineitem"), LINE_KEY).select(*LINE_KEY, "position")


@query("holdout_split", f"SELECT {KEY_SQL}, CASE WHEN r < greatest(1, tot // 20) THEN 'valid' ELSE 'train' END AS split FROM {ranked(9)}")
def holdout_split(spark, sf):
    return H.holdout_split(table(spark, sf, "lineitem"), LINE_KEY, seed=9).select(*LINE_KEY, "split")


@query("balanced_weights", f"""
WITH {FO}, c AS (SELECT f.fold, l_returnflag, count(*) AS n FROM (SELECT DISTINCT fold FROM fo) f JOIN fo ON fo.fold <> f.fold GROUP BY 1, 2)
SELECT fold, l_returnflag, n AS n_train, round(sum(n) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * n), 6) AS weight FROM c""")
def balanced_weights(spark, sf):
    return H.fold_class_weights(folded(spark, sf), "l_returnflag", K)


@query("row_weights", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT quality, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c)
SELECT doc_id, quality, round(weight, 6) AS weight FROM labels JOIN w USING (quality)""")
def row_weights(spark, sf):
    d = table(spark, sf, "labels")
    return H.with_weights(d, H.class_weights(d, "quality"), "quality").select("doc_id", "quality", r6(F.col("weight")).alias("weight"))


@query("oversample", """
SELECT doc_id, quality, CAST(unnest(range(1, CASE WHEN quality = 0 THEN 5 ELSE 1 END + 1)) AS INTEGER) AS copy FROM labels""")
def oversample(spark, sf):
    return H.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", {0: 5})


@query("pseudo_label", f"""
WITH {SC} SELECT {KEY_SQL}, y, 'train' AS source, 1.0::DOUBLE AS weight FROM sc WHERE fold <> 0
UNION ALL SELECT {KEY_SQL}, CASE WHEN p2_0 = greatest(p2_0, p2_1, p2_2) THEN 0 WHEN p2_1 = greatest(p2_0, p2_1, p2_2) THEN 1 ELSE 2 END, 'pseudo', 0.5 FROM sc
 WHERE fold = 0 AND greatest(p2_0, p2_1, p2_2) >= 0.5""")
def pseudo_label(spark, sf):
    from foldwise.functions.num import argmax_columns
    d = scored_folds(spark, sf)
    cols = [F.col(c) for c in model_columns(2)]
    out = H.pseudo_label(d.where("fold <> 0").select(*LINE_KEY, "y"), d.where("fold = 0"), "y", F.greatest(*cols), argmax_columns(cols), 0.5)
    return out.select(*LINE_KEY, "y", "source", "weight")


@query("row_augmentation", """
SELECT doc_id, quality, 'base' AS source, 1.0::DOUBLE AS weight FROM labels WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, toxic, 'extra', 0.25 FROM labels WHERE doc_id % 3 = 0""")
def row_augmentation(spark, sf):
    d = table(spark, sf, "labels")
    return H.augment(d.where("doc_id % 3 <> 0").select("doc_id", "quality"), d.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("quality")), 0.25)
