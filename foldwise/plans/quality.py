"""Sources, sinks, contracts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.num import argmax_columns
from foldwise.operators import contracts as C
from foldwise.operators import metrics as M
from foldwise.operators import profile as P
from foldwise.operators.folds import fold_contract
from foldwise.plans.common import (FLAGS, FO, K, LINE_KEY, LINE_MD5, ON, SC, first_max, folded, model_columns, orders_with_nulls, query, scored,
                                   scored_folds)
from foldwise.sources import files as S
from foldwise.sources.tables import TABLES, shared_path, table

ORDER_SPECS = (
    C.ColumnSpec("o_orderkey", "int"),
    C.ColumnSpec("o_custkey", "int"),
    C.ColumnSpec("o_totalprice", "float", min_value=0.0),
    C.ColumnSpec("o_orderstatus", "text", allowed=frozenset({"O", "F", "P"})),
    C.ColumnSpec("o_orderpriority", "text"),
)


@query("csv_contract_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def csv_contract_scan(spark, sf):
    path = shared_path(spark, "orders-csv")
    S.write_csv(table(spark, sf, "orders").select(*[s.name for s in ORDER_SPECS]), path)
    return S.read_csv_contract(spark, path, ORDER_SPECS)


@query("jsonl_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_scan(spark, sf):
    path = shared_path(spark, "customer-jsonl")
    S.write_jsonl(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return S.read_jsonl(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("parquet_reuse", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings""")
def parquet_reuse(spark, sf):
    path = shared_path(spark, "embedding-cache")
    build = lambda: table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))
    S.materialise(spark, path, build)
    return S.materialise(spark, path, build)


@query("multi_table_scan", "SELECT 'labels' AS name, count(*) AS n FROM labels UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def multi_table_scan(spark, sf):
    paths = {}
    for n in ("labels", "nation", "supplier"):
        t = table(spark, sf, n)
        paths[n] = (shared_path(spark, n), t.schema)
        S.write_csv(t, paths[n][0])
    got = S.read_tables(spark, paths)
    parts = [d.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, d in got.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PRED = """
pr AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderstatus END AS label
       FROM orders WHERE o_orderkey % 97 <> 0
       UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 89 = 0),
ids AS (SELECT coalesce(p.o_orderkey, t.o_orderkey) AS k, coalesce(p.c, 0) AS p, coalesce(t.c, 0) AS t
        FROM (SELECT o_orderkey, count(*) AS c FROM pr GROUP BY 1) p FULL JOIN (SELECT o_orderkey, count(*) AS c FROM orders GROUP BY 1) t USING (o_orderkey))"""


@query("prediction_contract", f"""
WITH {PRED}, a AS (SELECT count(*) FILTER (p = 0) AS not_predicted, count(*) FILTER (t = 0) AS not_in_truth, count(*) FILTER (p > 1) AS predicted_twice,
  CAST(sum(p) AS BIGINT) AS n_predictions, CAST(sum(t) AS BIGINT) AS n_truth FROM ids),
b AS (SELECT count(*) FILTER (label IS NULL) AS null_labels, count(*) FILTER (o_orderkey IS NULL) AS null_ids,
  count(*) FILTER (label NOT IN ('F', 'O', 'P')) AS bad_labels FROM pr)
SELECT a.*, b.*, true AS columns_ok, not_predicted + not_in_truth + predicted_twice + null_labels + null_ids + bad_labels = 0 AS passed FROM a, b""")
def prediction_contract(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    label = F.when(k % 101 == 0, "X").when(k % 103 == 0, None).otherwise(F.col("o_orderstatus"))
    pred = o.where(k % 97 != 0).select(k, label.alias("label")).unionByName(o.where(k % 89 == 0).select(k, F.col("o_orderstatus").alias("label")))
    return C.prediction_contract(pred, o, "o_orderkey", "label", ["F", "O", "P"])


@query("oof_table", f"""
WITH {SC} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p0_0 AS prob_1, p0_1 AS prob_2, p0_2 AS prob_3, y AS true_label,
  {first_max(model_columns(0))} AS pred_label FROM sc""")
def oof_table(spark, sf):
    d = scored(spark, sf).withColumn("yhat", argmax_columns([F.col(c) for c in model_columns(0)]))
    return S.oof_table(d, LINE_KEY, model_columns(0), "y", "yhat")


def fold_scores_sql(pred: str, name: str = "score") -> str:
    return (f"(SELECT fold, avg(r) AS {name} FROM (SELECT fold, y, avg(CASE WHEN y = {pred} THEN 1.0 ELSE 0.0 END) AS r FROM sc GROUP BY fold, y) GROUP BY fold)")


def model_scores(spark, sf, m: int):
    d = scored_folds(spark, sf).withColumn("yhat", argmax_columns([F.col(c) for c in model_columns(m)]))
    return M.balanced_accuracy(d, "y", "yhat", ["fold"])


@query("run_records", f"""
WITH {SC} SELECT 'demo' AS run, 'm0' AS model, fold, 'balanced_accuracy' AS metric, round(score, 6) AS value FROM {fold_scores_sql(first_max(model_columns(0)))}
UNION ALL SELECT 'demo', 'm1', fold, 'balanced_accuracy', round(score, 6) FROM {fold_scores_sql(first_max(model_columns(1)))}""")
def run_records(spark, sf):
    path = shared_path(spark, "runs")
    for m in (0, 1):
        S.append_run_records(model_scores(spark, sf, m).select(
            F.lit("demo").alias("run"), F.lit(f"m{m}").alias("model"), "fold", F.lit("balanced_accuracy").alias("metric"), F.round("score", 6).alias("value")), path)
    return spark.read.schema(S.RUN_SCHEMA).parquet(path)


@query("table_fingerprint", """
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(coalesce(length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey, '-') || coalesce(length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber, '-') || coalesce(length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey, '-') || coalesce(length(CAST(l_suppkey AS VARCHAR)) || ':' || l_suppkey, '-') || coalesce(length(CAST(l_returnflag AS VARCHAR)) || ':' || l_returnflag, '-') || coalesce(length(CAST(l_linestatus AS VARCHAR)) || ':' || l_linestatus, '-')), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM lineitem""")
def table_fingerprint(spark, sf):
    return S.table_fingerprint(table(spark, sf, "lineitem"), [*LINE_KEY, "l_returnflag", "l_linestatus"])


@query("file_fingerprint")
def file_fingerprint(spark, sf):
    return S.file_fingerprints(spark, [f"{sf}/{t}.parquet" for t in TABLES] + [f"{sf}/absent.parquet"])


@query("discover_file", "SELECT count(*) AS n, 'lineitem.parquet' AS name FROM lineitem")
def discover_file(spark, sf):
    path = S.discover_one(spark, sf, "lineitem.parquet")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.lit(path.rsplit("/", 1)[-1]).alias("name"))


BROKEN_SPECS = (
    C.ColumnSpec("o_orderkey", "int"),
    C.ColumnSpec("o_custkey", "int", max_value=1000.0),
    C.ColumnSpec("o_orderstatus", "text", null_limit=0.5, allowed=frozenset({"O", "F"})),
    C.ColumnSpec("o_totalprice", "float", null_limit=0.01, min_value=1500.0, max_value=400000.0),
    C.ColumnSpec("o_orderpriority", "text", allowed=frozenset({"1-URGENT", "2-HIGH", "5-LOW"})),
    C.ColumnSpec("pain", "float", min_value=0.0),
    C.ColumnSpec("o_clerk", "text"),
)


@query("contract_violations", f"""
WITH {ON}
SELECT 'column_count' AS "check", NULL AS column_name, 6::BIGINT AS n_rows, 7.0::DOUBLE AS observed, NULL AS detail
UNION ALL SELECT 'column_order', NULL, NULL, NULL, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority,pain'
UNION ALL SELECT 'column_missing', 'o_clerk', NULL, NULL, NULL
UNION ALL SELECT 'column_type', 'pain', NULL, NULL, 'int'
UNION ALL SELECT 'null_share', 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), round(count(*) FILTER (o_totalprice IS NULL) / count(*), 6), NULL FROM onull
UNION ALL SELECT 'null_share', 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), round(count(*) FILTER (o_orderpriority IS NULL) / count(*), 6), NULL FROM onull
UNION ALL SELECT 'above_max', 'o_custkey', count(*) FILTER (o_custkey > 1000), round(max(o_custkey)::DOUBLE, 6), NULL FROM onull HAVING count(*) FILTER (o_custkey > 1000) > 0
UNION ALL SELECT 'below_min', 'o_totalprice', count(*) FILTER (o_totalprice < 1500), round(min(o_totalprice), 6), NULL FROM onull HAVING count(*) FILTER (o_totalprice < 1500) > 0
UNION ALL SELECT 'above_max', 'o_totalprice', count(*) FILTER (o_totalprice > 400000), round(max(o_totalprice), 6), NULL FROM onull HAVING count(*) FILTER (o_totalprice > 400000) > 0
UNION ALL SELECT 'below_min', 'pain', count(*) FILTER (pain < 0), round(min(pain)::DOUBLE, 6), NULL FROM onull HAVING count(*) FILTER (pain < 0) > 0
UNION ALL SELECT 'not_allowed', 'o_orderstatus', count(*), NULL, o_orderstatus FROM onull WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY o_orderstatus
UNION ALL SELECT 'not_allowed', 'o_orderpriority', count(*), NULL, o_orderpriority FROM onull WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_orderpriority""")
def contract_violations(spark, sf):
    return C.violations(orders_with_nulls(spark, sf), BROKEN_SPECS)


@query("null_profile", f"""
WITH {ON} SELECT c AS column_name, n AS n_null, round(n * 100.0::DOUBLE / t, 6) AS pct_null FROM (
 SELECT 'o_orderkey' AS c, count(*) FILTER (o_orderkey IS NULL) AS n, count(*) AS t FROM onull UNION ALL
 SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL), count(*) FROM onull UNION ALL
 SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), count(*) FROM onull UNION ALL
 SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), count(*) FROM onull)""")
def null_profile(spark, sf):
    return P.null_profile(orders_with_nulls(spark, sf), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("null_rate_by_class", f"""
WITH {ON}, g AS (SELECT o_orderstatus, count(*) AS n_rows, avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) AS a,
  avg(CASE WHEN pain = -1 THEN 1.0 ELSE 0.0 END) AS b FROM onull GROUP BY o_orderstatus)
SELECT o_orderstatus, n_rows, 'price_missing' AS column_name, round(a, 6) AS rate FROM g
UNION ALL SELECT o_orderstatus, n_rows, 'pain_not_recorded', round(b, 6) FROM g""")
def null_rate_by_class(spark, sf):
    return P.missing_rate_by(orders_with_nulls(spark, sf), "o_orderstatus",
                             {"price_missing": F.col("o_totalprice").isNull(), "pain_not_recorded": F.col("pain") == -1})


@query("quality_report", """
WITH d AS (SELECT p_name, p_type, p_size FROM part), c AS (SELECT p_type, count(*) AS n FROM d GROUP BY 1)
SELECT 'rows' AS metric, NULL AS label, count(*)::DOUBLE AS value FROM d
UNION ALL SELECT 'columns', NULL, 3.0 UNION ALL SELECT 'nulls', NULL, 0.0
UNION ALL SELECT 'duplicate_rows', NULL, sum(n - 1)::DOUBLE FROM (SELECT count(*) AS n FROM d GROUP BY ALL p_name, p_type, p_size)
UNION ALL SELECT 'imbalance', NULL, round(max(n) / min(n), 4) FROM c
UNION ALL SELECT 'class_count', p_type, n::DOUBLE FROM c
UNION ALL SELECT 'class_share', p_type, round(n / (SELECT sum(n) FROM c), 6) FROM c""".replace("GROUP BY ALL p_name", "GROUP BY p_name"))
def quality_report(spark, sf):
    return P.quality_report(table(spark, sf, "part").select("p_name", "p_type", "p_size"), "p_type")


@query("chat_contract", """
WITH c AS (SELECT conv_id, count(*) AS n_turns, arg_max(role, turn) AS last_role, max(turn) AS last_turn,
  min(turn) FILTER (role = 'user') AS first_user, count(*) FILTER (coalesce(trim(text, ' '), '') = '') AS n_blank FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, last_role, n_blank, concat_ws(',', CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' END,
  CASE WHEN coalesce(first_user >= last_turn, true) THEN 'no_user_before' END, CASE WHEN n_blank > 0 THEN 'blank_content' END) AS faults FROM c""")
def chat_contract(spark, sf):
    return C.chat_turn_faults(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("fold_contract", f"""
WITH {FO}, c AS (SELECT fold, l_returnflag, count(*) AS n FROM fo GROUP BY 1, 2),
s AS (SELECT fold, l_returnflag, n, n / sum(n) OVER (PARTITION BY fold) AS share, sum(n) OVER (PARTITION BY l_returnflag) / sum(n) OVER () AS overall FROM c)
SELECT fold, l_returnflag, n, round(share, 6) AS share, round(share - overall, 6) + 0.0 AS delta, abs(share - overall) <= 0.005 AS balanced,
  0::BIGINT AS unassigned, (SELECT count(*) FROM (SELECT 1 FROM fo GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1)) AS repeated_ids FROM s""")
def fold_contract_query(spark, sf):
    return fold_contract(folded(spark, sf), LINE_KEY, "l_returnflag")


@query("oof_coverage", """
WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 53 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 59 = 0 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 61 = 0),
i AS (SELECT coalesce(p.c, 0) AS p, coalesce(t.c, 0) AS t FROM (SELECT o_orderkey, count(*) AS c FROM p GROUP BY 1) p FULL JOIN (SELECT o_orderkey, count(*) AS c FROM orders GROUP BY 1) t USING (o_orderkey))
SELECT count(*) FILTER (p = 0) AS not_predicted, count(*) FILTER (t = 0) AS not_in_truth, count(*) FILTER (p > 1) AS predicted_twice,
  CAST(sum(p) AS BIGINT) AS n_predictions, CAST(sum(t) AS BIGINT) AS n_truth FROM i""")
def oof_coverage(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    pred = o.where(k % 53 != 0).unionByName(o.where(k % 59 == 0)).unionByName(o.where(k % 61 == 0).select((-k - 1).alias("o_orderkey")))
    return C.id_set_report(pred, o, ["o_orderkey"])


RECALLS = f"rc AS (SELECT y, avg(CASE WHEN y = {first_max(model_columns(1))} THEN 1.0 ELSE 0.0 END) AS r FROM sc GROUP BY y)"
FLOORS = {"recall_A": 0.7, "recall_N": 0.75, "recall_R": 0.8, "balanced_accuracy": 0.7, "absent_metric": 0.5}


@query("recall_gate", f"""
WITH {SC}, {RECALLS}, m AS (SELECT 'recall_' || CASE y WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS metric, r AS v FROM rc UNION ALL SELECT 'balanced_accuracy', avg(r) FROM rc),
f(gate, lim) AS (VALUES ('recall_A', 0.7::DOUBLE), ('recall_N', 0.75), ('recall_R', 0.8), ('balanced_accuracy', 0.7), ('absent_metric', 0.5))
SELECT gate, round(v, 6) AS observed, lim AS "limit", coalesce(round(v, 6) >= lim, false) AS passed FROM f LEFT JOIN m ON metric = gate
UNION ALL SELECT 'spread', round(max(r) - min(r), 6), 0.06::DOUBLE, round(max(r) - min(r), 6) <= 0.06 FROM rc""")
def recall_gate(spark, sf):
    d = scored(spark, sf).withColumn("yhat", argmax_columns([F.col(c) for c in model_columns(1)]))
    per = d.groupBy("y").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("value")).persist()
    name = F.element_at(F.array(*[F.lit(f"recall_{x}") for x in FLAGS]), F.col("y") + 1)
    rows = per.select(name.alias("metric"), "value").unionByName(per.agg(F.lit("balanced_accuracy").alias("metric"), F.avg("value").alias("value")))
    return C.floor_gate(rows, FLOORS, spread_of="recall_", spread_limit=0.06)


@query("metric_drift_gate", f"""
WITH {SC}, s AS (SELECT avg(score) AS v FROM {fold_scores_sql(first_max(model_columns(0)))})
SELECT round(v, 6) AS observed, 0.75::DOUBLE AS canonical, round(abs(v - 0.75), 6) AS gap, abs(v - 0.75) <= 0.0001 AS passed FROM s""")
def metric_drift_gate(spark, sf):
    return M.drift_gate(model_scores(spark, sf, 0).agg(F.avg("score").alias("score")), 0.75)


@query("score_fidelity", f"""
WITH {SC}, a AS (SELECT * FROM {fold_scores_sql(first_max(model_columns(0)))}), b AS (SELECT fold, round(score, 4) + CASE WHEN fold = 3 THEN 0.01 ELSE 0 END AS ref FROM a)
SELECT count(*) AS n_folds, count(*) FILTER (abs(score - ref) <= 0.0001 + 0.00001 * abs(ref)) AS n_close, round(max(abs(score - ref)), 6) AS max_gap,
  bool_and(abs(score - ref) <= 0.0001 + 0.00001 * abs(ref)) AS passed FROM a JOIN b USING (fold)""")
def score_fidelity(spark, sf):
    a = model_scores(spark, sf, 0).select("fold", "score")
    ref = a.select("fold", (F.round("score", 4) + F.when(F.col("fold") == 3, 0.01).otherwise(0.0)).alias("score"))
    return M.score_fidelity(a, ref)
