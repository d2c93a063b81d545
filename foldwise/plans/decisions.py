"""Blend, decision-rule, metric, comparison and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.num import argmax_columns, r6
from foldwise.operators import blend as B
from foldwise.operators import metrics as M
from foldwise.plans.common import FLAGS, K, LINE_KEY, OQ, OS, PRIORITIES, SC, first_max, model_columns, ordinal, query, scored, scored_folds
from foldwise.plans.quality import fold_scores_sql, model_scores
from foldwise.sources.tables import table

KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MATS = [model_columns(m) for m in range(3)]
NAMES = ["w0", "w1", "w2"]
W = (0.5, 0.2, 0.3)


def blend_sql(ws=("w0", "w1", "w2")) -> list[str]:
    raw = [" + ".join(f"{w} * p{m}_{c}" for m, w in enumerate(ws)) for c in range(3)]
    return [f"({r}) / (({raw[0]}) + ({raw[1]}) + ({raw[2]}))" for r in raw]


GRID = "gr AS (SELECT a / 12.0::DOUBLE AS w0, b / 12.0::DOUBLE AS w1, (12 - a - b) / 12.0::DOUBLE AS w2 FROM range(13) t(a), range(13) u(b) WHERE a + b <= 12)"
_b = blend_sql()
BC = (f"{SC}, {GRID}, bl AS (SELECT w0, w1, w2, fold, y, {_b[0]} AS b0, {_b[1]} AS b1, {_b[2]} AS b2 FROM sc, gr), "
      f"bc AS (SELECT w0, w1, w2, fold, y, sum(CASE WHEN {first_max(['b0', 'b1', 'b2'])} = y THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS n FROM bl GROUP BY ALL)")
DIST = "((w0 - 1/3.0::DOUBLE) ** 2 + (w1 - 1/3.0::DOUBLE) ** 2 + (w2 - 1/3.0::DOUBLE) ** 2)"
ORDER = f"round(score, 12) DESC, round({DIST}, 12), w0, w1, w2"
THIRD = 1.0 / 3.0


@query("soft_blend", f"""
WITH {SC}, b AS (SELECT {KEY_SQL}, {', '.join(f'{e} AS b{i}' for i, e in enumerate(blend_sql(['0.5::DOUBLE', '0.2::DOUBLE', '0.3::DOUBLE'])))} FROM sc)
SELECT {KEY_SQL}, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, CASE {first_max(['b0', 'b1', 'b2'])} WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS label FROM b""")
def soft_blend(spark, sf):
    d = scored(spark, sf).select(*LINE_KEY, *[F.array(*m).alias(f"m{i}") for i, m in enumerate(MATS)])
    d = B.soft_blend(d, ["m0", "m1", "m2"], W)
    return d.select(*LINE_KEY, *[r6(F.get("p_blend", F.lit(i))).alias(f"b{i}") for i in range(3)], B.decode_label(F.col("p_blend"), FLAGS).alias("label"))


def counts(spark, sf):
    return B.blend_counts(scored_folds(spark, sf).select("fold", "y", *[c for m in MATS for c in m]), MATS, "y")


@query("simplex_grid", f"""
WITH {BC}, s AS (SELECT w0, w1, w2, y, sum(hits) / sum(n) AS r FROM bc GROUP BY ALL)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(avg(r), 6) AS score FROM s GROUP BY s.w0, s.w1, s.w2""")
def simplex_grid(spark, sf):
    # The surface is over all folds, so rows are not dealt into any.
    whole = scored(spark, sf).select(F.lit(0).alias("fold"), "y", *[c for m in MATS for c in m])
    s = B.surface(B.blend_counts(whole, MATS, "y"), NAMES, "y")
    return s.select(*[r6(F.col(c)).alias(c) for c in [*NAMES, "score"]])


@query("blend_weights", f"""
WITH {BC}, s AS (SELECT w0, w1, w2, y, sum(hits) / sum(n) AS r FROM bc GROUP BY ALL), g AS (SELECT w0, w1, w2, avg(r) AS score FROM s GROUP BY ALL)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(score, 6) AS score FROM (SELECT * FROM g ORDER BY {ORDER} LIMIT 1)""")
def blend_weights(spark, sf):
    b = B.best_candidate(B.surface(counts(spark, sf), NAMES, "y"), NAMES, THIRD)
    return b.select(*[r6(F.col(c)).alias(c) for c in [*NAMES, "score"]])


NESTED = f"""{BC}, fl AS (SELECT DISTINCT fold AS k FROM bc),
ns AS (SELECT k, w0, w1, w2, y, sum(hits) FILTER (fold <> k) / sum(n) FILTER (fold <> k) AS i, sum(hits) FILTER (fold = k) / sum(n) FILTER (fold = k) AS o FROM bc, fl GROUP BY ALL),
ng AS (SELECT k AS fold, w0, w1, w2, avg(i) AS score, avg(o) AS held FROM ns GROUP BY ALL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {ORDER}) AS rn FROM ng) WHERE rn = 1)"""


@query("nested_blend", f"""
WITH {NESTED} SELECT fold, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(score, 6) AS inner_score, round(held, 6) AS score FROM nb""".replace("round(score, 6) AS inner_score, round(held, 6) AS score FROM nb", "round(nb.score, 6) AS inner_score, round(held, 6) AS score FROM nb"))
def nested_blend(spark, sf):
    n = B.nested_selection(counts(spark, sf), NAMES, "y", THIRD, K)
    return n.select("fold", *[r6(F.col(c)).alias(c) for c in [*NAMES, "inner_score", "score"]])


def qwk_sql(y: str, p: str, src: str) -> str:
    return f"1 - sum(({y} - {p}) ** 2)::DOUBLE / (sum({y} * {y} + {p} * {p}) - 2.0 * sum({y}) * sum({p}) / count(*))"


@query("softmax_weights", f"""
WITH {SC}, s AS ({' UNION ALL '.join(f"SELECT 'm{m}' AS model, (SELECT {qwk_sql('y', 'p', '')} FROM (SELECT y, {first_max(model_columns(m))} AS p FROM sc)) AS score" for m in range(3))}),
e AS (SELECT model, score, exp(score - (SELECT max(score) FROM s)) AS e FROM s)
SELECT model, round(score, 6) AS score, round(e / sum(e) OVER (), 6) AS weight FROM e""")
def softmax_weights(spark, sf):
    d = scored(spark, sf)
    preds = F.array(*[F.struct(F.lit(f"m{m}").alias("model"), argmax_columns([F.col(c) for c in model_columns(m)]).alias("p")) for m in range(3)])
    s = M.qwk(d.select("y", F.explode(preds).alias("x")).select("y", "x.model", "x.p"), "y", "p", ["model"]).withColumnRenamed("qwk", "score")
    return B.softmax(s, "score").select("model", r6(F.col("score")).alias("score"), r6(F.col("weight")).alias("weight"))


@query("temperature_softmax", f"""
WITH {SC}, s AS (SELECT {KEY_SQL}, p0_0 * 10 AS a, p0_1 * 10 AS b, p0_2 * 10 AS c FROM sc), m AS (SELECT *, greatest(a, b, c) AS mx FROM s),
e AS (SELECT {KEY_SQL}, exp((a - mx) / 0.5) AS a, exp((b - mx) / 0.5) AS b, exp((c - mx) / 0.5) AS c FROM m)
SELECT {KEY_SQL}, round(a / (a + b + c), 6) AS t0, round(b / (a + b + c), 6) AS t1, round(c / (a + b + c), 6) AS t2 FROM e""")
def temperature_softmax(spark, sf):
    d = scored(spark, sf).withColumn("t", B.softmax_array(F.array(*[F.col(c) * 10 for c in MATS[0]]), 0.5))
    return d.select(*LINE_KEY, *[r6(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(3)])


EV = "(0.0::DOUBLE * q0 + 1.0::DOUBLE * q1 + 2.0::DOUBLE * q2 + 3.0::DOUBLE * q3 + 4.0::DOUBLE * q4)"


@query("ordinal_decode", f"""
WITH {OS}, e AS (SELECT o_orderkey, y, {EV} AS ev, {first_max(OQ)} AS am FROM os)
SELECT o_orderkey, y + 1 AS level, round(ev, 6) AS expected, (CAST(ev >= 0.6 AS INTEGER) + CAST(ev >= 1.4 AS INTEGER) + CAST(ev >= 2.5 AS INTEGER) + CAST(ev >= 3.3 AS INTEGER)) + 1 AS decoded, am + 1 AS argmax_level FROM e""")
def ordinal_decode(spark, sf):
    q = [F.col(c) for c in OQ]
    return ordinal(spark, sf).select("o_orderkey", (F.col("y") + 1).alias("level"), r6(B.expected_value(q)).alias("expected"),
                                     (B.ordinal_decode(q, [0.6, 1.4, 2.5, 3.3]) + 1).alias("decoded"), (B.ordinal_decode(q, []) + 1).alias("argmax_level"))


GB = ", ".join(f"t{m}(j{m})" for m in range(4))


@query("ordinal_thresholds", f"""
WITH {OS}, e AS (SELECT y, CAST(floor({EV} * 10 + 1e-9) AS INTEGER) AS b, {first_max(OQ)} AS a FROM os), c AS (SELECT b, y, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
tot AS (SELECT sum(n) AS n, sum(n * y) AS sy, sum(n * y * y) AS sy2, sum(n * (y - 4) * (y - 4)) AS dtop FROM c),
am AS (SELECT {qwk_sql('y', 'a', 'e')} AS q FROM e),
po AS (SELECT unnest(range((SELECT min(b) FROM c), (SELECT max(b) + 2 FROM c))) AS p),
th AS MATERIALIZED (SELECT m, p, coalesce(sum(n * ((y - m) * (y - m) - (y - m - 1) * (y - m - 1))) FILTER (b < p), 0) AS g, coalesce(sum(n) FILTER (b < p), 0) AS cn,
  p - CAST(round((m + 0.5) * 10) AS INTEGER) AS j FROM c, range(4) t(m), po GROUP BY ALL),
f AS (SELECT a.p AS pa, b.p AS pb, cc.p AS pc, d.p AS pd, a.g + b.g + cc.g + d.g AS g, a.cn + b.cn + cc.cn + d.cn AS cs, -1 * a.cn - 3 * b.cn - 5 * cc.cn - 7 * d.cn AS c2,
    a.j * a.j + b.j * b.j + cc.j * cc.j + d.j * d.j AS dist
  FROM th a JOIN th b ON b.p >= a.p JOIN th cc ON cc.p >= b.p JOIN th d ON d.p >= cc.p WHERE a.m = 0 AND b.m = 1 AND cc.m = 2 AND d.m = 3),
s AS (SELECT pa, pb, pc, pd, 1 - (dtop + g) / (sy2 + 16 * n + c2 - 2 * sy * (4 * n - cs) / n) AS q, dist FROM f, tot)
SELECT round(pa * 0.1::DOUBLE, 6) AS t1, round(pb * 0.1::DOUBLE, 6) AS t2, round(pc * 0.1::DOUBLE, 6) AS t3, round(pd * 0.1::DOUBLE, 6) AS t4, round(s.q, 6) AS qwk,
  round(am.q, 6) AS argmax_qwk, s.q > am.q AS use_thresholds FROM s, am ORDER BY round(s.q, 10) DESC, dist, pa, pb, pc, pd LIMIT 1""")
def ordinal_thresholds(spark, sf):
    q = [F.col(c) for c in OQ]
    return B.ordinal_thresholds(ordinal(spark, sf), B.expected_value(q), argmax_columns(q), F.col("y"), 5)


MULT = (0.5, 0.75, 1.0, 1.25, 1.5)


@query("class_multipliers", f"""
WITH {SC}, v(x) AS (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25), (1.5)), mg AS (SELECT 1.0::DOUBLE AS m0, a.x AS m1, b.x AS m2 FROM v a, v b),
ml AS (SELECT m0, m1, m2, fold, y, p0_0 * m0 AS b0, p0_1 * m1 AS b1, p0_2 * m2 AS b2 FROM sc, mg),
mc AS (SELECT m0, m1, m2, fold, y, sum(CASE WHEN {first_max(['b0', 'b1', 'b2'])} = y THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM ml GROUP BY ALL),
fl AS (SELECT DISTINCT fold AS k FROM mc),
ns AS (SELECT k, m0, m1, m2, y, sum(hits) FILTER (fold <> k) / sum(n) FILTER (fold <> k) AS i, sum(hits) FILTER (fold = k) / sum(n) FILTER (fold = k) AS o FROM mc, fl GROUP BY ALL),
ng AS (SELECT k AS fold, m0, m1, m2, avg(i) AS score, avg(o) AS held FROM ns GROUP BY ALL)
SELECT fold, m0, m1, m2, round(score, 6) AS inner_score, round(held, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC,
  round((m0 - 1) ** 2 + (m1 - 1) ** 2 + (m2 - 1) ** 2, 12), m0, m1, m2) AS rn FROM ng) t WHERE rn = 1""".replace("round(score, 6) AS inner_score", "round(t.score, 6) AS inner_score"))
def class_multipliers(spark, sf):
    names = ["m0", "m1", "m2"]
    c = B.multiplier_counts(scored_folds(spark, sf).select("fold", "y", *MATS[0]), MATS[0], "y", MULT)
    n = B.nested_selection(c, names, "y", 1.0, K)
    return n.select("fold", *names, r6(F.col("inner_score")).alias("inner_score"), r6(F.col("score")).alias("score"))


def avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@query("rank_average", f"WITH {SC} SELECT {KEY_SQL}, round(({avg_rank('p0_1')} + {avg_rank('p1_1')} + {avg_rank('p2_1')}) / 3, 6) AS rank_score FROM sc")
def rank_average(spark, sf):
    d = B.rank_average(scored(spark, sf).select(*LINE_KEY, "p0_1", "p1_1", "p2_1"), ["p0_1", "p1_1", "p2_1"])
    return d.select(*LINE_KEY, r6(F.col("rank_score")).alias("rank_score"))


# ---- metrics -------------------------------------------------------------------------

PR = f"{SC}, pr AS (SELECT *, {first_max(model_columns(1))} AS p FROM sc)"


def predicted(spark, sf, m: int = 1):
    return scored(spark, sf).withColumn("p", argmax_columns([F.col(c) for c in model_columns(m)]))


CM = "cm AS (SELECT a.v AS actual, b.v AS predicted, count(pr.y) AS n FROM range(4) a(v) CROSS JOIN range(4) b(v) LEFT JOIN pr ON pr.y = a.v AND pr.p = b.v GROUP BY ALL)"


@query("confusion", f"""
WITH {PR}, {CM} SELECT actual::INTEGER AS actual, predicted::INTEGER AS predicted, n, round(coalesce(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 4) AS row_pct FROM cm""")
def confusion(spark, sf):
    return M.confusion(predicted(spark, sf), "y", "p", [0, 1, 2, 3])


@query("balanced_accuracy", f"""
WITH {SC}, s AS {fold_scores_sql(first_max(model_columns(1)))} SELECT count(*) AS n_folds, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s""")
def balanced_accuracy(spark, sf):
    return M.fold_summary(model_scores(spark, sf, 1))


@query("fold_scores", f"WITH {SC} SELECT fold, round(score, 6) AS score FROM {fold_scores_sql(first_max(model_columns(1)))}")
def fold_scores(spark, sf):
    return model_scores(spark, sf, 1).select("fold", r6(F.col("score")).alias("score"))


@query("class_recall", f"""
WITH {PR}, {CM} SELECT actual::INTEGER AS label, CAST(sum(n) AS BIGINT) AS support, round(coalesce(sum(n) FILTER (actual = predicted) / nullif(sum(n), 0), 0), 6) AS recall FROM cm GROUP BY 1""")
def class_recall(spark, sf):
    return M.class_recall(predicted(spark, sf), "y", "p", [0, 1, 2, 3])


@query("qwk", f"WITH {OS}, e AS (SELECT y, {first_max(OQ)} AS a FROM os) SELECT count(*) AS n, round({qwk_sql('y', 'a', 'e')}, 6) AS qwk FROM e")
def qwk(spark, sf):
    d = ordinal(spark, sf).withColumn("a", argmax_columns([F.col(c) for c in OQ]))
    return M.qwk(d, "y", "a").select("n", r6(F.col("qwk")).alias("qwk"))


@query("class_report", f"""
WITH {PR}, {CM}, t AS (SELECT v AS label, (SELECT sum(n) FROM cm WHERE actual = v) AS support, (SELECT sum(n) FROM cm WHERE predicted = v) AS pred, (SELECT sum(n) FROM cm WHERE actual = v AND predicted = v) AS tp FROM range(4) r(v)),
m AS (SELECT CAST(label AS VARCHAR) AS label, support::BIGINT AS support, coalesce(tp / nullif(pred, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, coalesce(2 * tp / nullif(pred + support, 0), 0) AS f, tp FROM t)
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m
UNION ALL SELECT 'macro avg', sum(support)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m
UNION ALL SELECT 'accuracy', sum(support)::BIGINT, NULL, NULL, round(sum(tp) / sum(support), 6) FROM m""")
def class_report(spark, sf):
    return M.class_report(predicted(spark, sf), "y", "p", [0, 1, 2, 3])


def delta_sql(a: str, b: str) -> str:
    return (f"SELECT count(*) AS n_folds, true AS matched, round(avg(a.s - b.s), 6) + 0.0 AS diff_mean, round(stddev_samp(a.s - b.s) / sqrt(count(*)), 6) AS diff_sem, "
            f"avg(a.s - b.s) > 2 * stddev_samp(a.s - b.s) / sqrt(count(*)) AS defensible FROM {a} a JOIN {b} b USING (fold)")


@query("paired_delta", f"WITH {SC} {delta_sql(fold_scores_sql(first_max(model_columns(1)), 's'), fold_scores_sql(first_max(model_columns(0)), 's'))}")
def paired_delta(spark, sf):
    return M.paired_delta(model_scores(spark, sf, 1), model_scores(spark, sf, 0))


EQ = "(SELECT fold, avg(r) AS s FROM (SELECT fold, y, sum(hits) / sum(n) AS r FROM bc WHERE abs(w0 - 1/3.0) < 1e-9 AND abs(w1 - 1/3.0) < 1e-9 GROUP BY ALL) GROUP BY fold)"


@query("ship_decision", f"""
WITH {NESTED}, ref AS (SELECT * FROM {fold_scores_sql(first_max(model_columns(2)), 's')}), e AS ({delta_sql(EQ, 'ref')}), n AS ({delta_sql('(SELECT fold, held AS s FROM nb)', 'ref')})
SELECT e.diff_mean AS equal_gain, n.diff_mean AS nested_gain, CASE WHEN e.defensible THEN 'equal' WHEN n.defensible THEN 'nested_weights' ELSE 'none' END AS shipped FROM e, n""")
def ship_decision(spark, sf):
    c = counts(spark, sf).persist()
    ref = model_scores(spark, sf, 2).select("fold", "score")
    near = lambda n: F.abs(F.col(n) - THIRD) < 1e-9
    eq = c.where(near("w0") & near("w1")).groupBy("fold", "y").agg((F.sum("hits") / F.sum("n")).alias("r")).groupBy("fold").agg(F.avg("r").alias("score"))
    nested = B.nested_selection(c, NAMES, "y", THIRD, K).select("fold", "score")
    return M.ship_decision(M.paired_delta(eq, ref), M.paired_delta(nested, ref))


@query("error_types", f"""
WITH {OS}, e AS (SELECT y + 1 AS actual, {first_max(OQ)} + 1 AS predicted FROM os)
SELECT CASE WHEN predicted > actual THEN 'under' ELSE 'over' END AS error, actual, predicted, count(*) AS n FROM e WHERE actual <> predicted GROUP BY ALL""")
def error_types(spark, sf):
    d = ordinal(spark, sf).select((F.col("y") + 1).alias("y"), (argmax_columns([F.col(c) for c in OQ]) + 1).alias("p"))
    return M.error_types(d, "y", "p")


@query("fairness_table", f"""
WITH {OS}, e AS (SELECT y + 1 AS y, {first_max(OQ)} + 1 AS p, o_orderstatus, c_mktsegment, n_name FROM os JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS level, y, p FROM e UNION ALL SELECT 'c_mktsegment', c_mktsegment, y, p FROM e UNION ALL SELECT 'n_name', n_name, y, p FROM e),
g AS (SELECT dimension, level, count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS acc, avg(CASE WHEN p > y THEN 1.0 ELSE 0 END) AS un, count(*) FILTER (y = 1) AS nc, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FILTER (y = 1) AS cr FROM l GROUP BY ALL)
SELECT dimension, level, n, round(acc, 6) AS accuracy, round(un, 6) AS under_rate, nc AS n_critical, round(cr, 6) AS critical_recall,
 round(max(acc) OVER (PARTITION BY dimension) - min(acc) OVER (PARTITION BY dimension), 6) AS accuracy_gap FROM g""")
def fairness_table(spark, sf):
    o = ordinal(spark, sf).select("o_custkey", "o_orderstatus", (F.col("y") + 1).alias("y"), (argmax_columns([F.col(c) for c in OQ]) + 1).alias("p"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.fairness_table(d, ["o_orderstatus", "c_mktsegment", "n_name"], "y", "p", 1)


@query("label_shift", f"""
WITH {OS}, e AS (SELECT o_orderkey, y + 1 AS y, {first_max(OQ)} + 1 AS p FROM os), t AS (SELECT y AS label, count(*) AS n FROM e WHERE o_orderkey % 4 <> 0 GROUP BY 1), q AS (SELECT p AS label, count(*) AS n FROM e WHERE o_orderkey % 4 = 0 GROUP BY 1),
j AS (SELECT v::INTEGER AS label, coalesce(t.n, 0) AS nt, coalesce(q.n, 0) AS np FROM range(1, 7) r(v) LEFT JOIN t ON t.label = v LEFT JOIN q ON q.label = v)
SELECT label, nt AS n_train, np AS n_predicted, round(nt / sum(nt) OVER (), 6) AS train_share, round(np / sum(np) OVER (), 6) AS predicted_share, round(np / sum(np) OVER () - nt / sum(nt) OVER (), 6) + 0.0 AS shift FROM j""")
def label_shift(spark, sf):
    d = ordinal(spark, sf).select("o_orderkey", (F.col("y") + 1).alias("y"), (argmax_columns([F.col(c) for c in OQ]) + 1).alias("p"))
    return M.label_shift(d.where("o_orderkey % 4 <> 0"), d.where("o_orderkey % 4 = 0"), "y", "p", [1, 2, 3, 4, 5, 6])


COEF = {"A": {"l_quantity": 0.5, "l_discount": -2.0}, "N": {"l_quantity": -0.25, "l_discount": 1.5}, "R": {"l_quantity": 0.1, "l_discount": 0.75}}


@query("linear_contributions", """
WITH a AS (SELECT avg(abs(l_quantity - mq)) AS q, avg(abs(l_discount - md)) AS d FROM lineitem, (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem)),
c(class, feature, k) AS (VALUES ('A', 'l_quantity', 0.5::DOUBLE), ('A', 'l_discount', -2.0), ('N', 'l_quantity', -0.25), ('N', 'l_discount', 1.5), ('R', 'l_quantity', 0.1), ('R', 'l_discount', 0.75)),
v AS (SELECT class, feature, abs(k) * CASE feature WHEN 'l_quantity' THEN q ELSE d END AS v FROM c, a)
SELECT class, feature, round(v, 6) AS mean_abs, round(avg(v) OVER (PARTITION BY feature), 6) AS global_abs FROM v""")
def linear_contributions(spark, sf):
    return B.linear_contributions(table(spark, sf, "lineitem"), COEF)
