"""Association, leakage and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import assoc as A
from foldwise.operators import neighbours as N
from foldwise.plans.common import LI, LINE_KEY, SC, lines, query, scored, sides
from foldwise.plans.profiles import NUM, stacked
from foldwise.sources.tables import table

OC = ("oc AS (SELECT o_orderkey, o_orderstatus, c_mktsegment, o_orderpriority, o_totalprice, c_acctbal, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)")


def orders_customers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def corr_cells(cols, src) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + f" AS r FROM {src}"
        for a in cols for b in cols if a != b) + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0::DOUBLE" for a in cols)


@query("pearson_matrix", corr_cells(NUM, "lineitem"))
def pearson_matrix(spark, sf):
    return A.pearson_matrix(table(spark, sf, "lineitem"), NUM)


SP = ["l_quantity", "l_extendedprice", "l_discount"]


@query("spearman_matrix", "WITH rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in SP) + " FROM lineitem) " + corr_cells(SP, "rk"))
def spearman_matrix(spark, sf):
    return A.spearman_matrix(table(spark, sf, "lineitem"), SP, LINE_KEY)


@query("target_correlation", f"""
SELECT feature, count(v) AS n, round(corr(v, t), 6) + 0.0 AS r, round(abs(corr(v, t)), 6) AS abs_r FROM (
 SELECT feature, v, t FROM {stacked(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber'], source="(SELECT * REPLACE (CASE WHEN l_orderkey % 9 <> 0 THEN l_tax END AS l_tax) FROM lineitem)", extra=', l_extendedprice AS t')}) GROUP BY 1""")
def target_correlation(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_tax")))
    return A.target_correlation(d, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")


@query("entropy", "SELECT CAST(sum(n) AS BIGINT) AS n, round(-sum(p * ln(p)), 6) AS h_nats FROM (SELECT count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderpriority)")
def entropy(spark, sf):
    return A.entropy(table(spark, sf, "orders"), "o_orderpriority")


def joint_sql(features, target, src) -> str:
    """Joint counts and the association statistics of categorical columns against a target."""
    cells = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS x, {target} AS y FROM {src} WHERE {f} IS NOT NULL" for f in features)
    return f"""jc AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY 1, 2, 3),
jm AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS tot FROM jc),
ja AS (SELECT feature, any_value(tot) AS tot, count(DISTINCT x)::DOUBLE AS r, count(DISTINCT y)::DOUBLE AS k, greatest(0.0, sum(n / tot * ln(n * tot / (nx * ny)))) AS mi,
  sum(n * n / (nx * ny)) - 1 AS phi2 FROM jm GROUP BY feature),
jh AS (SELECT feature, -sum(ny / tot * ln(ny / tot)) AS h FROM (SELECT DISTINCT feature, y, ny, tot FROM jm) GROUP BY feature),
jv AS (SELECT feature, tot, r, k, mi, h, CASE WHEN r > 1 AND k > 1 THEN sqrt(greatest(0, phi2 - (k-1)*(r-1)/(tot-1)) / least(k - (k-1)*(k-1)/(tot-1) - 1, r - (r-1)*(r-1)/(tot-1) - 1)) ELSE 0 END AS v FROM ja JOIN jh USING (feature))"""


@query("mutual_information", f"WITH {OC}, {joint_sql(['o_orderstatus', 'c_mktsegment', 'o_custkey'], 'o_orderpriority', 'oc')} SELECT feature, tot::BIGINT AS n, r::BIGINT AS n_values, round(mi, 6) AS mi_nats, round(mi / h, 6) AS mi_fraction FROM jv")
def mutual_information(spark, sf):
    a = A.association(A.joint_counts(orders_customers(spark, sf), ["o_orderstatus", "c_mktsegment", "o_custkey"], "o_orderpriority"))
    return a.select("feature", "n", "n_values", F.round("mi", 6).alias("mi_nats"), F.round(F.col("mi") / F.col("h_target"), 6).alias("mi_fraction"))


BAND = "CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END"


@query("cramers_v", f"WITH {joint_sql(['l_linestatus', 'l_returnflag', 'l_linenumber'], 'l_returnflag', 'lineitem')} SELECT feature, tot::BIGINT AS n, round(v, 6) AS cramers_v, {BAND} AS band FROM jv")
def cramers_v(spark, sf):
    a = A.association(A.joint_counts(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag", "l_linenumber"], "l_returnflag"))
    return a.select("feature", "n", F.round("cramers_v", 6).alias("cramers_v"), A.effect_band(F.col("cramers_v")).alias("band"))


@query("cramers_v_yates", """
WITH c AS (SELECT l_linestatus AS x, l_returnflag = 'N' AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS e, sum(n) OVER () AS tot FROM c),
s AS (SELECT any_value(tot) AS n, sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e) / any_value(tot) AS phi2 FROM m)
SELECT 'l_linestatus' AS feature, n::BIGINT AS n, round(sqrt(greatest(0, phi2 - 1/(n-1)) / (1 - 1/(n-1))), 6) AS cramers_v FROM s""")
def cramers_v_yates(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("is_n", (F.col("l_returnflag") == "N").cast("string"))
    return A.association(A.joint_counts(d, ["l_linestatus"], "is_n"), yates=True).select("feature", "n", F.round("cramers_v", 6).alias("cramers_v"))


def width_bin(c, bins) -> str:
    return f"CAST(least(greatest(ceil(({c} - lo) / ((hi - lo) / {bins}.0::DOUBLE)), 1), {bins}) AS INTEGER) - 1"


@query("id_mi", f"""
WITH r AS (SELECT min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders), b AS (SELECT {width_bin('o_orderkey', 256)} AS bin, o_orderpriority FROM orders, r),
{joint_sql(['bin'], 'o_orderpriority', 'b')} SELECT tot::BIGINT AS n, r::BIGINT AS n_bins, round(mi, 6) AS mi_nats FROM jv""")
def id_mi(spark, sf):
    d = A.equal_width_bin(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 256)
    return A.association(A.joint_counts(d, ["bin"], "o_orderpriority")).select("n", F.col("n_values").alias("n_bins"), F.round("mi", 6).alias("mi_nats"))


def qbin(c, bins) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN len(list_filter(list_distinct({c}_e), lambda x: x < {c})) END"


def edges_sql(cols, bins, src) -> str:
    ps = ", ".join(repr(i / bins) for i in range(1, bins))
    return "SELECT " + ", ".join(f"quantile_cont({c}, [{ps}]) AS {c}_e" for c in cols) + f" FROM {src}"


@query("numeric_mi_binned", f"""
WITH e AS ({edges_sql(NUM, 32, 'lineitem')}), b AS (SELECT l_returnflag, {', '.join(f'{qbin(c, 32)} AS {c}_b' for c in NUM)} FROM lineitem, e),
{joint_sql([f'{c}_b' for c in NUM], 'l_returnflag', 'b')} SELECT feature, tot::BIGINT AS n, r::BIGINT AS n_bins, round(mi, 6) AS mi_nats FROM jv""")
def numeric_mi_binned(spark, sf):
    d = A.quantile_bins(table(spark, sf, "lineitem"), NUM, 32, "_b")
    return A.association(A.joint_counts(d, [f"{c}_b" for c in NUM], "l_returnflag")).select(
        "feature", "n", F.col("n_values").alias("n_bins"), F.round("mi", 6).alias("mi_nats"))


AUDIT_SQL = f"""
WITH {OC}, e AS ({edges_sql(['o_totalprice', 'c_acctbal'], 32, 'oc')}), w AS (SELECT min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM oc),
b AS (SELECT o_orderpriority, o_orderstatus, c_mktsegment, {qbin('o_totalprice', 32)} AS o_totalprice, {qbin('c_acctbal', 32)} AS c_acctbal, {width_bin('o_orderkey', 256)} AS o_orderkey FROM oc, e, w),
{joint_sql(['o_orderstatus', 'c_mktsegment', 'o_totalprice', 'c_acctbal', 'o_orderkey'], 'o_orderpriority', 'b')}
SELECT feature, round(mi, 6) AS mi_nats, round(mi / h, 6) AS mi_fraction, CASE WHEN feature IN ('o_orderstatus', 'c_mktsegment') THEN round(v, 6) END AS cramers_v,
 CASE WHEN feature IN ('o_orderstatus', 'c_mktsegment') THEN {BAND} ELSE 'n/a' END AS band,
 CASE WHEN feature = 'o_orderkey' THEN 'DROP' WHEN mi / h >= 0.95 THEN 'REVIEW' ELSE 'USE' END AS verdict FROM jv"""


@query("leakage_audit", AUDIT_SQL)
def leakage_audit(spark, sf):
    return A.leakage_audit(orders_customers(spark, sf), "o_orderpriority", ["o_orderstatus", "c_mktsegment"], ["o_totalprice", "c_acctbal"], "o_orderkey")


@query("deterministic_values", """
WITH c AS (SELECT 'l_linestatus' AS feature, l_linestatus AS value, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL
 UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR), l_returnflag, count(*) FROM lineitem GROUP BY ALL)
SELECT feature, value, CAST(sum(n) AS BIGINT) AS support, first(y ORDER BY n DESC, y) AS top_class, round(max(n) / sum(n), 6) AS max_share,
 max(n) / sum(n) >= 0.99 AND sum(n) >= 1 AS flagged FROM c GROUP BY 1, 2""")
def deterministic_values(spark, sf):
    return A.deterministic_values(table(spark, sf, "lineitem"), ["l_linestatus", "l_quantity"], "l_returnflag")


@query("ks_drift", f"""
WITH {LI}, s AS (SELECT feature, v, split FROM {stacked(NUM, source='li', extra=', split')}),
g AS (SELECT feature, v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM s GROUP BY 1, 2),
c AS (SELECT feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM g
  WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
d AS (SELECT feature, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(fa - fb)) AS d FROM c GROUP BY 1),
l AS (SELECT *, d * d * n1::DOUBLE * n2 / (n1 + n2) AS lam FROM d)
SELECT feature, n1, n2, round(d, 6) AS ks, CASE WHEN lam < 0.04 THEN 1.0 ELSE round(least(greatest(list_sum([2 * (-1.0) ** (j - 1) * exp(-2.0 * j * j * lam) for j in range(1, 21)]), 0), 1), 6) END AS p_value,
  d > 0.05 AS drift FROM l""")
def ks_drift(spark, sf):
    return A.ks_drift(*sides(lines(spark, sf)), NUM)


@query("kruskal_wallis", f"""
WITH s AS (SELECT feature, v, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS r FROM {stacked(NUM, extra=', l_returnflag AS y')}),
q AS (SELECT feature, sum(q) AS q, count(*) AS k FROM (SELECT feature, y, sum(r) ** 2 / count(*) AS q FROM s GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT feature, sum(c)::DOUBLE AS n, sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT feature, v, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT feature, n, k, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS h FROM q JOIN t USING (feature))
SELECT feature, n::BIGINT AS n, k, round(h, 4) AS h, round(h / (n - 1), 6) AS epsilon_sq FROM h""")
def kruskal_wallis(spark, sf):
    return A.kruskal_wallis(table(spark, sf, "lineitem"), NUM, "l_returnflag")


@query("roc_auc", f"""
WITH {SC}, r AS (SELECT y = 1 AS pos, rank() OVER (ORDER BY p0_1) + (count(*) OVER (PARTITION BY p0_1) - 1) / 2.0::DOUBLE AS r FROM sc),
s AS (SELECT count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(r) FILTER (pos) AS sr FROM r)
SELECT n_pos, n_neg, round((sr - n_pos::DOUBLE * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg), 6) AS auc FROM s""")
def roc_auc(spark, sf):
    return A.roc_auc(scored(spark, sf), "p0_1", F.col("y") == 1)


# ---- nearest neighbours --------------------------------------------------------------------

def psi(n: str) -> str:
    y = f"({n}::DOUBLE + 6)"
    return (f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * {y} * {y} * {y} * {y}) - 1 / (252 * {y} * {y} * {y} * {y} * {y} * {y}) - ("
            + " + ".join(f"1 / ({n}::DOUBLE + {j})" for j in range(6)) + "))")


NEAR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("neighbour_mi", f"""
WITH l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, l_returnflag AS y, {c}::DOUBLE AS v FROM lineitem" for c in NEAR)}),
c AS (SELECT feature, y, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, y) AS nc FROM l GROUP BY feature, y, v),
w AS (SELECT *, list({{'v': v, 'n': n}}) OVER (PARTITION BY feature, y ORDER BY v ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, least(3, nc - 1) AS k FROM c WHERE nc > 1),
d AS (SELECT feature, y, v, n, nc, k, list_sort(flatten(list_transform(near, lambda x: list_transform(range(0, least(4, CASE WHEN x.v = w.v THEN x.n - 1 ELSE x.n END)), lambda i: abs(x.v - w.v)))))[CAST(k AS BIGINT)] AS d FROM w),
a AS (SELECT feature, v, sum(n) AS n FROM (SELECT feature, v, n FROM c WHERE nc > 1 UNION ALL SELECT feature, v - d, 0 FROM d UNION ALL SELECT feature, v + d, 0 FROM d) GROUP BY feature, v),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY v) - n AS before FROM a),
m AS (SELECT d.*, CASE WHEN d.d = 0 THEN lo.n ELSE hi.before - (lo.before + lo.n) END AS m FROM d JOIN t lo ON lo.feature = d.feature AND lo.v = d.v - d.d JOIN t hi ON hi.feature = d.feature AND hi.v = d.v + d.d),
e AS (SELECT feature, sum(n) AS total, sum(n * {psi('k')}) AS pk, sum(n * {psi('nc')}) AS pc, sum(n * {psi('greatest(m, 1)')}) AS pm FROM m GROUP BY feature)
SELECT feature, total::BIGINT AS n, round(greatest({psi('total')} + (pk - pc - pm) / total, 0.0), 6) AS mi FROM e""")
def neighbour_mi(spark, sf):
    return N.neighbour_mi(table(spark, sf, "lineitem"), NEAR, "l_returnflag")
