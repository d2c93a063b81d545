"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import profile as P
from foldwise.operators.encode import group_stats
from foldwise.plans.common import FLAGS, LI, PRIORITIES, lines, query, sides
from foldwise.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stacked(cols, source="lineitem", extra="", where="") -> str:
    """SQL that unpivots numeric columns."""
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v{extra} FROM {source}{where}" for c in cols) + ")"


@query("class_distribution", "SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def class_distribution(spark, sf):
    return P.class_distribution(table(spark, sf, "lineitem"), "l_returnflag")


@query("numeric_by_class", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median,
  round(stddev_samp(l_extendedprice), 6) AS std, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95,
  round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY 1""")
def numeric_by_class(spark, sf):
    return P.numeric_by_class(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@query("median_matrix", f"SELECT l_returnflag, feature, round(median(v), 6) AS median FROM {stacked(NUM, extra=', l_returnflag')} GROUP BY 1, 2")
def median_matrix(spark, sf):
    return P.median_matrix(table(spark, sf, "lineitem"), NUM, "l_returnflag")


@query("crosstab_norm", "SELECT p_brand, count(*) AS n_rows, " + ", ".join(
    f"round(count(*) FILTER (p_type = '{t}') / count(*), 4) AS \"{t}\"" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ABSENT"]) + " FROM part GROUP BY 1")
def crosstab_norm(spark, sf):
    return P.crosstab_normalised(table(spark, sf, "part"), "p_brand", "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ABSENT"])


@query("class_share_by_group", "SELECT c_mktsegment, count(*) AS n_rows, " + ", ".join(
    f"round(count(*) FILTER (o_orderpriority = '{p}') * 100.0::DOUBLE / count(*), 4) AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def class_share_by_group(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return P.crosstab_normalised(d, "c_mktsegment", "o_orderpriority", PRIORITIES, scale=100.0)


@query("rater_variability", """
SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1 HAVING count(*) >= 100""")
def rater_variability(spark, sf):
    return P.rater_table(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity")


@query("group_gap", """
SELECT dimension, count(*) AS n_groups, round(min(m), 6) AS lowest, round(max(m), 6) AS highest, round(max(m) - min(m), 6) AS gap FROM (
 SELECT 'l_suppkey' AS dimension, avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey UNION ALL
 SELECT 'l_linestatus', avg(l_quantity) FROM lineitem GROUP BY l_linestatus) GROUP BY 1""")
def group_gap(spark, sf):
    return P.group_gap(table(spark, sf, "lineitem"), ["l_suppkey", "l_linestatus"], "l_quantity")


@query("distinct_counts", "SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem")
def distinct_counts(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey", "l_returnflag"])


@query("univariate_summary", f"""
SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(skewness(v), 6) + 0.0 AS skew,
  round(kurtosis(v), 6) AS kurtosis, 0.0::DOUBLE AS null_share FROM {stacked(NUM)} GROUP BY 1""")
def univariate_summary(spark, sf):
    return P.univariate_summary(table(spark, sf, "lineitem"), NUM)


@query("normality", f"""
WITH a AS (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS mu FROM {stacked(NUM)}),
m AS (SELECT feature, count(*)::DOUBLE AS n, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM a GROUP BY 1),
g AS (SELECT feature, n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) AS b2 FROM m),
z AS (SELECT feature, n, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS be,
  (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
  6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM g),
w AS (SELECT *, sqrt(2*(be-1)) - 1 AS w2, 6 + 8/s*(2/s + sqrt(1 + 4/(s*s))) AS aa FROM z),
u AS (SELECT *, ln(y/sqrt(2/(w2-1)) + sqrt((y/sqrt(2/(w2-1)))**2 + 1)) / sqrt(0.5*ln(w2)) AS z1, 1 + x*sqrt(2/(aa-4)) AS d FROM w),
k AS (SELECT feature, n, z1*z1 + ((1 - 2/(9*aa) - sign(d)*((1-2/aa)/abs(d))**(1.0/3.0)) / sqrt(2/(9*aa)))**2 AS k2 FROM u)
SELECT feature, n::BIGINT AS n, round(k2, 4) AS k2, round(exp(-k2/2), 6) AS p_value FROM k""")
def normality(spark, sf):
    return P.normality(table(spark, sf, "lineitem"), NUM)


@query("histogram", """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT bin, round(lo + bin * ((hi - lo) / 80), 6) AS left_edge, n FROM (
 SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 80)), 79) AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM orders, r GROUP BY 1)""")
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice")


@query("integer_density", """
SELECT l_returnflag, bin, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS density FROM (
 SELECT l_returnflag, CAST(floor(l_quantity) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def integer_density(spark, sf):
    return P.integer_density(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")


@query("box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS md, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT l.l_returnflag, l_extendedprice AS v, q1, md, q3, l_extendedprice >= q1 - 1.5*(q3-q1) AND l_extendedprice <= q3 + 1.5*(q3-q1) AS ok FROM lineitem l JOIN q USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (ok), 6) AS whisker_low, round(max(v) FILTER (ok), 6) AS whisker_high, count(*) FILTER (NOT ok) AS n_outliers FROM j GROUP BY 1""")
def box_stats(spark, sf):
    return P.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@query("clipped_histogram", """
WITH c AS (SELECT quantile_cont(l_extendedprice, 0.99) AS cap FROM lineitem), v AS (SELECT l_returnflag, least(l_extendedprice, cap) AS x FROM lineitem, c),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT l_returnflag, bin, round(lo + bin * ((hi - lo) / 80), 6) AS left_edge, n FROM (
 SELECT l_returnflag, CAST(least(floor((x - lo) / ((hi - lo) / 80)), 79) AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM v, r GROUP BY 1, 2)""")
def clipped_histogram(spark, sf):
    return P.clipped_histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


PART_SPLIT = "pt AS (SELECT p_name, p_type, p_size, CASE WHEN substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split FROM part)"


def part_split(spark, sf):
    d = table(spark, sf, "part").withColumn("split", F.when(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 1) < "4", "test").otherwise("train"))
    return sides(d)


@query("duplicate_report", f"""
WITH {PART_SPLIT}, g AS (SELECT p_name, p_type, p_size, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM pt GROUP BY 1, 2, 3)
SELECT CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS extra_rows, count(*) FILTER (a > 1) AS duplicated_groups, count(*) FILTER (a > 0 AND b > 0) AS cross_split FROM g""")
def duplicate_report(spark, sf):
    return P.duplicate_report(*part_split(spark, sf), ["p_name", "p_type", "p_size"])


@query("cross_split_overlap", f"""
WITH {PART_SPLIT} SELECT p_name, p_type, p_size FROM pt WHERE split = 'train' INTERSECT SELECT p_name, p_type, p_size FROM pt WHERE split = 'test'""")
def cross_split_overlap(spark, sf):
    return P.cross_split_overlap(*part_split(spark, sf), ["p_name", "p_type", "p_size"])


@query("keep_first", """
SELECT p_name, p_type, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY 1, 2""")
def keep_first(spark, sf):
    return P.keep_first(table(spark, sf, "part").select("p_name", "p_type", "p_partkey", "p_size"), ["p_name", "p_type"], ["p_partkey"])


@query("complaint_rollup", """
SELECT source, count(*) AS n, round(avg(quality::DOUBLE), 6) AS mean_target, round(avg(length(text)::DOUBLE), 6) AS mean_chars
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def complaint_rollup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text").join(table(spark, sf, "labels"), "doc_id")
    return P.group_text_rollup(d, "source", "text", "quality")
