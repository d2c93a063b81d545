"""Registry and shared derived inputs of the registered queries, on the Spark side and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.folds import stratified_folds
from foldwise.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FLAGS = ["A", "N", "R"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
K = 5
N_MODELS = 3


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# ---- lineitem: row key, split, folds, three scored models ------------------------

LINE_MD5 = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey))"
LI = f"li AS (SELECT *, {LINE_MD5} AS row_key, CASE WHEN substr({LINE_MD5}, 1, 1) < '4' THEN 'test' ELSE 'train' END AS split FROM lineitem)"
FO = ("fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY "
      "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42'))) - 1) % 5 AS INTEGER) AS fold FROM lineitem)")
Y_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with its row key and split."""
    key = F.md5(F.concat_ws("|", *LINE_KEY))
    return table(spark, sf, "lineitem").withColumn("row_key", key).withColumn(
        "split", F.when(F.substring("row_key", 1, 1) < "4", "test").otherwise("train"))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("split = 'train'"), df.where("split = 'test'")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(table(spark, sf, "lineitem"), LINE_KEY, "l_returnflag", K)


def _raw(m: int, c: int) -> str:
    """Pseudo-score of model m for class c: integer arithmetic with a bonus for the true class."""
    return (f"(1 + ((CAST(l_quantity AS BIGINT) * {3 + m} + l_linenumber * {c + 1} + l_partkey * {m + c + 1}) % 7) "
            f"+ CASE WHEN y = {c} THEN {2 + m} ELSE 0 END)")


def _prob_exprs() -> list[str]:
    out = []
    for m in range(N_MODELS):
        s = " + ".join(_raw(m, c) for c in range(3))
        out += [f"CAST({_raw(m, c)} AS DOUBLE) / CAST({s} AS DOUBLE) AS p{m}_{c}" for c in range(3)]
    return out


SC = (f"{FO}, yl AS (SELECT *, CAST({Y_SQL} AS INTEGER) AS y FROM fo), "
      f"sc AS (SELECT *, {', '.join(_prob_exprs())} FROM yl)")


def with_scores(df: DataFrame) -> DataFrame:
    """Add class index y and three models' class probabilities p<m>_<c> to lineitem rows."""
    return df.withColumn("y", F.expr(f"CAST({Y_SQL} AS INT)")).selectExpr("*", *_prob_exprs())


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with scores, without folds: one scan and no shuffle."""
    return with_scores(table(spark, sf, "lineitem"))


def scored_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folded lineitem with scores."""
    return with_scores(folded(spark, sf))


def model_columns(m: int) -> list[str]:
    return [f"p{m}_{c}" for c in range(3)]


def first_max(cols: list[str]) -> str:
    """SQL for the index of the first maximum."""
    g = f"greatest({', '.join(cols)})"
    whens = " ".join(f"WHEN {c} = {g} THEN {i}" for i, c in enumerate(cols))
    return f"CAST(CASE {whens} END AS INTEGER)"


# ---- orders: five ordinal classes -------------------------------------------------

def _oraw(c: int) -> str:
    return (f"(1 + ((o_orderkey * {c + 2} + o_custkey) % 5) + CASE WHEN y = {c} THEN 6 WHEN abs(y - {c}) = 1 THEN 2 ELSE 0 END)")


def _oprob() -> list[str]:
    s = " + ".join(_oraw(c) for c in range(5))
    return [f"CAST({_oraw(c)} AS DOUBLE) / CAST({s} AS DOUBLE) AS q{c}" for c in range(5)]


OS = ("oy AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y FROM orders), "
      f"os AS (SELECT *, {', '.join(_oprob())} FROM oy)")
OQ = [f"q{c}" for c in range(5)]


def ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """orders with ordinal class y in 0..4 and probabilities q0..q4."""
    d = table(spark, sf, "orders").withColumn("y", F.expr("CAST(substr(o_orderpriority, 1, 1) AS INT) - 1"))
    return d.selectExpr("*", *_oprob())


# ---- orders with derived nulls ------------------------------------------------------

ON = ("onull AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS o_orderstatus, "
      "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice, "
      "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority, "
      "CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 10 END AS INTEGER) AS pain FROM orders)")


def orders_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority",
        "CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 10 END AS INT) AS pain")
