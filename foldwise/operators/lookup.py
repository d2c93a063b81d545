"""Joining a fitted table onto a large one.

The fitted side is broadcast only after its bytes have been counted. Beyond
the limit the join is a shuffle join, where adaptive execution splits skewed
partitions of the large side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate that several steps read. Lost blocks are recomputed from the lineage."""
    df = df.persist()
    _KEPT.append(df)
    return df


def release() -> None:
    """Drop every kept intermediate; call it once the results that used them are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def spread(df: DataFrame, key: Sequence[str], rows: int = 20_000) -> DataFrame:
    """Deal a table of small rows out by key before costly work on each row, which a small file would leave to one task.

    A task has about `rows` rows, fewer as long as that makes work for all cores, but no fewer than some hundred.
    """
    n = df.count()
    few = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n // 500, max(few, n // rows))), *key)


def estimated_bytes(df: DataFrame) -> int:
    """Rows times the fixed width of their columns, and the bytes of texts and of what else has no fixed width."""
    loose = [F.length(F.to_json(F.struct(c))) if not t.startswith(("string", "binary")) else F.octet_length(c)
             for c, t in df.dtypes if t.startswith(("string", "binary", "array", "map", "struct"))]
    more = sum((F.coalesce(x, F.lit(0)).cast("bigint") for x in loose), F.lit(0).cast("bigint"))
    n, text = df.agg(F.count(F.lit(1)), F.sum(more)).first()
    return n * (16 + 16 * len(df.columns)) + (text or 0)


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a fitted table once and mark it for broadcast if its bytes are few."""
    df = keep(df)
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def attach(big: DataFrame, fitted: DataFrame, on: Sequence[str], how: str = "left",
           limit: int = BROADCAST_BYTES) -> DataFrame:
    return big.join(sized(fitted, limit), list(on), how)


class NotUniqueError(ValueError):
    """A lookup side repeats a key, so a left join would multiply rows."""


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    dup = df.groupBy(*key).count().where("count > 1").limit(1).count()
    if dup:
        raise NotUniqueError(f"lookup side has repeated keys in {list(key)}")
    return df


def left_chain(base: DataFrame, *sides: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """Left-join several 1:1 side tables onto a base by the same key."""
    for side in sides:
        base = base.join(require_unique(side, on) if check else side, list(on), "left")
    return base


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Spark keeps k rows per group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
