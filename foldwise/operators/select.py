"""Exact order statistics without sorting or shuffling the values.

A wanted position starts with the whole range of its group as bracket. Each round
counts the rows of every bracket in equal parts, with the least and largest value
of each part, and the part that holds the position becomes the next bracket. When
a bracket has few rows, or one value, only those rows are read out. What is
shuffled in a round is one row for each part and task, whatever the number of
rows or different values; a value that a third of the rows have is one part in the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that all brackets share in a round; rows of a bracket from which it is read out; rounds; groups up to which brackets are kept on the driver.
PARTS, READ_OUT, ROUNDS, GROUPS = 4096, 20_000, 24, 512


@dataclass
class Bracket:
    """The rows lo <= value <= hi of a group; `before` rows of the group are smaller, `n` are inside."""
    group: tuple
    lo: float
    hi: float
    before: int
    n: int
    positions: set[int]


def _part(v: Column, parts: int) -> Column:
    """Number of the part that a value is in, from the columns _lo and _hi. Halves keep the width finite; infinite values have parts of their own."""
    share = (v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    inner = F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))).otherwise(0)
    return F.when(v == -math.inf, -1).when(v == math.inf, parts).otherwise(inner).cast("int")


def order_statistics(df: DataFrame, value: str, wanted: dict[str, float], by: Sequence[str] = ()) -> dict[tuple, tuple[int, dict[str, float]]] | None:
    """{group: (rows, {name: quantile})} with linear interpolation between neighbours; None if there are more than GROUPS groups.

    Rows whose group or value is missing (NaN too) are left out.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).dropna(subset=[*by, "_v"])
    finite = F.when(~F.col("_v").isin(math.inf, -math.inf), F.col("_v"))
    first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.min("_v").alias("all_lo"), F.max("_v").alias("all_hi"))
    seen = first.limit(GROUPS + 1).collect()
    if len(seen) > GROUPS:
        return None
    sizes, values, open_ = {}, {}, []
    for r in seen:
        if not r["n"]:
            continue
        g = tuple(r[c] for c in by)
        sizes[g] = r["n"]
        at = {p: (r["n"] - 1) * q for p, q in wanted.items()}
        positions = {k for h in at.values() for k in (math.floor(h), math.ceil(h))}
        if r["all_lo"] == r["all_hi"]:
            values.update({(g, k): r["all_lo"] for k in positions})
        else:
            lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 0.0)
            open_.append(Bracket(g, lo, hi, 0, r["n"], positions))
    for step in range(ROUNDS):
        if not open_ or (step and all(b.n <= READ_OUT for b in open_)):
            break
        open_ = _narrowed(rows, open_, by, values, whole=step == 0)
    _read_out(rows, open_, by, values)
    out = {}
    for g, n in sizes.items():
        cells = {}
        for name, q in wanted.items():
            h = (n - 1) * q
            a, b = values[g, math.floor(h)], values[g, math.ceil(h)]
            cells[name] = a if a == b else a + (b - a) * (h - math.floor(h))
        out[g] = n, cells
    return out


def _attached(rows: DataFrame, brackets: Sequence[Bracket], by: Sequence[str], whole: bool = False) -> DataFrame:
    """The rows inside each bracket, with its number _i and bounds. Brackets are as many as groups times positions at most."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`_g{k}` {kinds[c]}" for k, c in enumerate(by)), "_i int, _lo double, _hi double"])
    table = rows.sparkSession.createDataFrame([(*b.group, i, float(b.lo), float(b.hi)) for i, b in enumerate(brackets)], schema)
    on = F.lit(True) if whole else (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k, c in enumerate(by):
        on = on & (F.col(c) == F.col(f"_g{k}"))
    return rows.join(F.broadcast(table), on).select("_i", "_v", "_lo", "_hi")


def _narrowed(rows: DataFrame, brackets: Sequence[Bracket], by: Sequence[str], values: dict, whole: bool) -> list[Bracket]:
    parts = max(16, PARTS // len(brackets))
    counted = _attached(rows, brackets, by, whole).groupBy("_i", _part(F.col("_v"), parts).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    cells: dict[int, list] = {}
    for r in counted.collect():  # at most PARTS parts, or 16 for each bracket
        cells.setdefault(r["_i"], []).append(r)
    out = []
    for i, b in enumerate(brackets):
        before, rest = b.before, set(b.positions)
        for r in sorted(cells.get(i, []), key=lambda r: r["p"]):
            inside = {k for k in rest if before <= k < before + r["n"]}
            if inside:
                if r["lo"] == r["hi"]:
                    values.update({(b.group, k): r["lo"] for k in inside})
                else:
                    out.append(Bracket(b.group, r["lo"], r["hi"], before, r["n"], inside))
                rest -= inside
            before += r["n"]
    return out


def _read_out(rows: DataFrame, brackets: Sequence[Bracket], by: Sequence[str], values: dict) -> None:
    """Positions inside the brackets that are left, from their different values."""
    if not brackets:
        return
    each = _attached(rows, brackets, by).groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = [(i, k, k - b.before) for i, b in enumerate(brackets) for k in b.positions]
    table = rows.sparkSession.createDataFrame(wanted, "_w int, k long, at long")
    hit = each.withColumn("before", before).join(F.broadcast(table), (F.col("_i") == F.col("_w")) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
    for r in hit.select("_i", "k", "_v").collect():  # one row for each position
        values[brackets[r["_i"]].group, r["k"]] = r["_v"]
