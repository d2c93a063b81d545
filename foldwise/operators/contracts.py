"""Declared data contracts: every violation is reported in one table, and gates raise on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.num import missing, nan_to_null, r6

FAMILIES = {
    "int": {"tinyint", "smallint", "int", "bigint"},
    "float": {"float", "double"},
    "text": {"string"},
}
SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType()}
VIOLATION = "check string, column_name string, n_rows bigint, observed double, detail string"


class ContractError(ValueError):
    """One or more contract violations; the message lists them."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    family: str
    null_limit: float = 0.0
    min_value: float | None = None
    max_value: float | None = None
    allowed: frozenset[str] | None = None


def spec_schema(specs: Sequence[ColumnSpec]) -> T.StructType:
    return T.StructType([T.StructField(s.name, SPARK_TYPES[s.family]) for s in specs])


def pick_contract(contracts: dict[str, Sequence[ColumnSpec]], split: str) -> Sequence[ColumnSpec]:
    if split not in contracts:
        raise KeyError(f"unknown split {split!r}, expected one of {sorted(contracts)}")
    return contracts[split]


def _structural(df: DataFrame, specs: Sequence[ColumnSpec]) -> list[tuple]:
    types = dict(df.dtypes)
    want = [s.name for s in specs]
    out = []
    if len(df.columns) != len(specs):
        out.append(("column_count", None, len(df.columns), float(len(specs)), None))
    if df.columns != want:
        out.append(("column_order", None, None, None, ",".join(df.columns)))
    for s in specs:
        if s.name not in types:
            out.append(("column_missing", s.name, None, None, None))
        elif types[s.name] not in FAMILIES[s.family]:
            out.append(("column_type", s.name, None, None, types[s.name]))
    return out


def violations(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """All violations: structure from the schema, values from one aggregation, and one row per unexpected value."""
    types = dict(df.dtypes)
    present = [s for s in specs if s.name in types]
    ranged = [s for s in present if types[s.name] not in FAMILIES["text"]]
    aggs = [F.count(F.lit(1)).alias("n")]
    for s in present:
        aggs.append(F.count_if(missing(F.col(s.name), types[s.name])).alias(f"{s.name}__null"))
    for s in ranged:
        c = nan_to_null(F.col(s.name).cast("double"))
        if s.min_value is not None:
            aggs += [F.count_if(c < s.min_value).alias(f"{s.name}__low"), F.min(c).alias(f"{s.name}__min")]
        if s.max_value is not None:
            aggs += [F.count_if(c > s.max_value).alias(f"{s.name}__high"), F.max(c).alias(f"{s.name}__max")]

    def item(cond, check, column, n, observed):
        return F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(column).alias("column_name"),
                                     n.cast("bigint").alias("n_rows"), r6(observed).alias("observed"),
                                     F.lit(None).cast("string").alias("detail")))

    items = []
    for s in present:
        nulls = F.col(f"{s.name}__null")
        share = F.try_divide(nulls.cast("double"), F.col("n"))
        items.append(item(share > s.null_limit, "null_share", s.name, nulls, share))
    for s in ranged:
        if s.min_value is not None:
            n = F.col(f"{s.name}__low")
            items.append(item(n > 0, "below_min", s.name, n, F.col(f"{s.name}__min")))
        if s.max_value is not None:
            n = F.col(f"{s.name}__high")
            items.append(item(n > 0, "above_max", s.name, n, F.col(f"{s.name}__max")))
    parts = []
    if items:
        parts.append(df.agg(*aggs).select(F.explode(F.array_compact(F.array(*items))).alias("v")).select("v.*"))
    closed = [s for s in present if s.allowed is not None]
    if closed:
        odd = df.select(*[F.when(~F.col(s.name).isin(*sorted(s.allowed)), F.col(s.name).cast("string")).alias(s.name)
                          for s in closed])
        parts.append(odd.unpivot([], [s.name for s in closed], "column_name", "detail")
                     .where("detail is not null").groupBy("column_name", "detail").agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit("not_allowed").alias("check"), "column_name", "n_rows",
                             F.lit(None).cast("double").alias("observed"), "detail"))
    fixed = _structural(df, specs)
    if fixed or not parts:
        parts.append(df.sparkSession.createDataFrame(fixed, VIOLATION))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Return the frame unchanged, or raise one error that names every check that failed and its column.

    Unexpected values of a column are counted, with the first of them; violations() has them all.
    """
    found = violations(df, specs).persist()
    try:
        n = found.count()
        if n:
            rows = found.groupBy("check", "column_name").agg(
                F.count(F.lit(1)).alias("kinds"), F.sum("n_rows").alias("n_rows"), F.min("observed").alias("observed"),
                F.min("detail").alias("detail")).orderBy("check", "column_name").collect()
            lines = [f"{r['check']} {r['column_name'] or ''} rows={r['n_rows']} observed={r['observed']} {r['detail'] or ''}"
                     + (f" and {r['kinds'] - 1} more" if r["kinds"] > 1 else "") for r in rows]
            raise ContractError(f"{n} contract violation(s):\n  " + "\n  ".join(lines))
    finally:
        found.unpersist()
    return df


# ---- chat records -----------------------------------------------------------

def chat_record_faults(messages) -> "F.Column":
    """Faults of one record with a `messages` array of (role, content), comma separated; empty when clean."""
    n = F.size(messages)
    last = F.try_element_at(messages, F.lit(-1))
    before = F.slice(messages, 1, F.greatest(n - 1, F.lit(0)))
    blank = F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")
    faults = F.array(
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("empty")),
        F.when((n > 0) & ~F.coalesce(last["role"] == "assistant", F.lit(False)), F.lit("last_not_assistant")),
        F.when((n > 0) & ~F.exists(before, lambda m: m["role"] == "user"), F.lit("no_user_before")),
        F.when((n > 0) & blank, F.lit("blank_content")),
    )
    return F.array_join(F.array_compact(faults), ",")


def chat_turn_faults(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The same contract over one row per turn, with mergeable aggregates instead of collected lists."""
    c = turns.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.max_by(role, turn).alias("last_role"),
        F.max(turn).alias("last_turn"),
        F.min(F.when(F.col(role) == "user", F.col(turn))).alias("first_user"),
        F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("n_blank"))
    faults = F.array(
        F.when(F.col("last_role") != "assistant", F.lit("last_not_assistant")),
        F.when(F.coalesce(F.col("first_user") >= F.col("last_turn"), F.lit(True)), F.lit("no_user_before")),
        F.when(F.col("n_blank") > 0, F.lit("blank_content")))
    return c.select(conv, "n_turns", "last_role", "n_blank",
                    F.array_join(F.array_compact(faults), ",").alias("faults"))


# ---- output and coverage gates ---------------------------------------------

def id_set_report(pred: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: ids only in the truth, ids only in the predictions, ids predicted more than once.

    A single shuffle on the key carries both sides.
    """
    key = list(key)
    both = (pred.select(*key, F.lit(1).alias("_p"), F.lit(0).alias("_t"))
            .unionByName(truth.select(*key, F.lit(0).alias("_p"), F.lit(1).alias("_t"))))
    per = both.groupBy(*key).agg(F.sum("_p").alias("p"), F.sum("_t").alias("t"))
    return per.agg(
        F.count_if((F.col("p") == 0)).alias("not_predicted"),
        F.count_if((F.col("t") == 0)).alias("not_in_truth"),
        F.count_if(F.col("p") > 1).alias("predicted_twice"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_predictions"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_truth"))


def prediction_contract(pred: DataFrame, truth: DataFrame, key: str, label: str,
                        allowed: Sequence[str]) -> DataFrame:
    """The output contract for a prediction file: exact columns, id set, labels, nulls."""
    ids = id_set_report(pred, truth, [key])
    lab = pred.agg(F.struct(F.count_if(F.col(label).isNull()).alias("null_labels"),
                            F.count_if(F.col(key).isNull()).alias("null_ids"),
                            F.count_if(~F.col(label).isin(*allowed)).alias("bad_labels")).alias("s")).scalar()
    shape_ok = pred.columns == [key, label]
    one = ids.select("*", *[lab[c].alias(c) for c in ("null_labels", "null_ids", "bad_labels")])
    bad = (F.col("not_predicted") + F.col("not_in_truth") + F.col("predicted_twice") + F.col("null_labels")
           + F.col("null_ids") + F.col("bad_labels"))
    return one.select("*", F.lit(shape_ok).alias("columns_ok"), ((bad == 0) & F.lit(shape_ok)).alias("passed"))


def require_predictions(pred: DataFrame, truth: DataFrame, key: str, label: str, allowed: Sequence[str]) -> DataFrame:
    row = prediction_contract(pred, truth, key, label, allowed).first()
    if not row["passed"]:
        raise ContractError(f"prediction contract failed: {row.asDict()}")
    return pred


def floor_gate(metrics: DataFrame, floors: dict[str, float], name: str = "metric", value: str = "value",
               spread_of: str | None = None, spread_limit: float | None = None) -> DataFrame:
    """Compare named metric rows with floors, and optionally the spread of a family of metrics with a limit.

    `metrics` is a report table (one row per metric). A metric without a row fails its floor.
    """
    names = sorted(floors)
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), F.lit(float(floors[n])).alias("limit")) for n in names]))
    got = metrics.groupBy().agg(F.map_from_entries(F.collect_list(F.when(
        F.col(name).isin(*names), F.struct(F.col(name), F.col(value))))).alias("m"))
    rows = got.select("m", want.alias("w")).select(
        F.col("w._n").alias("gate"), r6(F.try_element_at("m", F.col("w._n"))).alias("observed"),
        F.col("w.limit").alias("limit"))
    out = rows.select("*", F.coalesce(F.col("observed") >= F.col("limit"), F.lit(False)).alias("passed"))
    if spread_of is not None:
        sp = metrics.where(F.col(name).startswith(spread_of)).agg(r6(F.max(value) - F.min(value)).alias("observed"))
        out = out.unionByName(sp.select(F.lit("spread").alias("gate"), "observed", F.lit(float(spread_limit)).alias("limit"),
                                        F.coalesce(F.col("observed") <= spread_limit, F.lit(False)).alias("passed")))
    return out
