"""Everything that feature building fits, as one artefact: fitted on one split, saved, loaded and applied to another in one plan.

All fitted tables are one table of (kind, column, key, value) rows: medians of groups,
the median that is left, codes and frequencies of categories. A manifest row beside
it holds the plan, the types of the columns that were read and the fingerprint
of the rows they were fitted on.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import features as X
from foldwise.operators.encode import category_codes, frequencies, group_medians
from foldwise.operators.features import ordinal_code
from foldwise.operators.lookup import sized
from foldwise.operators.ranks import quantile_cells
from foldwise.sources.files import table_fingerprint

TABLES, MANIFEST = "kind string, column string, key array<string>, value double", "plan string, columns string, n_rows long, fingerprint string"


@dataclass(frozen=True)
class Plan:
    """What to build. missing: flag name -> column. medians: column -> the columns whose groups fill it. codes, shares: categories to number and to count.
    ordinals: column -> fixed codes."""
    missing: dict[str, str] = field(default_factory=dict)
    medians: dict[str, list[str]] = field(default_factory=dict)
    codes: list[str] = field(default_factory=list)
    shares: list[str] = field(default_factory=list)
    ordinals: dict[str, dict[str, int]] = field(default_factory=dict)

    def columns(self) -> list[str]:
        names = [*self.missing.values(), *self.medians, *[k for keys in self.medians.values() for k in keys], *self.codes, *self.shares, *self.ordinals]
        return list(dict.fromkeys(names))


#: The plan of the triage tables.
TRIAGE = Plan(missing=X.VITAL_MISSING, medians={c: ["age_group", "mental_status_triage"] for c in X.IMPUTED_VITALS}, codes=list(X.CODE_COLUMNS),
              shares=list(X.FREQUENCY_COLUMNS), ordinals=X.ORDINAL_MAPS)


class SchemaMismatch(ValueError):
    """A split lacks a column that the bundle was fitted on, or has it with another type."""


@dataclass(frozen=True)
class Bundle:
    plan: Plan
    columns: dict[str, str]
    n_rows: int
    fingerprint: str
    tables: DataFrame

    def save(self, path: str) -> None:
        """Write the tables and then the manifest, so that a bundle with a manifest is whole."""
        self.tables.write.mode("overwrite").parquet(f"{path}/tables")
        row = (json.dumps(asdict(self.plan), sort_keys=True), json.dumps(self.columns, sort_keys=True), self.n_rows, self.fingerprint)
        self.tables.sparkSession.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    def table(self, kind: str, column: str) -> DataFrame:
        return self.tables.where((F.col("kind") == kind) & (F.col("column") == column))

    def apply(self, df: DataFrame) -> DataFrame:
        """df with flags, filled medians, <column>_code, <column>_share and <column>_ord; one join for each fitted table.

        Groups and categories that were not seen when fitting, and missing ones, get the overall median, -1 and 0.
        """
        _check(df, self.columns)
        out = df.withColumns({name: F.col(c).isNull().cast("int") for name, c in self.plan.missing.items()})
        for c, keys in self.plan.medians.items():
            fitted = self.table("median", c).select(*[F.col("key")[i].alias(f"_k{i}") for i in range(len(keys))], F.col("value").alias("_m"))
            rest = self.table("rest", c).select(F.max("value")).scalar()
            on = [F.col(k).cast("string") == F.col(f"_k{i}") for i, k in enumerate(keys)]
            out = out.join(sized(fitted), on, "left").withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_m"), rest)).drop("_m", *[f"_k{i}" for i in range(len(keys))])
        for kind, cols, other in (("code", self.plan.codes, -1), ("share", self.plan.shares, 0.0)):
            for c in cols:
                fitted = sized(self.table(kind, c).select(F.col("key")[0].alias("_k"), F.col("value").alias("_v")))
                value = F.coalesce(F.col("_v"), F.lit(float(other)))
                out = out.join(fitted, F.col(c).cast("string") == F.col("_k"), "left").withColumn(f"{c}_{kind}", value.cast("int") if kind == "code" else value).drop("_k", "_v")
        return out.withColumns({f"{c}_ord": ordinal_code(F.col(c), codes) for c, codes in self.plan.ordinals.items()})


def _check(df: DataFrame, columns: dict[str, str]) -> None:
    kinds = dict(df.dtypes)
    wrong = [f"{c}: {kinds.get(c, 'absent')} instead of {t}" for c, t in columns.items() if kinds.get(c) != t]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))


def fit(df: DataFrame, plan: Plan) -> Bundle:
    """Fit every table of the plan on df. A missing group key or category is in no table."""
    kinds = dict(df.dtypes)
    absent = [c for c in plan.columns() if c not in kinds]
    if absent:
        raise SchemaMismatch(f"missing column(s) {absent}")
    parts = [df.sparkSession.createDataFrame([], TABLES)]

    def add(rows: DataFrame, kind: str, column: str, keys: Sequence[str], value: str) -> None:
        key = F.array(*[F.col(k).cast("string") for k in keys]) if keys else F.array().cast("array<string>")
        parts.append(rows.select(F.lit(kind).alias("kind"), F.lit(column).alias("column"), key.alias("key"), F.col(value).cast("double").alias("value")))

    for c, keys in plan.medians.items():
        med = group_medians(df.select(*[F.col(k).cast("string").alias(k) for k in keys], c), c, keys)
        add(med, "median", c, keys, f"{c}__med")
        rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(c).cast("double").alias(c))
        filled = rows.join(sized(med), list(keys), "left").select(F.coalesce(c, f"{c}__med").alias(c))
        rest = quantile_cells(filled, c, [0.5])
        if rest:
            add(df.sparkSession.createDataFrame([(float(rest[0]),)], "value double"), "rest", c, [], "value")
    for c in plan.codes:
        add(category_codes(df, c), "code", c, [c], "code")
    for c in plan.shares:
        add(frequencies(df.select(F.col(c).cast("string").alias(c)), c), "share", c, [c], "freq")
    tables = parts[0]
    for p in parts[1:]:
        tables = tables.union(p)
    mark = table_fingerprint(df, plan.columns()).first()
    return Bundle(plan, {c: kinds[c] for c in plan.columns()}, mark["n_rows"], mark["fingerprint"], tables)


def load(spark: SparkSession, path: str) -> Bundle:
    m = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
    return Bundle(Plan(**json.loads(m["plan"])), json.loads(m["columns"]), m["n_rows"], m["fingerprint"], spark.read.schema(TABLES).parquet(f"{path}/tables"))


def triage_frame(df: DataFrame, bundle: Bundle, text: str = "chief_complaint_raw", train: bool = True) -> DataFrame:
    """The structured feature build: fitted parts first, then the row-wise clinical block, text counts and keyword flags; identifiers and, on the training side,
    outcomes go."""
    out = X.clinical_features(bundle.apply(df))
    out = X.keyword_flags(X.text_counts(out, text, "complaint"), text, X.RISK_KEYWORDS, "kw_", "n_risk_words")
    out = X.keyword_total(out, text, X.TEMPORAL_KEYWORDS, "n_temporal_words")
    out = out.withColumn("complaint_system_ord", ordinal_code(F.col("chief_complaint_system"), X.COMPLAINT_SYSTEMS))
    return X.drop_leaky(out, train=train)
