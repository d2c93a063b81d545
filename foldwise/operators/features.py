"""Row-wise features: each function reads only its own row, so train and test get the same columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import clip_low, flag, total, word_count

# Neighbouring-band differences as (left, right), and the floor of the log feature.
COLOR_PAIRS = {"u_g": ("u", "g"), "g_r": ("g", "r"), "r_i": ("r", "i"), "i_z": ("i", "z")}
LOG_FLOOR = -0.01

# Clinical thresholds as (flag, column, comparison, bound[, upper comparison, upper bound]).
CLINICAL_RULES = (
    ("elderly", "age", ">=", 65),
    ("pediatric", "age", "<", 18),
    ("very_old", "age", ">=", 80),
    ("hypertensive_crisis", "systolic_bp", ">=", 180),
    ("hypotensive", "systolic_bp", "<=", 90),
    ("tachycardic", "heart_rate", ">=", 100),
    ("bradycardic", "heart_rate", "<=", 50),
    ("tachypneic", "respiratory_rate", ">=", 22),
    ("febrile", "temperature_c", ">=", 38.0),
    ("hypothermic", "temperature_c", "<=", 35.0),
    ("hypoxic", "spo2", "<", 94),
    ("severe_hypoxia", "spo2", "<", 88),
    ("gcs_severe", "gcs_total", "<=", 8),
    ("gcs_moderate", "gcs_total", ">", 8, "<=", 12),
    ("gcs_mild", "gcs_total", ">=", 13),
    ("news2_low", "news2_score", "<=", 4),
    ("news2_medium", "news2_score", ">=", 5, "<=", 6),
    ("news2_high", "news2_score", ">=", 7),
    ("news2_critical", "news2_score", ">=", 12),
    ("pain_severe", "pain_score", ">=", 7),
    ("pain_moderate", "pain_score", ">=", 4, "<", 7),
    ("pain_none", "pain_score", "==", 0),
)
ABNORMAL_FLAGS = ("hypotensive", "tachycardic", "tachypneic", "febrile", "hypoxic", "bradycardic", "hypothermic")
CRITICAL_RULES = (("gcs_total", "<=", 8), ("spo2", "<", 88), ("systolic_bp", "<=", 70), ("news2_score", ">=", 12))
VITAL_MISSING = {"bp_missing": "systolic_bp", "rr_missing": "respiratory_rate", "temp_missing": "temperature_c"}

# History column groups and their composite names.
HISTORY_GROUPS = {
    "cv_risk_score": ("hx_hypertension", "hx_coronary_artery_disease", "hx_heart_failure", "hx_atrial_fibrillation",
                      "hx_stroke_prior", "hx_peripheral_vascular_disease"),
    "resp_risk_score": ("hx_asthma", "hx_copd"),
    "psych_risk_score": ("hx_depression", "hx_anxiety", "hx_substance_use_disorder"),
    "metabolic_risk_score": ("hx_diabetes_type2", "hx_diabetes_type1", "hx_obesity", "hx_hypothyroidism",
                             "hx_hyperthyroidism"),
}
HISTORY_COLUMNS = (
    "hx_hypertension", "hx_diabetes_type2", "hx_diabetes_type1", "hx_asthma", "hx_copd", "hx_heart_failure",
    "hx_atrial_fibrillation", "hx_ckd", "hx_liver_disease", "hx_malignancy", "hx_obesity", "hx_depression",
    "hx_anxiety", "hx_dementia", "hx_epilepsy", "hx_hypothyroidism", "hx_hyperthyroidism", "hx_hiv",
    "hx_coagulopathy", "hx_immunosuppressed", "hx_pregnant", "hx_substance_use_disorder",
    "hx_coronary_artery_disease", "hx_stroke_prior", "hx_peripheral_vascular_disease")

# Ordinal codes.
ORDINAL_MAPS = {
    "arrival_mode": {"walk-in": 0, "brought_by_family": 1, "police": 2, "transfer": 3, "ambulance": 4, "helicopter": 5},
    "shift": {"morning": 0, "afternoon": 1, "evening": 2, "night": 3},
    "arrival_season": {"spring": 0, "summer": 1, "autumn": 2, "winter": 3},
    "age_group": {"pediatric": 0, "young_adult": 1, "middle_aged": 2, "elderly": 3},
    "sex": {"F": 0, "M": 1, "Other": 2},
    "mental_status_triage": {"alert": 0, "drowsy": 1, "confused": 2, "agitated": 3, "unresponsive": 4},
    "arrival_day": {"Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3, "Friday": 4, "Saturday": 5, "Sunday": 6},
}
COMPLAINT_SYSTEMS = {
    "cardiac": 0, "neurological": 1, "respiratory": 2, "trauma": 3, "gastrointestinal": 4, "psychiatric": 5,
    "infectious": 6, "musculoskeletal": 7, "genitourinary": 8, "dermatological": 9, "ENT": 10, "endocrine": 11,
    "ophthalmological": 12, "other": 13}
FREQUENCY_COLUMNS = ("language", "insurance_type", "transport_origin", "pain_location")
CODE_COLUMNS = ("site_id", "triage_nurse_id")
IMPUTED_VITALS = ("systolic_bp", "diastolic_bp", "mean_arterial_pressure", "pulse_pressure", "shock_index",
                  "respiratory_rate", "temperature_c")

# Keyword lists searched in free text, and columns never used as features.
RISK_KEYWORDS = (
    "chest pain", "dyspnea", "shortness of breath", "seizure", "unconscious", "unresponsive", "stroke",
    "cardiac arrest", "anaphylaxis", "sepsis", "hemorrhage", "bleeding", "fracture", "head injury", "overdose",
    "suicide", "suicidal", "ruptured", "acute", "severe")
TEMPORAL_KEYWORDS = ("worsening", "sudden", "acute", "new onset", "progressive")
IDENTIFIER_COLUMNS = ("patient_id", "chief_complaint_raw", "chief_complaint_system")
OUTCOME_COLUMNS = ("disposition", "ed_los_hours")

_COMPARE = {
    ">=": lambda c, v: c >= v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
}


def _need(df: DataFrame, cols: Iterable[str]) -> None:
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise KeyError(f"missing column(s) {absent}")


def add_differences(df: DataFrame, pairs: dict[str, tuple[str, str]] = COLOR_PAIRS,
                    only: Sequence[str] | None = None) -> DataFrame:
    """left - right for each named pair."""
    names = list(pairs) if only is None else list(only)
    unknown = [n for n in names if n not in pairs]
    if unknown:
        raise KeyError(f"unknown difference(s) {unknown}, expected some of {list(pairs)}")
    _need(df, [c for n in names for c in pairs[n]])
    return df.withColumns({n: F.col(pairs[n][0]) - F.col(pairs[n][1]) for n in names}) if names else df


def log_shift(c: Column, floor: float = LOG_FLOOR) -> Column:
    """ln(1 + x - floor); a value below the floor fails the job."""
    return F.when(c < floor, F.raise_error(F.concat(F.lit(f"value below the floor {floor}: "), c.cast("string")))
                  ).otherwise(F.log1p(c - F.lit(floor)))


def add_log(df: DataFrame, column: str, floor: float = LOG_FLOOR, out: str | None = None) -> DataFrame:
    _need(df, [column])
    return df.withColumn(out or f"{column}_log", log_shift(F.col(column), floor))


def add_log_fitted(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Exploratory variant: shift by the observed minimum, one scalar aggregate."""
    return df.withColumn(out or f"{column}_log", F.log1p(F.col(column) - df.agg(F.min(column)).scalar()))


def add_engineered(df: DataFrame, include: Sequence[str], pairs: dict[str, tuple[str, str]] = COLOR_PAIRS,
                   log_column: str = "redshift", floor: float = LOG_FLOOR) -> DataFrame:
    """Apply the requested features in a fixed order, whatever order they are asked in."""
    known = [*pairs, f"{log_column}_log"]
    unknown = [n for n in include if n not in known]
    if unknown:
        raise KeyError(f"unknown feature(s) {unknown}, expected some of {known}")
    out = add_differences(df, pairs, [n for n in pairs if n in include])
    return add_log(out, log_column, floor) if f"{log_column}_log" in include else out


def model_frame(df: DataFrame, raw: Sequence[str], engineered: Sequence[str] = (), drop: Sequence[str] = (),
                keep: Sequence[str] = (), **kw) -> DataFrame:
    """Raw plus engineered minus dropped columns, in a fixed order."""
    order = [*raw, *engineered]
    unknown = [d for d in drop if d not in order]
    if unknown:
        raise KeyError(f"cannot drop unknown column(s) {unknown}")
    return add_engineered(df, engineered, **kw).select(*keep, *[c for c in order if c not in set(drop)])


def missing_flags(df: DataFrame, flags: dict[str, str], any_name: str, count_name: str) -> DataFrame:
    """One 0/1 flag per column, whether any is missing and how many."""
    cols = {n: F.col(c).isNull().cast("int") for n, c in flags.items()}
    n = total(list(cols.values()))
    return df.withColumns({**cols, any_name: F.least(n, F.lit(1)), count_name: n})


def sentinel_to_null(c: Column, sentinel) -> Column:
    return F.when(c != sentinel, c)


def rule(column: str, op: str, bound, op2: str | None = None, bound2=None) -> Column:
    cond = _COMPARE[op](F.col(column), bound)
    return cond if op2 is None else cond & _COMPARE[op2](F.col(column), bound2)


def threshold_flags(df: DataFrame, rules: Sequence[tuple] = CLINICAL_RULES, override: dict[str, float] | None = None) -> DataFrame:
    """0/1 flags from a rule list; `override` replaces the first bound of named flags."""
    override = override or {}
    out = {}
    for name, column, op, bound, *rest in rules:
        out[name] = flag(rule(column, op, override.get(name, bound), *rest))
    return df.withColumns(out)


def guarded_ratio(num: Column, den: Column, low: float = 1.0) -> Column:
    """num / den with the denominator raised to at least `low`."""
    return num / clip_low(den, low)


def deficit(target: float, c: Column) -> Column:
    """How far a value falls short of a target, never negative."""
    return clip_low(F.lit(target) - c, 0.0)


def row_sums(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Sum of each column group, a missing member counting as zero."""
    return df.withColumns({n: total([F.coalesce(F.col(c), F.lit(0)) for c in cols]) for n, cols in groups.items()})


def any_rule(rules: Sequence[tuple]) -> Column:
    """0/1 flag: at least one rule holds."""
    return F.greatest(*[flag(rule(*r)) for r in rules]) if len(rules) > 1 else flag(rule(*rules[0]))


def ordinal_code(c: Column, codes: dict[str, int], default: int = -1) -> Column:
    """Fixed code per value; unseen or missing values get the default."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(c.cast("string"), F.lit(""))), F.lit(default))


def text_counts(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Word and character counts over the whole text; a missing text counts as empty."""
    return df.withColumns({f"{prefix}_word_count": word_count(F.col(text)),
                           f"{prefix}_char_count": F.length(F.coalesce(F.col(text), F.lit("")))})


def keyword_flags(df: DataFrame, text: str, keywords: Sequence[str], prefix: str, total_name: str | None = None) -> DataFrame:
    """Case-insensitive substring flags, one per keyword, and their sum."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = {f"{prefix}{k.replace(' ', '_')}": low.contains(k).cast("int") for k in keywords}
    out = dict(flags)
    if total_name:
        out[total_name] = total(list(flags.values()))
    return df.withColumns(out)


def keyword_total(df: DataFrame, text: str, keywords: Sequence[str], name: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(name, total([low.contains(k).cast("int") for k in keywords]))


def drop_leaky(df: DataFrame, identifiers: Sequence[str] = IDENTIFIER_COLUMNS,
               outcomes: Sequence[str] = OUTCOME_COLUMNS, train: bool = True) -> DataFrame:
    """Drop identifiers, and on the training side columns known only after the outcome."""
    return df.drop(*identifiers, *(outcomes if train else ()))


def regime_bins(c: Column, edges: Sequence[float] = (0.1, 1.0)) -> Column:
    """Ordered regimes: below the first edge, between edges (both closed), above the last."""
    out = F.when(c < edges[0], F.lit(0))
    for i, e in enumerate(edges[1:], start=1):
        out = out.when(c <= e, F.lit(i))
    return out.when(c.isNotNull(), F.lit(len(edges)))


def clinical_features(df: DataFrame) -> DataFrame:
    """The row-wise clinical block: flags, ratios, composites and interactions, after imputation."""
    out = threshold_flags(df)
    out = out.withColumns({
        "hr_rr_ratio": guarded_ratio(F.col("heart_rate"), F.col("respiratory_rate")),
        "pulse_pressure_ratio": guarded_ratio(F.col("pulse_pressure"), F.col("systolic_bp")),
        "map_deficit": deficit(65.0, F.col("mean_arterial_pressure")),
        "critical_flag": any_rule(CRITICAL_RULES)})
    out = row_sums(out, {"n_abnormal_vitals": ABNORMAL_FLAGS, **HISTORY_GROUPS, "total_hx_count": HISTORY_COLUMNS})
    return out.withColumns({
        "elderly_high_news2": flag((F.col("elderly") == 1) & (F.col("news2_score") >= 7)),
        "elderly_low_gcs": flag((F.col("elderly") == 1) & (F.col("gcs_total") <= 12)),
        "cv_risk_x_shock": F.col("cv_risk_score") * F.col("shock_index"),
        "comorbid_x_news2": F.col("num_comorbidities") * F.col("news2_score"),
        "prior_visits_x_severity": F.col("num_prior_ed_visits_12m") * F.col("news2_score")})
