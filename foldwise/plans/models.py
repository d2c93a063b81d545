"""Model evaluation queries. Those of models whose fit is a sum have their SQL; iterative fits have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.num import argmax_array, r6
from foldwise.operators import contributions as C
from foldwise.operators import evaluate as E
from foldwise.operators import sufficient as S
from foldwise.operators.assoc import roc_auc
from foldwise.operators.folds import seed_counts, stratified_folds
from foldwise.operators.lookup import keep
from foldwise.plans.common import LI, LINE_KEY, Y_SQL, _prob_exprs, lines, model_columns, query, scored, sides

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p0_1", "p0_2"]
FOLDS = 3


#: Rows that share a line key are told apart by their price.
KEY = [*LINE_KEY, "cents"]
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def with_cents(df):
    return df.withColumn("cents", F.expr(CENTS))


def frame(spark, sf):
    """Folded rows with a numeric label; kept because every fold reads it."""
    return keep(folded_rows(spark, sf, [*LINE_KEY, "l_linestatus", *FEATURES]).withColumn("label", F.col("y").cast("double")).drop("y"))


def folded_rows(spark, sf, columns, seed: int = 3):
    """Class y, these columns and the fold of every row; placed once, whoever reads them."""
    return stratified_folds(with_cents(scored(spark, sf)), KEY, "y", FOLDS, seed=seed, carry=columns)


def folded_cells(spark, sf, seed: int = 3):
    """(fold, y, code, n): the rows counted by what naive Bayes sees of them, so at most folds x classes x codes rows, and the columns to read the code with."""
    d = with_cents(scored(spark, sf)).withColumn("code", F.expr(S.code_sql(BINNED)))
    d = stratified_folds(d, KEY, "y", FOLDS, seed=seed, carry=["code"])
    return keep(d.groupBy("fold", "y", "code").agg(F.count(F.lit(1)).alias("n"))), S.coded(BINNED, "code")


@query("oof_logreg")
def oof_logreg(spark, sf):
    oof, _ = E.out_of_fold(frame(spark, sf), LINE_KEY, "label", FOLDS, E.logistic(FEATURES, "label", max_iter=5))
    return E.oof_scores(oof, "label").select("fold", r6(F.col("score")).alias("score"), "n")


# ---- least squares and counts, on both sides -----------------------------------------

COLUMNS = [S.Scaled("l_quantity", 0, 50), S.Scaled("l_extendedprice", 0, 100_000), S.Scaled("l_discount", 0, 0.1), S.Scaled("l_tax", 0, 0.08),
           S.Scaled("p0_1", 0, 1), S.Scaled("p0_2", 0, 1)]
BINNED = [S.Bins("l_quantity", 0, 50, 10), S.Bins("l_extendedprice", 0, 100_000, 12), S.Bins("l_tax", 0, 0.08, 4), S.Bins("p0_1", 0, 1, 8), S.Bins("p0_2", 0, 1, 8),
          S.Values("l_linestatus", ("F", "O"))]
ROW_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents{})"
LINE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def folded_sql(name: str = "f", seed: int = 3) -> str:
    """CTEs that end with `name`: rows with scores, class y and fold, as folded_rows()."""
    return (f"{name}y AS (SELECT *, {CENTS} AS cents, CAST({Y_SQL} AS INTEGER) AS y FROM lineitem), {name}s AS (SELECT *, {', '.join(_prob_exprs())} FROM {name}y), "
            f"{name} AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5({ROW_KEY.format(f", '{seed}'")})) - 1) % {FOLDS} AS INTEGER) AS fold FROM {name}s)")


def linear_sql(f: str, columns, settings, n_classes: int, folds, p: str = "") -> str:
    """CTEs over the rows `f` (fold, y, columns) that end with {p}wt: (name, own, w), the coefficients of each setting without fold `own` (-1: of all
    rows) as a list of lists. Elimination is one CTE for each column."""
    x = ["1.0e0", *[c.sql() for c in columns]]
    size, sets = len(x), ", ".join(f"('{s.name}', [1, {', '.join(str(int(u)) for u in s.use)}], {s.ridge!r}::DOUBLE)" for s in settings)
    sums = ", ".join("[" + ", ".join(f"sum(x[{i + 1}] * x[{j + 1}])" for j in range(size)) + "]" for i in range(size))
    steps = []
    for k in range(size):
        steps.append(f"{p}e{k + 1} AS MATERIALIZED (SELECT a.name, a.own, a.i, CASE WHEN a.i = {k} THEN list_transform(a.r, lambda v: v / b.r[{k + 1}]) "
                     f"ELSE list_transform(range(1, len(a.r) + 1), lambda j: a.r[j] - a.r[{k + 1}] / b.r[{k + 1}] * b.r[j]) END AS r "
                     f"FROM {p}e{k} a JOIN {p}e{k} b ON a.name = b.name AND a.own = b.own AND b.i = {k})")
    return f"""{p}x AS (SELECT fold, y, [{', '.join(x)}] AS x FROM {f}),
{p}m AS MATERIALIZED (SELECT fold, y, [{sums}] AS m FROM {p}x GROUP BY fold, y),
{p}g AS (SELECT fold, y, unnest(range({size})) AS i, unnest(m) AS r FROM {p}m),
{p}c AS (SELECT fold, y, i, unnest(range({size})) AS j, unnest(r) AS v FROM {p}g),
{p}t AS MATERIALIZED (SELECT own, y, i, j, sum(v) AS v FROM {p}c, (SELECT unnest([{', '.join(map(str, [*folds, -1]))}]) AS own) WHERE fold <> own GROUP BY ALL),
{p}n AS (SELECT own, y, v AS n, sum(v) OVER (PARTITION BY own) AS total FROM {p}t WHERE i = 0 AND j = 0),
{p}w AS MATERIALIZED (SELECT own, y, total / ({n_classes} * n) / total AS w FROM {p}n),
{p}s AS (SELECT * FROM (VALUES {sets}) v(name, use, ridge)),
{p}a AS (SELECT name, own, i, j, sum(w * v) * use[i + 1] * use[j + 1] + CASE WHEN i <> j OR i = 0 THEN 0 WHEN use[i + 1] = 1 THEN ridge ELSE 1 END AS v
        FROM {p}t JOIN {p}w USING (own, y), {p}s GROUP BY name, own, i, j, use, ridge),
{p}b AS (SELECT name, own, i, {size} + y AS j, w * v * use[i + 1] AS v FROM {p}t JOIN {p}w USING (own, y), {p}s WHERE j = 0),
{p}e0 AS MATERIALIZED (SELECT name, own, i, list(v ORDER BY j) AS r FROM (SELECT * FROM {p}a UNION ALL SELECT * FROM {p}b) GROUP BY name, own, i),
{', '.join(steps)},
{p}wt AS MATERIALIZED (SELECT name, own, list(r[{size + 1}:] ORDER BY i) AS w FROM {p}e{size} GROUP BY name, own)"""


def linear_score_sql(columns, n_classes: int, w: str = "w") -> str:
    x = ["1.0e0", *[c.sql() for c in columns]]
    return "[" + ", ".join("round(" + " + ".join(f"{w}[{i + 1}][{c + 1}] * {v}" for i, v in enumerate(x)) + f", {S.DIGITS})" for c in range(n_classes)) + "]"


FIRST_BEST = "CAST(list_position(s, list_max(s)) - 1 AS INTEGER)"


def fold_score_sql(rows: str, by: str = "fold") -> str:
    """Balanced accuracy from rows (by, y, pred)."""
    return f"SELECT {by}, avg(recall) AS score, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {by}, y, avg(CAST(y = pred AS INTEGER)) AS recall, count(*) AS n FROM {rows} GROUP BY {by}, y) GROUP BY {by}"


def bayes_sql(f: str, specs, n_classes: int, folds, p: str = "b", smooth: float = 1.0) -> str:
    """CTEs over `f` that end with {p}l: (own, c, b, y, l), the log share of a bin in a class without fold `own`."""
    cells = " UNION ALL ".join(f"SELECT fold, y, {i} AS c, {s.sql()} AS b FROM {f}" for i, s in enumerate(specs))
    grid = " UNION ALL ".join(f"SELECT {i} AS c, unnest(range({s.size})) AS b, {s.size} AS size" for i, s in enumerate(specs))
    return f"""{p}c AS MATERIALIZED (SELECT fold, y, c, b, count(*) AS n FROM ({cells}) GROUP BY ALL),
{p}g AS (SELECT * FROM ({grid}), (SELECT unnest(range({n_classes})) AS y), (SELECT unnest([{', '.join(map(str, [*folds, -1]))}]) AS own)),
{p}t AS MATERIALIZED (SELECT own, g.c, g.b, g.y, size, coalesce(sum(n) FILTER (fold <> own), 0) AS n FROM {p}g g LEFT JOIN {p}c k ON g.c = k.c AND g.b = k.b AND g.y = k.y GROUP BY ALL),
{p}l AS MATERIALIZED (SELECT own, c, b, y, ln((n + {smooth!r}::DOUBLE) / (sum(n) OVER (PARTITION BY own, c, y) + {smooth!r}::DOUBLE * size)) AS l FROM {p}t)"""


def bayes_score_sql(f: str, specs, own: str, keep_columns: str, n_classes: int = 3, p: str = "b") -> str:
    """CTE body: keep_columns and s, the list of log scores, of every row of f."""
    table = f"(SELECT own, map_from_entries(list((c * 1000 + b * 10 + y, l))) AS m FROM {p}l GROUP BY own)"
    score = "[" + ", ".join("round(" + " + ".join(f"m[{i * 1000} + ({s.sql()}) * 10 + {c}]" for i, s in enumerate(specs)) + f", {S.DIGITS})" for c in range(n_classes)) + "]"
    return f"SELECT {keep_columns}, {score} AS s FROM {f} JOIN {table} USING (own)" if own == "own" else (
        f"SELECT {keep_columns}, {score} AS s FROM {f} JOIN {table} k ON k.own = {own}")


ALL_COLUMNS = [S.setting("all", COLUMNS)]


@query("oof_least_squares", f"""
WITH {folded_sql()}, {linear_sql('f', COLUMNS, ALL_COLUMNS, 3, range(FOLDS))},
p AS (SELECT fold, y, {linear_score_sql(COLUMNS, 3)} AS s FROM f JOIN wt ON own = fold),
q AS (SELECT fold, y, {FIRST_BEST} AS pred FROM p)
SELECT fold, round(score, 6) AS score, n FROM ({fold_score_sql('q')})""")
def oof_least_squares(spark, sf):
    d = S.linear_out_of_fold(folded_rows(spark, sf, FEATURES), COLUMNS, "y", 3, FOLDS)
    return E.oof_scores(d, "y").select("fold", r6(F.col("score")).alias("score"), "n")


@query("oof_bayes", f"""
WITH {folded_sql()}, {bayes_sql('f', BINNED, 3, range(FOLDS))},
p AS ({bayes_score_sql('f', BINNED, 'fold', 'fold, y')}),
q AS (SELECT fold, y, {FIRST_BEST} AS pred FROM p)
SELECT fold, round(score, 6) AS score, n FROM ({fold_score_sql('q')})""")
def oof_bayes(spark, sf):
    cells, specs = folded_cells(spark, sf)
    models = S.bayes(S.bin_counts(cells, specs, "y", n="n"), specs, 3, range(FOLDS))
    return E.oof_scores(cells.withColumn("probability", S.bayes_scores(specs, models)), "y", n="n").select("fold", r6(F.col("score")).alias("score"), "n")


TEST_SIDE = f"substr(md5({LINE}), 1, 1) < '4'"


@query("fold_average_test", f"""
WITH {folded_sql('h')}, f AS (SELECT * FROM h WHERE NOT ({TEST_SIDE})), {linear_sql('f', COLUMNS, ALL_COLUMNS, 3, range(FOLDS))},
p AS (SELECT {', '.join(KEY)}, {linear_score_sql(COLUMNS, 3)} AS s FROM h, wt WHERE ({TEST_SIDE}) AND own >= 0),
mean AS (SELECT {', '.join(KEY)}, [round(avg(s[1]), 8), round(avg(s[2]), 8), round(avg(s[3]), 8)] AS s FROM p GROUP BY {', '.join(KEY)})
SELECT pred, count(*) AS n FROM (SELECT {FIRST_BEST} AS pred FROM mean) GROUP BY pred""")
def fold_average_test(spark, sf):
    d = folded_rows(spark, sf, [*LINE_KEY, *FEATURES])
    test = F.expr(TEST_SIDE)
    models = S.least_squares(S.cross_products(d.where(~test), COLUMNS, "y"), ALL_COLUMNS, 3, range(FOLDS))["all"]
    each = [S.linear_scores(COLUMNS, {S.ALL: models[f]}, None) for f in range(FOLDS)]
    mean = F.array(*[F.round(sum((F.get(e, F.lit(c)) for e in each), F.lit(0.0)) / FOLDS, 8) for c in range(3)])
    return d.where(test).groupBy(argmax_array(mean).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("refit_score", f"""
WITH {folded_sql('h')}, f AS (SELECT * FROM h WHERE fold <> 0), {bayes_sql('f', BINNED, 3, [])},
p AS ({bayes_score_sql('h', BINNED, '-1', 'fold')})
SELECT pred, count(*) AS n FROM (SELECT {FIRST_BEST} AS pred FROM p WHERE fold = 0) GROUP BY pred""")
def refit_score(spark, sf):
    d, specs = folded_cells(spark, sf)
    models = S.bayes(S.bin_counts(d.where("fold <> 0"), specs, "y", n="n"), specs, 3, [])
    scores = S.bayes_scores(specs, models, None)
    return d.where("fold = 0").groupBy(argmax_array(scores).alias("pred")).agg(F.sum("n").alias("n"))


DRAWS = S.random_settings(COLUMNS, 8, 1e-4, 10.0)
TRIALS_SQL = f"""{folded_sql()}, {linear_sql('f', COLUMNS, DRAWS, 3, range(FOLDS))},
p AS (SELECT name, fold, y, {linear_score_sql(COLUMNS, 3)} AS s FROM f JOIN wt ON own = fold),
q AS (SELECT name, fold, y, {FIRST_BEST} AS pred FROM p),
sc AS MATERIALIZED ({fold_score_sql('q', 'name, fold')}),
r0 AS (SELECT name, round(avg(score), {S.DIGITS}) AS mean FROM sc WHERE fold <= 0 GROUP BY name),
""" + "".join(f"r{r} AS (SELECT name, round(avg(score), {S.DIGITS}) AS mean FROM sc WHERE fold <= {r} AND name IN "
              f"(SELECT name FROM r{r - 1} WHERE mean >= (SELECT median(mean) FROM r{r - 1}) - 1e-{S.DIGITS}) GROUP BY name),\n" for r in range(1, FOLDS)) + f"""
given AS (SELECT name, count(*) AS folds FROM ({' UNION ALL '.join(f'SELECT name FROM r{r}' for r in range(FOLDS))}) GROUP BY name),
tr AS (SELECT CAST(name AS INTEGER) AS trial, CAST(given.folds AS INTEGER) AS folds, avg(score) AS mean FROM given JOIN sc USING (name) WHERE fold < given.folds GROUP BY name, given.folds),
best AS (SELECT trial FROM tr WHERE folds = {FOLDS} ORDER BY round(mean, {S.DIGITS}) DESC, trial LIMIT 1)"""
DRAWN = ", ".join(f"({i}, {d.ridge!r}::DOUBLE, {sum(d.use)})" for i, d in enumerate(DRAWS))


@query("grid_search", f"""
WITH {TRIALS_SQL}
SELECT trial, ridge, n_columns, folds, CASE WHEN folds = {FOLDS} THEN 'completed' ELSE 'pruned' END AS reason, round(mean, 6) AS score, trial = (SELECT trial FROM best) AS best
FROM tr JOIN (VALUES {DRAWN}) d(trial, ridge, n_columns) USING (trial)""")
def grid_search(spark, sf):
    return S.trial_table(spark, S.pruned_search(folded_rows(spark, sf, FEATURES), COLUMNS, "y", 3, FOLDS, DRAWS))


@query("search_reevaluation", f"""
WITH {TRIALS_SQL}, {linear_sql('f', COLUMNS, ALL_COLUMNS, 3, range(FOLDS), 'd_')},
dp AS (SELECT fold, y, {linear_score_sql(COLUMNS, 3)} AS s FROM f JOIN d_wt ON own = fold), dq AS (SELECT fold, y, {FIRST_BEST} AS pred FROM dp),
ds AS ({fold_score_sql('dq')}),
j AS (SELECT sc.score AS b, ds.score AS d FROM sc JOIN ds USING (fold) WHERE CAST(sc.name AS INTEGER) = (SELECT trial FROM best)),
k AS (SELECT count(*) AS n_folds, avg(b) AS bm, avg(d) AS dm, avg(b - d) AS m, stddev_samp(b - d) / sqrt(count(*)) AS se FROM j)
SELECT round(bm, 6) AS best_mean, round(dm, 6) AS default_mean, n_folds, round(m, 6) + 0.0::DOUBLE AS diff_mean, round(se, 6) AS diff_sem, m > 2 * se AS defensible FROM k""")
def search_reevaluation(spark, sf):
    d = folded_rows(spark, sf, FEATURES)
    best = S.best_trial(S.pruned_search(d, COLUMNS, "y", 3, FOLDS, DRAWS))
    return S.re_evaluated(d, COLUMNS, "y", 3, FOLDS, DRAWS[best], ALL_COLUMNS[0])


CONFIGS = {"baseline": FEATURES[:4], "plus_signal": FEATURES, "drop_price": ["l_quantity", "l_discount", "l_tax"]}


@query("ablation", f"""
WITH {folded_sql()}, {linear_sql('f', COLUMNS, [S.setting(n, COLUMNS, u) for n, u in CONFIGS.items()], 3, range(FOLDS))},
p AS (SELECT name AS config, fold, y, {linear_score_sql(COLUMNS, 3)} AS s FROM f JOIN wt ON own = fold),
q AS (SELECT config, fold, y, {FIRST_BEST} AS pred FROM p), sc AS MATERIALIZED ({fold_score_sql('q', 'config, fold')}),
j AS (SELECT a.config, avg(a.score - b.score) AS m, stddev_samp(a.score - b.score) / sqrt(count(*)) AS se FROM sc a JOIN sc b ON a.fold = b.fold AND b.config = 'baseline'
      WHERE a.config <> 'baseline' GROUP BY a.config)
SELECT config, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(any_value(m), 6) + 0.0::DOUBLE AS diff_mean, round(any_value(se), 6) AS diff_sem,
       any_value(m) > 2 * any_value(se) AS defensible FROM sc LEFT JOIN j USING (config) GROUP BY config""")
def ablation(spark, sf):
    return S.linear_ablation(folded_rows(spark, sf, FEATURES), COLUMNS, "y", 3, FOLDS, CONFIGS)


GAINS_SQL = f"""gc AS (SELECT own, c, b, y, n FROM bt),
gb AS (SELECT own, c, b, sum(n) AS n, sum(n * n) AS q FROM gc GROUP BY own, c, b),
gt AS (SELECT own, c, sum(n) AS n FROM gc GROUP BY own, c),
gy AS (SELECT own, c, sum(v * v) AS q FROM (SELECT own, c, y, sum(n) AS v FROM gc GROUP BY own, c, y) GROUP BY own, c),
gg AS (SELECT gt.own, gt.c, 1 - gy.q::DOUBLE / (gt.n::DOUBLE * gt.n) - sum(CASE WHEN gb.n > 0 THEN gb.n::DOUBLE / gt.n * (1 - gb.q::DOUBLE / (gb.n::DOUBLE * gb.n)) ELSE 0 END) AS gain
       FROM gt JOIN gy USING (own, c) JOIN gb USING (own, c) GROUP BY gt.own, gt.c, gt.n, gy.q)"""
NAMED = "CASE c " + " ".join(f"WHEN {i} THEN '{s.name}'" for i, s in enumerate(BINNED)) + " END"


@query("fold_importance", f"""
WITH {folded_sql()}, {bayes_sql('f', BINNED, 3, range(FOLDS))}, {GAINS_SQL}
SELECT {NAMED} AS feature, round(avg(gain), 6) AS importance FROM gg WHERE own >= 0 GROUP BY c""")
def fold_importance(spark, sf):
    cells, specs = folded_cells(spark, sf)
    return S.mean_gains(spark, S.split_gains(S.bin_counts(cells, specs, "y", n="n"), BINNED, 3, range(FOLDS)))


KEPT = 3
PRUNED = [c for c in COLUMNS if c.name in {b.name for b in BINNED}]


@query("feature_pruning", f"""
WITH {folded_sql()}, {bayes_sql('f', BINNED, 3, [])}, {GAINS_SQL},
top AS (SELECT feature FROM (SELECT {NAMED} AS feature, round(gain, 6) AS gain FROM gg WHERE own = -1) WHERE feature <> 'l_linestatus' ORDER BY gain DESC, feature LIMIT {KEPT}),
left_ AS (SELECT fold, y, {', '.join(f"CASE WHEN '{c.name}' IN (SELECT feature FROM top) THEN {c.name} END AS {c.name}" for c in PRUNED)} FROM f),
{linear_sql('left_', PRUNED, [S.setting('all', PRUNED)], 3, range(FOLDS))},
p AS (SELECT fold, y, {linear_score_sql(PRUNED, 3)} AS s FROM left_ JOIN wt ON own = fold), q AS (SELECT fold, y, {FIRST_BEST} AS pred FROM p)
SELECT fold, round(score, 6) AS score, (SELECT string_agg(feature, ',' ORDER BY feature) FROM top) AS features FROM ({fold_score_sql('q')})""")
def feature_pruning(spark, sf):
    d = folded_rows(spark, sf, [*FEATURES, "l_linestatus"])
    gains = S.mean_gains(spark, S.split_gains(S.bin_counts(d, BINNED, "y"), BINNED, 3, [S.ALL]))
    top = E.pruned_features(gains.where(F.col("feature") != "l_linestatus"), KEPT)
    oof = S.linear_out_of_fold(d, [c for c in COLUMNS if c.name in top], "y", 3, FOLDS)
    return E.oof_scores(oof, "y").select("fold", r6(F.col("score")).alias("score"), F.lit(",".join(sorted(top))).alias("features"))


def _swapped(c: S.Scaled) -> str:
    """The column's scaled value, from the donor row where it is the one that is swapped."""
    return c.sql().replace(c.name, f"(CASE WHEN feature = '{c.name}' THEN d_{c.name} ELSE {c.name} END)", 1)


class _Swapped:
    def __init__(self, c):
        self.c = c

    def sql(self):
        return _swapped(self.c)


@query("permutation_importance", f"""
WITH {folded_sql('h')}, f AS (SELECT * FROM h WHERE fold <> 0), {linear_sql('f', COLUMNS, ALL_COLUMNS, 3, [])},
v AS (SELECT *, row_number() OVER (ORDER BY md5({ROW_KEY.format(", '7'")})) AS a, row_number() OVER (ORDER BY md5({ROW_KEY.format(", '8'")})) AS b FROM h WHERE fold = 0),
z AS (SELECT x.*, {', '.join(f'd.{c.name} AS d_{c.name}' for c in COLUMNS)} FROM v x JOIN v d ON x.a = d.b),
u AS (SELECT z.*, unnest(['(none)', {', '.join(f"'{c.name}'" for c in COLUMNS)}]) AS feature FROM z),
p AS (SELECT feature, y, {linear_score_sql([_Swapped(c) for c in COLUMNS], 3)} AS s FROM u, wt WHERE own = -1),
q AS (SELECT feature, y, {FIRST_BEST} AS pred FROM p), sc AS MATERIALIZED ({fold_score_sql('q', 'feature')})
SELECT o.feature, round(n.score, 6) AS base, round(n.score - o.score, 6) + 0.0::DOUBLE AS drop FROM sc o, sc n WHERE n.feature = '(none)' AND o.feature <> '(none)'""")
def permutation_importance(spark, sf):
    d = folded_rows(spark, sf, [*KEY, *FEATURES])
    models = S.least_squares(S.cross_products(d.where("fold <> 0"), COLUMNS, "y"), ALL_COLUMNS, 3, [])["all"]
    return S.permutation_drops(d.where("fold = 0"), KEY, "y", COLUMNS, lambda columns: S.linear_scores(columns, models, None))


BASE = [S.Scaled(c, 0, 1) for m in range(3) for c in model_columns(m)]


@query("stacking", f"""
WITH {folded_sql()}, {linear_sql('f', BASE, [S.setting('all', BASE)], 3, range(FOLDS))},
p AS (SELECT fold, y, {linear_score_sql(BASE, 3)} AS s FROM f JOIN wt ON own = fold), q AS (SELECT fold, y, {FIRST_BEST} AS pred FROM p)
SELECT fold, round(score, 6) AS score, n FROM ({fold_score_sql('q')})""")
def stacking(spark, sf):
    return E.oof_scores(S.linear_out_of_fold(folded_rows(spark, sf, [c.name for c in BASE]), BASE, "y", 3, FOLDS), "y").select("fold", r6(F.col("score")).alias("score"), "n")


SEEDS = (3, 4)


def _soft(seed: int) -> str:
    rows = f"p{seed} AS ({bayes_score_sql(f'f{seed}', BINNED, 'fold', ', '.join([*KEY, 'y']), p=f'b{seed}')})"
    e = "list_transform(s, lambda x: exp(x - list_max(s)))"
    return f"{folded_sql(f'f{seed}', seed)}, {bayes_sql(f'f{seed}', BINNED, 3, range(FOLDS), f'b{seed}')}, {rows}, " \
           f"q{seed} AS (SELECT {', '.join(KEY)}, y, list_transform({e}, lambda x: round(x / list_sum({e}), {S.DIGITS})) AS s FROM p{seed})"


@query("seed_average", f"""
WITH {', '.join(_soft(x) for x in SEEDS)},
a AS (SELECT y, [round((a.s[1] + b.s[1]) / 2, 8), round((a.s[2] + b.s[2]) / 2, 8), round((a.s[3] + b.s[3]) / 2, 8)] AS s FROM q{SEEDS[0]} a JOIN q{SEEDS[1]} b USING ({', '.join(KEY)}, y)),
q AS (SELECT 0 AS one, y, {FIRST_BEST} AS pred FROM a)
SELECT round(score, 6) AS score, n FROM ({fold_score_sql('q', 'one')})""")
def seed_average(spark, sf):
    cells, names = seed_cells(spark, sf), [f"fold_{seed}" for seed in SEEDS]
    pairs = key_pairs(cells, names)
    for i, f in enumerate(names):
        models = S.bayes(S.bin_counts(cells, S.coded(BINNED, "code"), "y", f, "n"), BINNED, 3, range(FOLDS))
        pairs = pairs.withColumn(f"_p{i}", S.softmax(S.bayes_scores(S.coded(BINNED, f"code_{i}"), models, f)))
    mean = F.array(*[F.round((F.get("_p0", F.lit(c)) + F.get("_p1", F.lit(c))) / 2, 8) for c in range(3)])
    return E.oof_scores(pairs.select("y", F.lit(0).alias("fold"), mean.alias("probability"), "n"), "y", n="n").select(r6(F.col("score")).alias("score"), "n")


def seed_cells(spark, sf):
    """(y, code, whole, twin, fold_<seed>, n): the rows counted by what the models of all seeds see of them. `whole` rows have no part of their key missing."""
    whole = F.lit(True)
    for c in KEY:
        whole = whole & F.col(c).isNotNull()
    d = with_cents(scored(spark, sf)).withColumns({"code": F.expr(S.code_sql(BINNED)), "whole": whole})
    return seed_counts(d, KEY, "y", FOLDS, SEEDS, ["code", "whole"])


def key_pairs(cells, names):
    """The join of the rows with themselves by key and class, counted: (y, code_0, code_1, folds, n). A row alone in its key meets itself, rows that share
    one meet each other, and those without a whole key meet none."""
    whole = cells.where("whole")
    alone = whole.where("twin IS NULL").select("y", F.col("code").alias("code_0"), F.col("code").alias("code_1"), *names, "n")
    shared = whole.where("twin IS NOT NULL")
    left, right = (shared.groupBy("y", "twin", F.col("code").alias(f"code_{i}"), f).agg(F.sum("n").alias(f"n_{i}")) for i, f in enumerate(names))
    met = left.join(right, ["y", "twin"]).select("y", "code_0", "code_1", *names, (F.col("n_0") * F.col("n_1")).alias("n"))
    return alone.unionByName(met)


# ---- telling train from test ------------------------------------------------------------

def shift_sql(rows: str, columns, k: int) -> str:
    """CTEs from `rows` (key, y, columns) to au: the AUC of out-of-fold scores."""
    two = [S.setting("all", columns)]
    return f"""f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5({ROW_KEY.format(", '42'")})) - 1) % {k} AS INTEGER) AS fold FROM {rows}),
{linear_sql('f', columns, two, 2, range(k))},
p AS (SELECT y, {linear_score_sql(columns, 2)} AS s FROM f JOIN wt ON own = fold),
ra AS (SELECT y, rank() OVER (ORDER BY s[2]) + (count(*) OVER (PARTITION BY s[2]) - 1) / 2.0::DOUBLE AS r FROM p),
au AS (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(r) FILTER (y = 1) AS sr FROM ra)
SELECT n_pos, n_neg, round((sr - n_pos::DOUBLE * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg), 6) AS auc"""


def _shifted(train, test, columns, k):
    names = list(dict.fromkeys(c.name for c in columns))
    train, test = with_cents(train), with_cents(test)
    both = train.select(*KEY, *names, F.lit(0).alias("y")).unionByName(test.select(*KEY, *names, F.lit(1).alias("y")))
    d = S.linear_out_of_fold(stratified_folds(both, KEY, "y", k, carry=names), columns, "y", 2, k)
    return E.shift_decision(roc_auc(d.withColumn("p", F.get("probability", F.lit(1))), "p", F.col("y") == 1))


DECISION = "CASE WHEN auc <= 0.55 THEN 'ok' WHEN auc > 0.6 THEN 'investigate' ELSE 'watch' END AS decision"
ADVERSARIAL = [*COLUMNS[:4], S.Indicator("l_linestatus", "O")]


@query("adversarial_auc", f"""
SELECT *, {DECISION} FROM (WITH {LI}, rows_ AS (SELECT *, {CENTS} AS cents, CAST(split = 'test' AS INTEGER) AS y FROM li), {shift_sql('rows_', ADVERSARIAL, 3)} FROM au)""")
def adversarial_auc(spark, sf):
    tr, te = sides(lines(spark, sf))
    return _shifted(tr, te, ADVERSARIAL, 3)


SHIFTED = [S.Scaled("l_quantity", 0, 50), S.Scaled("l_tax", 0, 0.08), S.Indicator("l_linestatus", "O")]


@query("shift_decision", f"""
SELECT *, {DECISION} FROM (WITH {LI}, rows_ AS (SELECT * REPLACE (CASE WHEN split = 'test' THEN l_quantity * 1.5::DOUBLE ELSE l_quantity END AS l_quantity), {CENTS} AS cents, CAST(split = 'test' AS INTEGER) AS y FROM li),
{shift_sql('rows_', SHIFTED, 2)} FROM au)""")
def shift_decision(spark, sf):
    tr, te = sides(lines(spark, sf))
    return _shifted(tr, te.withColumn("l_quantity", F.col("l_quantity") * 1.5), SHIFTED, 2)


# ---- contributions of a fitted forest: the fit has no SQL --------------------------------

@query("forest_contributions")
def forest_contributions(spark, sf):
    """Ranking of the columns by class, and how far base and contributions are from the probabilities in the worst row."""
    d = frame(spark, sf)
    score = E.forest(FEATURES, "label", ["l_linestatus"], trees=5, depth=4, weight=None)(d)
    names = [*FEATURES, "l_linestatus"]
    leaves, tables, shares = C.forest_leaves(score(d), score.forest, names)
    # What a row has depends on its leaves alone: at most as many rows as the trees have combinations of leaves.
    cells = leaves.groupBy(*[f"_t{t}" for t in range(len(tables))], "probability").agg(F.count(F.lit(1)).alias("n"))
    c = keep(C.leaf_contributions(cells, tables, shares))
    gap = c.agg(F.max(F.array_max(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.abs(
        F.get("base", k) + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + F.get(x, k)) - F.get("probability", k))))).alias("gap")).scalar()
    return C.contribution_ranking(c, names, 3, "n").withColumn("worst_gap", r6(gap))
