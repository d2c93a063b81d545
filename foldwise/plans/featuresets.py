"""Feature, encoder, imputation and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.num import r6
from foldwise.operators import bundle as U
from foldwise.operators import encode as D
from foldwise.operators import features as X
from foldwise.operators.lookup import left_chain
from foldwise.plans.common import FO, K, LI, LINE_KEY, ON, folded, lines, orders_with_nulls, query, sides
from foldwise.sources.tables import shared_path, table

KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
PAIRS = {"qty_line": ("l_quantity", "l_linenumber"), "disc_tax": ("l_discount", "l_tax"), "price_qty": ("l_extendedprice", "l_quantity")}


@query("adjacent_diffs", f"SELECT {KEY_SQL}, round(l_quantity - l_linenumber, 6) AS qty_line, round(l_discount - l_tax, 6) + 0.0 AS disc_tax FROM lineitem")
def adjacent_diffs(spark, sf):
    d = X.add_differences(table(spark, sf, "lineitem"), PAIRS, ["qty_line", "disc_tax"])
    return d.select(*LINE_KEY, *[r6(F.col(c)).alias(c) for c in ("qty_line", "disc_tax")])


@query("log_shift", f"SELECT {KEY_SQL}, round(ln(1 + l_discount + 0.01), 6) AS l_discount_log FROM lineitem")
def log_shift(spark, sf):
    d = X.add_log(table(spark, sf, "lineitem"), "l_discount", -0.01)
    return d.select(*LINE_KEY, r6(F.col("l_discount_log")).alias("l_discount_log"))


@query("log_shift_fitted", "SELECT c_custkey, round(ln(1 + c_acctbal - (SELECT min(c_acctbal) FROM customer)), 6) AS c_acctbal_log FROM customer")
def log_shift_fitted(spark, sf):
    d = X.add_log_fitted(table(spark, sf, "customer"), "c_acctbal")
    return d.select("c_custkey", r6(F.col("c_acctbal_log")).alias("c_acctbal_log"))


@query("model_frame", f"""
SELECT {KEY_SQL}, l_quantity, l_tax, l_returnflag, l_quantity - l_linenumber AS qty_line, round(ln(1 + l_discount + 0.01), 6) AS l_discount_log FROM lineitem""")
def model_frame(spark, sf):
    d = X.model_frame(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], ["qty_line", "disc_tax", "l_discount_log"],
                      drop=["l_discount", "disc_tax"], keep=LINE_KEY, pairs=PAIRS, log_column="l_discount", floor=-0.01)
    return d.withColumn("l_discount_log", r6(F.col("l_discount_log")))


@query("missing_flags", f"""
WITH {ON}, f AS (SELECT o_orderkey, CAST(o_totalprice IS NULL AS INTEGER) AS price_missing, CAST(o_orderpriority IS NULL AS INTEGER) AS priority_missing,
 CAST(o_orderstatus IS NULL AS INTEGER) AS status_missing, CASE WHEN pain <> -1 THEN pain END AS pain FROM onull)
SELECT *, least(price_missing + priority_missing + status_missing, 1) AS any_missing, price_missing + priority_missing + status_missing AS n_missing FROM f""")
def missing_flags(spark, sf):
    d = X.missing_flags(orders_with_nulls(spark, sf), {"price_missing": "o_totalprice", "priority_missing": "o_orderpriority", "status_missing": "o_orderstatus"},
                        "any_missing", "n_missing")
    return d.withColumn("pain", X.sentinel_to_null(F.col("pain"), -1)).select(
        "o_orderkey", "price_missing", "priority_missing", "status_missing", "pain", "any_missing", "n_missing")


RULES = (("big", "l_quantity", ">=", 40), ("tiny", "l_quantity", "<=", 5), ("mid", "l_quantity", ">", 20, "<=", 30), ("no_tax", "l_tax", "==", 0.0), ("deep", "disc", ">", 0.08))


@query("threshold_flags", f"""
SELECT {KEY_SQL}, CAST(l_quantity >= 45 AS INTEGER) AS big, CAST(l_quantity <= 5 AS INTEGER) AS tiny, CAST(l_quantity > 20 AND l_quantity <= 30 AS INTEGER) AS mid,
 CAST(l_tax = 0 AS INTEGER) AS no_tax, CAST(coalesce(CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END > 0.08, false) AS INTEGER) AS deep FROM lineitem""")
def threshold_flags(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("disc", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")))
    return X.threshold_flags(d, RULES, {"big": 45}).select(*LINE_KEY, "big", "tiny", "mid", "no_tax", "deep")


@query("guarded_ratio", f"""
WITH n AS (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax * 20 END AS t FROM lineitem)
SELECT {KEY_SQL}, round(l_quantity / CASE WHEN t IS NOT NULL THEN greatest(t, 1.0::DOUBLE) END, 6) AS qty_ratio,
 round(CASE WHEN t IS NOT NULL THEN greatest(1.2::DOUBLE - t, 0) END, 6) AS tax_deficit, round(greatest(36.0::DOUBLE - l_quantity, 0), 6) AS remaining_term FROM n""")
def guarded_ratio(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("t", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax") * 20))
    return d.select(*LINE_KEY, r6(X.guarded_ratio(F.col("l_quantity"), F.col("t"))).alias("qty_ratio"), r6(X.deficit(1.2, F.col("t"))).alias("tax_deficit"),
                    r6(X.deficit(36.0, F.col("l_quantity"))).alias("remaining_term"))


@query("composite_scores", f"""
WITH f AS (SELECT *, CAST(l_quantity >= 40 AS INTEGER) AS big, CAST(l_quantity <= 5 AS INTEGER) AS tiny, CAST(l_tax = 0 AS INTEGER) AS no_tax FROM lineitem)
SELECT {KEY_SQL}, big + tiny + no_tax AS n_odd, big + tiny AS n_size, CAST(l_quantity >= 48 OR l_discount > 0.09 AS INTEGER) AS critical FROM f""")
def composite_scores(spark, sf):
    d = X.threshold_flags(table(spark, sf, "lineitem"), RULES[:2] + RULES[3:4])
    d = X.row_sums(d, {"n_odd": ["big", "tiny", "no_tax"], "n_size": ["big", "tiny"]})
    return d.select(*LINE_KEY, "n_odd", "n_size", X.any_rule((("l_quantity", ">=", 48), ("l_discount", ">", 0.09))).alias("critical"))


@query("interactions", f"""
SELECT {KEY_SQL}, CAST(l_quantity >= 40 AND l_discount > 0.05 AS INTEGER) AS big_and_deep, round(l_quantity * l_discount, 6) AS qty_x_disc,
 round(l_linenumber * l_tax, 6) AS line_x_tax FROM lineitem""")
def interactions(spark, sf):
    d = X.threshold_flags(table(spark, sf, "lineitem"), RULES[:1])
    return d.select(*LINE_KEY, X.flag((F.col("big") == 1) & (F.col("l_discount") > 0.05)).alias("big_and_deep"),
                    r6(F.col("l_quantity") * F.col("l_discount")).alias("qty_x_disc"), r6(F.col("l_linenumber") * F.col("l_tax")).alias("line_x_tax"))


@query("ordinal_map", f"""
WITH {ON} SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 4 ELSE -1 END AS INTEGER) AS priority_code,
 CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 13 END AS INTEGER) AS status_code FROM onull""")
def ordinal_map(spark, sf):
    d = orders_with_nulls(spark, sf)
    codes = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 4}
    return d.select("o_orderkey", X.ordinal_code(F.col("o_orderpriority"), codes).alias("priority_code"),
                    X.ordinal_code(F.col("o_orderstatus"), {"O": 0, "F": 1}, 13).alias("status_code"))


@query("category_codes", f"""
WITH {LI}, f AS (SELECT l_suppkey, CAST(row_number() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT l_suppkey FROM li WHERE split = 'train' AND l_suppkey % 7 <> 0))
SELECT {KEY_SQL}, coalesce(c, -1) AS supp_code FROM li LEFT JOIN f USING (l_suppkey) WHERE split = 'test'""")
def category_codes(spark, sf):
    train, test = sides(lines(spark, sf).withColumn("supp", F.col("l_suppkey").cast("string")))
    codes = D.category_codes(train.where("l_suppkey % 7 <> 0"), "supp")
    return D.apply_codes(test, codes, "supp", "supp_code").select(*LINE_KEY, "supp_code")


@query("frequency_encode", f"""
WITH {LI}, f AS (SELECT l_suppkey, count(*) / (SELECT count(*) FROM li WHERE split = 'train' AND l_suppkey % 7 <> 0) AS fr FROM li WHERE split = 'train' AND l_suppkey % 7 <> 0 GROUP BY 1)
SELECT {KEY_SQL}, round(coalesce(fr, 0), 6) AS supp_freq FROM li LEFT JOIN f USING (l_suppkey) WHERE split = 'test'""")
def frequency_encode(spark, sf):
    train, test = sides(lines(spark, sf))
    f = D.frequencies(train.where("l_suppkey % 7 <> 0"), "l_suppkey")
    return D.apply_frequencies(test, f, "l_suppkey", "supp_freq").select(*LINE_KEY, r6(F.col("supp_freq")).alias("supp_freq"))


@query("text_counts", """
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(CASE WHEN doc_id % 10 <> 0 THEN text ELSE '' END, '\\s+'), lambda x: x <> '')) AS INTEGER) AS text_word_count,
 CAST(length(CASE WHEN doc_id % 10 <> 0 THEN text ELSE '' END) AS INTEGER) AS text_char_count FROM documents""")
def text_counts(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 10 != 0, F.col("text")))
    return X.text_counts(d, "text", "text").select("doc_id", "text_word_count", "text_char_count")


WORDS = ("the", "and the", "one", "der", "que", "est", "und", "email", "copyright", "license", "http", "phone")
TEMPORAL = ("the", "est", "and")


@query("keyword_flags", "SELECT doc_id, " + ", ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER) AS has_{w.replace(' ', '_')}" for w in WORDS)
       + ", " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in WORDS) + " AS n_keywords, "
       + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in TEMPORAL) + " AS n_temporal FROM documents")
def keyword_flags(spark, sf):
    d = X.keyword_flags(table(spark, sf, "documents"), "text", WORDS, "has_", "n_keywords")
    d = X.keyword_total(d, "text", TEMPORAL, "n_temporal")
    return d.drop("text", "lang", "source", "n_chars")


RISK_SQL = ", ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER) AS cc_has_{w.replace(' ', '_')}" for w in X.RISK_KEYWORDS)


@query("risk_keywords", f"SELECT doc_id, {RISK_SQL}, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in X.RISK_KEYWORDS)
       + " AS cc_n_high_risk_keywords, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in X.TEMPORAL_KEYWORDS) + " AS cc_n_temporal_keywords FROM documents")
def risk_keywords(spark, sf):
    d = X.keyword_flags(table(spark, sf, "documents"), "text", X.RISK_KEYWORDS, "cc_has_", "cc_n_high_risk_keywords")
    return X.keyword_total(d, "text", X.TEMPORAL_KEYWORDS, "cc_n_temporal_keywords").drop("text", "lang", "source", "n_chars")


@query("calendar_flags", f"""
SELECT {KEY_SQL}, CAST(isodow(l_shipdate) IN (6, 7) AS INTEGER) AS weekend, CAST(l_returnflag IN ('A', 'R') AS INTEGER) AS returned, CAST(l_linenumber = 7 AS INTEGER) AS last_line FROM lineitem""")
def calendar_flags(spark, sf):
    return table(spark, sf, "lineitem").select(
        *LINE_KEY, X.flag(F.dayofweek("l_shipdate").isin(1, 7)).alias("weekend"), X.flag(F.col("l_returnflag").isin("A", "R")).alias("returned"),
        X.flag(F.col("l_linenumber") == 7).alias("last_line"))


@query("drop_leaky", "SELECT l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def drop_leaky(spark, sf):
    d = X.drop_leaky(table(spark, sf, "lineitem"), [*LINE_KEY, "l_extendedprice"], ["l_returnflag", "l_linestatus", "l_shipdate"])
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("regime_bins", "SELECT CAST(CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount <= 0.07 THEN 1 ELSE 2 END AS INTEGER) AS regime, count(*) AS n FROM lineitem GROUP BY 1")
def regime_bins(spark, sf):
    return table(spark, sf, "lineitem").groupBy(X.regime_bins(F.col("l_discount"), (0.03, 0.07)).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("group_median_impute", f"""
WITH {ON}, m AS (SELECT o_orderstatus, o_orderpriority, median(o_totalprice) AS med FROM onull WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
f AS (SELECT o_orderkey, coalesce(o_totalprice, med) AS v FROM onull LEFT JOIN m USING (o_orderstatus, o_orderpriority))
SELECT o_orderkey, round(coalesce(v, (SELECT median(v) FROM f)), 6) AS o_totalprice FROM f""")
def group_median_impute(spark, sf):
    d = D.impute_group_median(orders_with_nulls(spark, sf), "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    return d.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@query("group_median_impute_fitted", f"""
WITH {ON}, t AS (SELECT * FROM onull WHERE o_orderkey % 4 <> 0), m AS (SELECT o_orderpriority, median(pain) AS med FROM (SELECT o_orderpriority, CASE WHEN pain <> -1 THEN pain::DOUBLE END AS pain FROM t) WHERE o_orderpriority IS NOT NULL GROUP BY 1),
f AS (SELECT coalesce(CASE WHEN pain <> -1 THEN pain::DOUBLE END, med) AS v FROM t LEFT JOIN m USING (o_orderpriority))
SELECT o_orderkey, coalesce(CASE WHEN pain <> -1 THEN pain::DOUBLE END, med, (SELECT median(v) FROM f)) AS pain FROM onull LEFT JOIN m USING (o_orderpriority) WHERE o_orderkey % 4 = 0""")
def group_median_impute_fitted(spark, sf):
    d = orders_with_nulls(spark, sf).withColumn("pain", X.sentinel_to_null(F.col("pain"), -1).cast("double"))
    return D.impute_group_median(d.where("o_orderkey % 4 = 0"), "pain", ["o_orderpriority"], fit=d.where("o_orderkey % 4 <> 0")).select("o_orderkey", "pain")


def encode_sql(keys: str, targets: dict[str, str], m: float = 10.0) -> str:
    sums = ", ".join(f"sum({t}) AS s_{n}" for n, t in targets.items())
    sel = ", ".join(f"round((coalesce(c.s_{n}, 0) - coalesce(o.s_{n}, 0) + {m} * (t.s_{n} - g.s_{n}) / (t.n - g.n)) / (c.n - coalesce(o.n, 0) + {m}), 6) AS {n}" for n in targets)
    return f"""
WITH {FO}, o AS (SELECT {keys}, fold, count(*) AS n, {sums} FROM fo GROUP BY ALL), c AS (SELECT {keys}, count(*) AS n, {sums} FROM fo GROUP BY ALL),
g AS (SELECT fold, count(*) AS n, {sums} FROM fo GROUP BY ALL), t AS (SELECT count(*) AS n, {sums} FROM fo)
SELECT {KEY_SQL}, {sel} FROM fo JOIN c USING ({keys}) JOIN o USING ({keys}, fold) JOIN g USING (fold), t"""


@query("target_encode_oof", encode_sql("l_suppkey", {"te_price": "l_extendedprice"}).replace(f"SELECT {KEY_SQL}", "SELECT l_orderkey, l_linenumber, l_partkey, fo.l_suppkey"))
def target_encode_oof(spark, sf):
    d = D.target_encode_oof(folded(spark, sf), ["l_suppkey"], {"te_price": F.col("l_extendedprice")}, K)
    return d.select(*LINE_KEY, r6(F.col("te_price")).alias("te_price"))


@query("target_encode_pair", encode_sql("l_linestatus, l_linenumber", {"te_qty": "l_quantity"}).replace(f"SELECT {KEY_SQL}", "SELECT l_orderkey, fo.l_linenumber, l_partkey, l_suppkey"))
def target_encode_pair(spark, sf):
    d = D.target_encode_oof(folded(spark, sf), ["l_linestatus", "l_linenumber"], {"te_qty": F.col("l_quantity")}, K)
    return d.select(*LINE_KEY, r6(F.col("te_qty")).alias("te_qty"))


@query("target_encode_ngram", encode_sql("l_linestatus, l_linenumber, l_tax", {"te_qty": "l_quantity"}).replace(f"SELECT {KEY_SQL}", "SELECT l_orderkey, fo.l_linenumber, l_partkey, l_suppkey"))
def target_encode_ngram(spark, sf):
    d = D.target_encode_oof(folded(spark, sf), ["l_linestatus", "l_linenumber", "l_tax"], {"te_qty": F.col("l_quantity")}, K)
    return d.select(*LINE_KEY, r6(F.col("te_qty")).alias("te_qty"))


@query("target_encode_multiclass", encode_sql("l_linestatus, l_tax", {f"te_{c}": f"CASE WHEN l_returnflag = '{c}' THEN 1.0::DOUBLE ELSE 0 END" for c in "ANR"}))
def target_encode_multiclass(spark, sf):
    targets = {f"te_{c}": (F.col("l_returnflag") == c).cast("double") for c in "ANR"}
    d = D.target_encode_oof(folded(spark, sf), ["l_linestatus", "l_tax"], targets, K)
    return d.select(*LINE_KEY, *[r6(F.col(c)).alias(c) for c in targets])


@query("group_stats", f"""
WITH {LI}, s AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM li WHERE split = 'train' GROUP BY 1)
SELECT {KEY_SQL}, round(m, 6) AS qty_mean, round(s, 6) AS qty_std, lo AS qty_min, hi AS qty_max FROM li LEFT JOIN s USING (l_suppkey) WHERE split = 'test'""")
def group_stats(spark, sf):
    train, test = sides(lines(spark, sf))
    d = D.group_stats(test, train, "l_suppkey", "l_quantity", "qty")
    return d.select(*LINE_KEY, r6(F.col("qty_mean")).alias("qty_mean"), r6(F.col("qty_std")).alias("qty_std"), "qty_min", "qty_max")


@query("digit_features", "SELECT o_orderkey, " + ", ".join(
    f"CAST((CAST(round(o_totalprice * 100) AS BIGINT) // {10 ** i}) % 10 AS INTEGER) AS digit_{i}" for i in range(6)) + " FROM orders")
def digit_features(spark, sf):
    return D.digit_features(table(spark, sf, "orders"), "o_totalprice", 2, 6, "digit").select("o_orderkey", *[f"digit_{i}" for i in range(6)])


@query("distribution_features", f"SELECT {KEY_SQL}, round(percent_rank() OVER (ORDER BY l_extendedprice), 6) AS price_pct FROM lineitem")
def distribution_features(spark, sf):
    return D.percentile_ranks(table(spark, sf, "lineitem"), "l_extendedprice", "price_pct").select(*LINE_KEY, r6(F.col("price_pct")).alias("price_pct"))


@query("standardize", f"""
SELECT {KEY_SQL}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity_z,
 round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) + 0.0 AS l_tax_z FROM lineitem""")
def standardize(spark, sf):
    d = D.standardise(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    return d.select(*LINE_KEY, r6(F.col("l_quantity_z")).alias("l_quantity_z"), r6(F.col("l_tax_z")).alias("l_tax_z"))


@query("polynomial", f"""
SELECT {KEY_SQL}, round(l_quantity * l_quantity, 6) AS q__q, round(l_quantity * l_tax, 6) AS q__t, round(l_tax * l_tax, 6) AS t__t FROM lineitem""")
def polynomial(spark, sf):
    d = table(spark, sf, "lineitem").withColumns({"q": F.col("l_quantity"), "t": F.col("l_tax")})
    return D.polynomial(d, ["q", "t"]).select(*LINE_KEY, *[r6(F.col(c)).alias(c) for c in ("q__q", "q__t", "t__t")])


@query("left_join_chain", f"""
SELECT {KEY_SQL}, l_quantity, o_orderstatus, o_totalprice, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey
""".replace("o_orderpriority FROM", "pr AS o_orderpriority FROM").replace("WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey",
            "WHERE o_orderkey % 3 <> 0) o ON l_orderkey = o.o_orderkey LEFT JOIN (SELECT o_orderkey AS k2, o_orderpriority AS pr FROM orders WHERE o_orderkey % 4 <> 0) p ON l_orderkey = k2"))
def left_join_chain(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    hist = o.where("l_orderkey % 3 <> 0").select("l_orderkey", "o_orderstatus", "o_totalprice")
    text = o.where("l_orderkey % 4 <> 0").select("l_orderkey", "o_orderpriority")
    return left_chain(table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity"), hist, text, on=["l_orderkey"])


@query("embedding_join", """
SELECT doc_id, CAST(embedding IS NOT NULL AS INTEGER) AS has_embedding, round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 0), 6) + 0.0 AS total,
 CAST(coalesce(len(embedding), 64) AS INTEGER) AS dim FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def embedding_join(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = D.embedding_join(table(spark, sf, "documents").select("doc_id"), e, "doc_id", "embedding", 64)
    s = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return d.select("doc_id", "has_embedding", r6(s).alias("total"), F.size("embedding").alias("dim"))


@query("l2_normalize", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, round(e[1] / l, 6) AS first, round(e[64] / l, 6) AS last, round(sqrt(list_sum(list_transform(e, lambda x: (x / l) * (x / l)))), 6) AS norm FROM n""")
def l2_normalize(spark, sf):
    d = table(spark, sf, "embeddings").withColumn("e", D.l2_normalise(F.col("embedding")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))
    return d.select("vec_id", r6(F.get("e", F.lit(0))).alias("first"), r6(F.get("e", F.lit(63))).alias("last"), r6(norm).alias("norm"))


@query("topk_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(r AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 15""")
def topk_per_group(spark, sf):
    from foldwise.operators.lookup import top_k_per_group
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_k_per_group(d, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 15)


@query("topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(25)


# ---- everything fitted as one artefact ---------------------------------------------------

BUNDLE = U.Plan(missing={"price_missing": "o_totalprice", "status_missing": "o_orderstatus"}, medians={"o_totalprice": ["o_orderstatus", "o_orderpriority"]},
                codes=["o_orderpriority"], shares=["o_orderstatus", "o_orderpriority"], ordinals={"o_orderstatus": {"F": 0, "P": 1, "O": 2}})


@query("feature_bundle", f"""
WITH {ON}, f AS (SELECT *, o_totalprice::DOUBLE AS x FROM onull WHERE o_orderkey % 5 <> 0), a AS (SELECT *, o_totalprice::DOUBLE AS x FROM onull WHERE o_orderkey % 5 = 0),
m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, quantile_cont(x, 0.5) AS med FROM f WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
r AS (SELECT quantile_cont(coalesce(x, med), 0.5) AS rest FROM f LEFT JOIN m ON s = o_orderstatus AND p = o_orderpriority),
c AS (SELECT o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM f WHERE o_orderpriority IS NOT NULL)),
hs AS (SELECT o_orderstatus AS s, count(*) / (SELECT count(o_orderstatus) FROM f)::DOUBLE AS share FROM f WHERE o_orderstatus IS NOT NULL GROUP BY 1),
hp AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(o_orderpriority) FROM f)::DOUBLE AS share FROM f WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, CAST(x IS NULL AS INTEGER) AS price_missing, CAST(o_orderstatus IS NULL AS INTEGER) AS status_missing, round(coalesce(x, med, rest), 6) AS o_totalprice,
  CAST(coalesce(code, -1) AS INTEGER) AS o_orderpriority_code, round(coalesce(hs.share, 0), 6) AS o_orderstatus_share, round(coalesce(hp.share, 0), 6) AS o_orderpriority_share,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS o_orderstatus_ord
FROM a CROSS JOIN r LEFT JOIN m ON m.s = o_orderstatus AND m.p = o_orderpriority LEFT JOIN c ON c.p = o_orderpriority LEFT JOIN hs ON hs.s = o_orderstatus LEFT JOIN hp ON hp.p = o_orderpriority""")
def feature_bundle(spark, sf):
    d = orders_with_nulls(spark, sf)
    path = shared_path(spark, "feature-bundle")
    U.fit(d.where("o_orderkey % 5 <> 0"), BUNDLE).save(path)
    out = U.load(spark, path).apply(d.where("o_orderkey % 5 = 0"))
    return out.select("o_orderkey", "price_missing", "status_missing", r6(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority_code",
                      r6(F.col("o_orderstatus_share")).alias("o_orderstatus_share"), r6(F.col("o_orderpriority_share")).alias("o_orderpriority_share"), "o_orderstatus_ord")
