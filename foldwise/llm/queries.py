"""Thin queries over the operators: whole tables in, the digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import (bitplanes, block_labeller, bpe_stream, bwt_merge, cover_tree, katz, line_templates, partenum, separators, spaced_seeds, warc, weak_rules,
                          whitening)
from foldwise.llm.registry import ORACLES, QUERIES, query
from foldwise.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


# ---- 7: quality rules ---------------------------------------------------------------

def _weak_rules_sql() -> str:
    """The measures, votes and rounds of weak_rules as DuckDB SQL: one pair of steps for each round."""
    names = [r.name for r in weak_rules.RULES]
    v = ", ".join(f"CASE WHEN {r.poor} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS {r.name}" for r in weak_rules.RULES)
    odds = "ln(pi / (1 - pi)) + " + " + ".join(
        f"CASE {k} WHEN 1 THEN ln(a_{k} / (1 - b_{k})) WHEN -1 THEN ln((1 - a_{k}) / b_{k}) ELSE 0 END" for k in names)
    w = weak_rules
    share = lambda start, least, hit, miss: (
        f"least({w.MOST}, greatest({least}, ({w.PRIOR * start} + coalesce({hit}, 0)) / ({w.PRIOR} + coalesce({hit}, 0) + coalesce({miss}, 0))))")
    of = lambda k, side, vote: f"sum({side}) FILTER ({k} = {vote})"
    steps = ["p0 AS MATERIALIZED (SELECT " + f"CAST({w.GOOD} AS DOUBLE) AS pi, "
             + ", ".join(f"CAST({w.RIGHT_GOOD} AS DOUBLE) AS a_{k}, CAST({w.RIGHT_POOR} AS DOUBLE) AS b_{k}" for k in names) + ")"]
    for i in range(w.ROUNDS):
        steps.append(f"e{i} AS MATERIALIZED (SELECT patterns.*, n / (1 + exp(-({odds}))) AS g FROM patterns, p{i})")
        rates = [f"{share(w.RIGHT_GOOD, w.LEAST_GOOD, of(k, 'g', 1), of(k, 'g', -1))} AS a_{k}, "
                 f"{share(w.RIGHT_POOR, w.LEAST_POOR, of(k, 'n - g', -1), of(k, 'n - g', 1))} AS b_{k}" for k in names]
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT {share(w.GOOD, w.LEAST_POOR, 'sum(g)', 'sum(n - g)')} AS pi, {', '.join(rates)} FROM e{i})")
    gone = lambda chars: f"CAST(length(t) - length(regexp_replace(t, '{chars}', '', 'g')) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS h FROM w),
x AS (SELECT doc_id, h, unnest(h) AS gram, generate_subscripts(h, 1) AS i FROM g),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM y, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {gone('[#*$%&|<>]')} AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
             {gone('[A-Z]')} AS n_capitals, {gone('!')} AS n_bangs, {gone('[\\p{L}\\p{N}]')} AS n_plain, len(list_filter(w, lambda x: length(x) <= 3)) AS n_short_words
      FROM g LEFT JOIN z ON g.doc_id = z.doc_id),
v AS MATERIALIZED (SELECT *, {v}, ({w.BASE_FAILED}) AS base_failed FROM m),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, p{w.ROUNDS}"""


@query("op7_quality_rules", _weak_rules_sql())
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    measured = weak_rules.judge(docs, carry=["doc_id"])
    return measured.select("row.doc_id", *[F.col(f"m.{c}") for c in weak_rules.MEASURES[:5]], "base_failed", "kept")


# ---- 9: BPE encoding and decoding ---------------------------------------------------

def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_bpe_stream")
def op9_bpe_stream(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf, "documents"), vocabulary())


# ---- 5: token ids in files of planes ------------------------------------------------

@query("op5_bit_planes")
def op5_bit_planes(spark: SparkSession, sf: str) -> DataFrame:
    return bitplanes.shuffled_ids(table(spark, sf, "documents"), vocabulary(), end_id=1)


# ---- 6: web archives ----------------------------------------------------------------

@query("op6_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to FROM g""")
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- 10: similarity join of shingle sets --------------------------------------------

@query("op10_partenum")
def op10_partenum(spark: SparkSession, sf: str) -> DataFrame:
    groups = partenum.similar_groups(table(spark, sf, "documents").select("doc_id", "text"))
    return groups.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


# ---- 2: repeated substrings ---------------------------------------------------------

@query("op2_bwt_merge")
def op2_bwt_merge(spark: SparkSession, sf: str) -> DataFrame:
    return bwt_merge.digests(table(spark, sf, "documents"))


# ---- 4: language-model scores -------------------------------------------------------

@query("op4_katz")
def op4_katz(spark: SparkSession, sf: str) -> DataFrame:
    return katz.scores(table(spark, sf, "documents"))


# ---- 1: token counts from flat files ------------------------------------------------

@query("op1_separator_scan", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents")
def op1_separator_scan(spark: SparkSession, sf: str) -> DataFrame:
    return separators.token_counts(table(spark, sf, "documents"))


# ---- 3: benchmark decontamination ---------------------------------------------------

@query("op3_spaced_seeds")
def op3_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# ---- 8: line templates --------------------------------------------------------------

@query("op8_line_templates", r"""
WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
raw AS (SELECT k, t, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
tok AS (SELECT k, t, i, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM raw),
l AS (SELECT *, len(w) AS n, w[1:3] AS head FROM tok WHERE len(w) >= 4),
leaf AS (SELECT n, head FROM (SELECT DISTINCT k, t, n, head FROM l) GROUP BY n, head HAVING count(*) >= 3),
f AS (SELECT l.* FROM l JOIN leaf USING (n, head)),
u AS (SELECT n, head, w, count(DISTINCT (k, t)) AS docs FROM f GROUP BY n, head, w),
p AS (SELECT *, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM u),
c AS (SELECT *, CASE WHEN sum(docs) OVER (PARTITION BY n, head, place, token) >= 3 THEN token ELSE '<*>' END AS shown FROM p),
s AS (SELECT n, head, w, list(shown ORDER BY place) AS template FROM c GROUP BY n, head, w HAVING count(*) FILTER (shown <> '<*>') >= 0.6 * count(*)),
same AS (SELECT f.k, f.t, f.i, 3 AS least, array_to_string(s.template, ' ') AS id FROM f JOIN s USING (n, head, w)
         UNION ALL SELECT k, t, i, 2, array_to_string(w, ' ') FROM tok WHERE len(w) >= 20
         UNION ALL SELECT k, t, i, 10, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') FROM tok WHERE len(w) > 0),
r AS (SELECT least, id, min((k IS NULL, k, md5(t))) AS first FROM same GROUP BY least, id HAVING count(DISTINCT (k, t)) >= least),
g AS (SELECT DISTINCT same.k, same.t, same.i FROM same JOIN r USING (least, id) WHERE (same.k IS NULL, same.k, md5(same.t)) <> first),
o AS (SELECT raw.k, raw.t, list(raw.line ORDER BY raw.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n_dropped, count(*) AS n_lines
      FROM raw LEFT JOIN g ON raw.k IS NOT DISTINCT FROM g.k AND raw.t = g.t AND raw.i = g.i GROUP BY raw.k, raw.t)
SELECT k AS doc_id, n_lines, n_dropped, md5(array_to_string(coalesce(kept, []), chr(10))) AS kept_md5 FROM o""")
def op8_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_templates.drop_recurring_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.md5("kept").alias("kept_md5"))


# ---- 11: main text of web pages -------------------------------------------------------

@query("op11_block_labeller")
def op11_block_labeller(spark: SparkSession, sf: str) -> DataFrame:
    return block_labeller.article_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


# ---- 12: whitening of embeddings ------------------------------------------------------

@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).drop("deviation_text")


# ---- 13: hard negatives -----------------------------------------------------------------

@query("op13_hard_negatives")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return cover_tree.hard_negatives(rows, F.col("vec_id") % 100 == 0)
