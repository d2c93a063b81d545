"""Word frequencies, length statistics, batch padding and TF-IDF over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import let, order_key, r6, words
from foldwise.operators.lookup import attach, keep
from foldwise.operators.ranks import hash_rank, value_ranks


TOKEN = r"[\p{L}\p{N}_]{2,}"  # Fixed value: words of two or more characters.


def word_frequency(df: DataFrame, text: str, key: str = "word") -> DataFrame:
    """Occurrences of each whitespace word."""
    return df.select(F.explode(words(F.col(text))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, length: str, q: float = 0.95) -> DataFrame:
    """Mean, maximum and the nearest-rank quantile sorted[int(n * q)]."""
    r = value_ranks(df.select(F.col(length).cast("double").alias("v")), "v")
    at = F.least(F.floor(F.col("n_total") * F.lit(q)), F.col("n_total") - 1)
    hit = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    return r.agg(F.sum("n").alias("n"), r6(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
                 F.max("v").cast("bigint").alias("max"), F.max(F.when(hit, F.col("v"))).cast("bigint").alias("p95"))


def padding_plan(df: DataFrame, key: Sequence[str], length: str, batch: int, multiple: int = 8, seed: int = 42) -> DataFrame:
    """Shuffled batches, each padded to its longest row rounded up; how many tokens are padding."""
    t = hash_rank(df.withColumn("_h", order_key(key, seed)), "_h", [], out="_r")
    g = t.groupBy(F.floor(F.col("_r") / batch).cast("bigint").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(length).cast("bigint").alias("longest"), F.sum(length).cast("bigint").alias("tokens"))
    padded = F.ceil(F.col("longest") / multiple) * multiple
    return g.select("batch_id", "n_rows", "longest", padded.cast("bigint").alias("padded_to"),
                    (padded * F.col("n_rows") - F.col("tokens")).cast("bigint").alias("padding"))


def grams(text: Column, low: int = 1, high: int = 2, only: Sequence[str] | None = None) -> Column:
    """Lower-case word tokens of two or more characters, and their n-grams. With `only`, those made of these words alone."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit("unknown"))), F.lit(TOKEN), F.lit(0))
    if only is not None:
        toks = F.transform(toks, lambda x: F.when(x.isin(list(only)), x))

    def upto(t):
        parts, run = [t] if low == 1 else [], t
        for n in range(2, high + 1):
            # Each n-gram extends the (n-1)-gram at the same start by one word.
            run = F.zip_with(F.slice(run, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))),
                             F.slice(t, F.lit(n), F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
            if n >= low:
                parts.append(run)
        return F.concat(*parts)

    return let(toks, upto) if only is None else F.array_compact(let(toks, upto))


#: Frequent words that are sent to all tasks, at most.
MOST_WORDS = 2_000


def term_counts(fit: DataFrame, terms: Column) -> DataFrame:
    """(term, tf, df) from an array of terms for each document."""
    # In a sorted row each term's first place counts the document, every place an occurrence.
    marked = fit.select(F.array_sort(terms).alias("g")).select(
        F.explode(F.transform("g", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("g", i - 1))).alias("new")))).alias("t"))
    return marked.groupBy("t.term").agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.col("t.new")).alias("df"))


def fit_tfidf(fit: DataFrame, key: str, text: str, max_features: int = 200, min_df: int = 5) -> DataFrame:
    """Vocabulary of the most frequent terms with enough documents, with smoothed idf.

    A document is one row, so its distinct terms are found in place and only
    per-term sums are shuffled. Words are counted first. Where as many as are wanted
    occur `least` times, no rarer term can be in the vocabulary, and a pair occurs no
    more often than its words: pairs of rarer words are not counted, so that no task
    holds all different pairs.
    """
    single = keep(term_counts(fit, grams(F.col(text), 1, 1)))
    bar = single.where(F.col("df") >= min_df).orderBy(F.col("tf").desc()).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least")).first()
    often = []
    if bar["n"] == max_features:
        often = [r["term"] for r in single.where(F.col("tf") >= bar["least"]).select("term").limit(MOST_WORDS + 1).collect()]
    if often and len(often) <= MOST_WORDS:
        each = single.where(F.col("tf") >= bar["least"]).unionByName(term_counts(fit, grams(F.col(text), 2, 2, often)))
    else:
        each = single.unionByName(term_counts(fit, grams(F.col(text), 2, 2)))
    top = each.where(F.col("df") >= min_df).orderBy(F.col("tf").desc(), F.col("term")).limit(max_features)
    n = fit.agg(F.count(F.lit(1))).scalar()
    return top.select("term", "tf", "df", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def apply_tfidf(df: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """Sublinear tf x idf with unit length per document.

    The vocabulary has at most max_features rows; joining before counting drops the other
    terms before anything is shuffled.
    """
    toks = df.select(key, F.explode(grams(F.col(text))).alias("term"))
    hits = attach(toks, vocab.select("term", "idf"), ["term"], "inner").groupBy(key, "term", "idf").agg(F.count(F.lit(1)).alias("c"))
    w = hits.select(key, "term", ((1 + F.ln("c")) * F.col("idf")).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
