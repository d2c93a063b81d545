"""Quality rules as weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). No rule is
trusted as such: expectation-maximisation over the table of vote patterns finds
how often each rule is right about good and about poor documents and how many
documents are good. A document is kept by its posterior probability of being
good, not by passing every rule.

Everything runs as DataFrame expressions. The pattern table has at most three to
the power of the number of rules rows, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import SPACE_RE, SPACES, written


@dataclass(frozen=True)
class Rule:
    """A rule votes 1 where `good` holds, -1 where `poor` holds, else 0. Both are SQL over the measures."""
    name: str
    good: str
    poor: str


#: Thresholds are for whole documents of any language written with spaces.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars BETWEEN 3.5 * n_words AND 10 * n_words", "word_chars < 3 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("line_copies", "20 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_copies", "5 * n_repeat_words <= n_words", "5 * n_repeat_words > 2 * n_words"),
    Rule("capitals", "10 * n_capitals <= word_chars", "4 * n_capitals > word_chars"),
    Rule("shouting", "50 * n_bangs <= n_words", "10 * n_bangs > n_words"),
    Rule("plain_text", "100 * n_plain >= 93 * word_chars", "100 * n_plain < 89 * word_chars"),
    Rule("short_words", "10 * n_short_words >= n_words", "50 * n_short_words < n_words"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs", "n_plain", "n_short_words")

ROUNDS = 25
#: Accuracies that the rounds start from. A rule is mostly right about good documents, but about poor ones only where their fault is its own.
RIGHT_GOOD, RIGHT_POOR = 0.995, 0.15
#: Bounds: a rule is right about good documents more often than not, which keeps the two sides from changing places.
LEAST_GOOD, LEAST_POOR, MOST = 0.55, 0.02, 0.9995
#: Documents' worth of prior belief in the starting values, and the first share of good documents.
PRIOR, GOOD = 10.0, 0.9
#: The posterior probability of being good from which a document is kept.
LEAST = 0.5


def measured(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns `carry`) as struct `row`, with the measures as struct `m`. Columns of docs can have any name.

    A null text counts as empty: all its measures are 0. Three-word windows are compared by a 64-bit hash.
    """
    d = docs.select(F.struct(*[docs[c] for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    d = d.withColumn("trimmed", F.trim(F.col("t"), F.lit(SPACES)))
    d = d.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE_RE)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    n = F.size("w")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice("w", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    d = d.withColumn("h", windows)
    # The windows found twice or more, by position; each covers three words, less what the next one covers.
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform(
        "h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = F.sort_array(F.transform(F.filter("s", lambda x, k: (x["h"] == F.get("s", k + 1)["h"]) | (x["h"] == F.get("s", k - 1)["h"])), lambda x: x["i"]))
    d = d.withColumn("p", same)
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    gone = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    m = {
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"), "n_symbols": gone("[#*$%&|<>]"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": F.size("lines").cast("long"), "n_capitals": gone("[A-Z]"), "n_bangs": gone("!"),
        "n_plain": gone("[\\p{L}\\p{N}]"),
        "n_short_words": F.size(F.filter("w", lambda x: F.length(x) <= 3)).cast("long"),
    }
    return d.select("row", F.struct(*[m[k].alias(k) for k in MEASURES]).alias("m"))


#: The fixed checks that come before the vote.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def votes(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the struct `v` of votes to rows that have the struct `m`."""
    m = df.select("*", "m.*")
    v = [F.expr(f"CASE WHEN {r.poor} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END").alias(r.name) for r in rules]
    return m.select(*df.columns, F.struct(*v).alias("v"), F.expr(BASE_FAILED).alias("base_failed"))


@dataclass(frozen=True)
class Fit:
    """The share of good documents, and each rule's accuracy about good and about poor ones."""
    good: float
    right_good: dict[str, float]
    right_poor: dict[str, float]

    def log_odds(self) -> str:
        """SQL over the struct v: the log odds that a document is good."""
        terms = [repr(math.log(self.good / (1 - self.good)))]
        for k, a in self.right_good.items():
            b = self.right_poor[k]
            terms.append(f"CASE v.{k} WHEN 1 THEN {math.log(a / (1 - b))!r} WHEN -1 THEN {math.log((1 - a) / b)!r} ELSE 0.0D END")
        return " + ".join(f"CAST({t} AS DOUBLE)" for t in terms)

    def posterior(self):
        return F.expr(f"1.0D / (1.0D + exp(-({self.log_odds()})))")


def fit(patterns: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> Fit:
    """Expectation-maximisation over the pattern table: struct v and its number of documents n.

    Each round is one aggregate of that small table. Without documents the starting values stay.
    """
    names = [r.name for r in rules]
    now = Fit(GOOD, dict.fromkeys(names, RIGHT_GOOD), dict.fromkeys(names, RIGHT_POOR))
    for _ in range(rounds):
        p = patterns.withColumn("g", now.posterior() * F.col("n")).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum(F.when(F.col(f"v.{k}") == s, F.col(side))).alias(f"{k}_{side}_{s}") for k in names for side in "gb" for s in (1, -1)]
        got = {k: x or 0.0 for k, x in p.agg(F.sum("g").alias("g"), F.sum("n").alias("n"), *sums).first().asDict().items()}
        share = lambda start, least, hit, miss: min(MOST, max(least, (PRIOR * start + hit) / (PRIOR + hit + miss)))
        now = Fit(share(GOOD, LEAST_POOR, got["g"], got["n"] - got["g"]),
                  {k: share(RIGHT_GOOD, LEAST_GOOD, got[f"{k}_g_1"], got[f"{k}_g_-1"]) for k in names},
                  {k: share(RIGHT_POOR, LEAST_POOR, got[f"{k}_b_-1"], got[f"{k}_b_1"]) for k in names})
    return now


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, least: float = LEAST,
          carry: Sequence[str] | None = None) -> DataFrame:
    """One row per row of docs: struct `row` of its columns (or of `carry`), struct `m` of measures, struct `v` of votes, base_failed, posterior and kept.

    Repeated rows count as often as they occur. Rows with a null or empty text fail the base checks. An empty table gives an empty table.
    The measured rows are written to the shared folder, so texts are read and measured once.
    """
    voted = written(votes(measured(docs, text, carry), rules), "measured")
    model = fit(written(voted.groupBy("v").agg(F.count("*").alias("n")), "patterns"), rules)
    return voted.withColumn("posterior", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns. The rows are written with their measures, so a filter does not measure again."""
    return judge(docs, text).where("kept").select("row.*")
