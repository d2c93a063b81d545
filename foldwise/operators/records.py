"""Verified training records: answer checks, completion assembly, chat records, funnels and supervision accounting."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.num import let
from foldwise.operators import prompts as P

# The answer suffix of every prompt, the closing tag and the answer patterns.
PROMPT_SUFFIX = "\nPlease put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"
CLOSING_TAG = "</think>"
BOX_OPEN = "\\boxed{"
MESSAGES = "array<struct<role:string,content:string>>"
BOXED = r"(?s)\\boxed\{(.*?)\}"
BOXED_OPEN = r"\\boxed\{([^}]*)(?:\}|$)"

def last_boxed(text: Column, allow_open: bool = False, skip_empty: bool = False) -> Column:
    """Content of the last boxed answer, trimmed; missing without one. An inner brace ends the answer.

    `allow_open` also accepts a box the text ends in, `skip_empty` passes over blank ones.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(BOXED_OPEN if allow_open else BOXED), F.lit(1)), lambda x: F.trim(x))
    if skip_empty:
        found = F.filter(found, lambda x: x != "")
    return F.try_element_at(found, F.lit(-1))


def answers_match(derived: Column, answer: Column, category: Column | None = None) -> Column:
    """Exact text equality with the stored answer; numerals ignore case."""
    exact = derived == F.trim(answer)
    if category is None:
        return F.coalesce(exact, F.lit(False))
    return F.coalesce(F.when(category == "numeral", F.upper(F.trim(derived)) == F.upper(F.trim(answer)))
                      .when(category == "gravity", derived == answer).otherwise(exact), F.lit(False))


def assemble_completion(trace: Column, answer: Column) -> Column:
    """Reasoning up to the last box, the closing tag and the canonical box; missing without a box or a body."""
    def build(t):
        tail = F.length(F.substring_index(t, BOX_OPEN, -1)) + len(BOX_OPEN)
        body = F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - tail), r"\s+$", "")
        return F.when(t.rlike(BOXED), body)

    return let(let(trace, build), lambda body: F.when(
        body != "", F.concat(body, F.lit(f"\n{CLOSING_TAG}\n{BOX_OPEN}"), answer, F.lit("}"))))


def chat_messages(prompt: Column, completion: Column) -> Column:
    """User and assistant messages of one record."""
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(prompt, F.lit(PROMPT_SUFFIX)).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), completion.alias("content")))


def build_records(df: DataFrame, vocab: DataFrame | None = None, key: str = "id", traces: dict[str, dict[str, str]] = P.TRACES) -> DataFrame:
    """(key, category, status, messages) for every prompt.

    Nothing is filtered: `status` is written, unclassified, unsolved, bad_assembly or
    bad_box, so the funnel is one aggregation. Cipher prompts are solved when a
    vocabulary is given. `traces` has the lines of the reasoning.
    """
    src = df.select(key, "prompt", "answer").withColumn("category", P.classify(F.col("prompt")))
    answer = F.col("answer")

    def outcome(trace: Column) -> Column:
        """Status and messages from the trace, which is missing for an unsolved prompt."""
        def check(c):
            good = F.coalesce(last_boxed(c) == F.trim(answer), F.lit(False))
            status = F.when(c.isNull(), "bad_assembly").when(good, "written").otherwise("bad_box")
            return F.struct(status.alias("status"), F.when(good, chat_messages(F.col("prompt"), c)).alias("messages"))

        none = F.struct(F.lit("unsolved").alias("status"), F.lit(None).cast(MESSAGES).alias("messages"))
        return let(trace, lambda t: F.when(t.isNull(), none).otherwise(let(assemble_completion(t, answer), check)))

    def close(d: DataFrame, trace: Column) -> DataFrame:
        # The generator keeps later filters on the status from re-evaluating the whole trace.
        return d.select(key, "category", F.explode(F.array(outcome(trace))).alias("o")).select(key, "category", "o.status", "o.messages")

    rows = P.solve_rows(src if vocab is None else src.where(F.col("category").isNull() | (F.col("category") != "cipher")))
    ok = F.col("derived").isNotNull() & answers_match(F.col("derived"), answer, F.col("category"))
    out = close(rows, F.when(ok, P.trace_rows(traces=traces)))
    if vocab is not None:
        mine = src.where(F.col("category") == "cipher")
        j = mine.join(P.solve_cipher(mine, vocab, key, first_pass=True), key, "left")
        out = out.unionByName(close(j, F.when(answers_match(F.trim("derived"), answer), P.cipher_trace(traces["cipher"]))))
    return out.withColumn("status", F.when(F.col("category").isNull(), "unclassified").otherwise(F.col("status")))


def written(records: DataFrame) -> DataFrame:
    """The record schema that is stored: type and messages."""
    return records.where("status = 'written'").select(F.col("category").alias("type"), "messages")


def funnel(records: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """Per category and in total: classified, written, coverage and the drops by reason. Each of `categories` has a row, of zeros if it has no prompt."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = records.rollup("category").agg(
        F.grouping_id().alias("_g"), F.count_if(F.col("status") != "unclassified").alias("classified"), n("written").alias("written"),
        n("unclassified").alias("unclassified"), n("unsolved").alias("unsolved"), n("bad_assembly").alias("bad_assembly"), n("bad_box").alias("bad_box"))
    name = F.when(F.col("_g") == 1, "TOTAL").otherwise(F.coalesce("category", F.lit("(none)")))
    counts = ["classified", "written", "unclassified", "unsolved", "bad_assembly", "bad_box"]
    g = g.select(name.alias("category"), *counts)
    if categories:
        every = records.sparkSession.createDataFrame([(c,) for c in categories], "category string")
        g = every.join(g, "category", "full").select("category", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])
    return g.select("category", *counts, F.round(F.coalesce(F.try_divide(F.col("written") * 100.0, F.col("classified")), F.lit(0.0)), 2).alias("coverage_pct"))


# ---- supervision -----------------------------------------------------------------

#: Label of a token that is not learnt; id of the token that ends a record.
IGNORED, END_ID = -100, -1
TOKENS = "array<struct<id:bigint,start:int,stop:int>>"
#: Texts that are tokenised at once.
TEXTS = 64


def space_tokens(texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
    """(id, start, stop) of the white-space words of each text, the id being a hash."""
    import re
    import zlib
    word = re.compile(r"[^ \t\n\x0b\f\r]+")
    return [[(zlib.crc32(m[0].encode()), *m.span()) for m in word.finditer(t)] for t in texts]


def with_tokens(df: DataFrame, text: str, out: str = "tokens", tokenize: Callable[[Sequence[str]], list[list[tuple[int, int, int]]]] = space_tokens) -> DataFrame:
    """Add the tokens of a text with their character offsets. `tokenize` takes a batch of texts, such as the encodings and offsets of a library; a null
    text has none. Tokens are held as flat numbers, and as Python objects for TEXTS texts at a time only."""
    @F.arrow_udf(TOKENS)
    def run(column: pa.Array) -> pa.Array:
        offsets, parts = array("i", [0]), (array("q"), array("i"), array("i"))
        for at in range(0, len(column), TEXTS):
            for row in tokenize([t or "" for t in column.slice(at, TEXTS).to_pylist()]):
                for part, values in zip(parts, zip(*row)):
                    part.extend(values)
                offsets.append(len(parts[0]))
        flat = [pa.array(np.frombuffer(p, t)) for p, t in zip(parts, ("int64", "int32", "int32"))]
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, "int32")), pa.StructArray.from_arrays(flat, ["id", "start", "stop"]))

    return df.withColumn(out, run(F.col(text)))


def supervision_masks(df: DataFrame, prompt: str, completion: str, budget: int, tokenize=space_tokens, end_id: int = END_ID) -> DataFrame:
    """Add text, split (its characters before the completion), tokens with one end token, labels, prompt_len, completion_len, total_len and drop_reason.

    Prompt and completion are one text, a line break between them, tokenised once. The label of a token that begins in the completion is its id, others are
    IGNORED; the end token is learnt. A row over the budget loses its end, so it is dropped: as `prompt_fills_budget` where the prompt alone leaves no room for
    a completion token and the end, else as `truncated`.
    """
    start = F.length(F.coalesce(prompt, F.lit(""))) + 1
    out = df.withColumn("text", F.concat_ws("\n", F.coalesce(prompt, F.lit("")), F.coalesce(completion, F.lit("")))).withColumn("split", start)
    out = with_tokens(out, "text", tokenize=tokenize)
    end = F.struct(F.lit(end_id).cast("bigint").alias("id"), F.length("text").alias("start"), F.length("text").alias("stop"))
    out = out.withColumn("tokens", F.concat("tokens", F.array(end)))
    out = out.withColumn("labels", F.transform("tokens", lambda t: F.when(t["start"] >= F.col("split"), t["id"]).otherwise(F.lit(IGNORED).cast("bigint"))))
    n_p = F.size(F.filter("tokens", lambda t: t["start"] < F.col("split")))
    out = out.withColumns({"prompt_len": n_p, "completion_len": F.size("tokens") - n_p, "total_len": F.size("tokens")})
    return out.withColumn("drop_reason", F.when(F.col("prompt_len") + 2 > budget, "prompt_fills_budget").when(F.col("total_len") > budget, "truncated"))


def supervision_split(df: DataFrame, prompt: str, completion: str, budget: int, tokenize=space_tokens) -> DataFrame:
    """Token lengths of the unsupervised prompt and the supervised completion with its end token, and a drop reason."""
    kept = [*df.columns, "prompt_len", "completion_len", "total_len", "drop_reason"]
    return supervision_masks(df, prompt, completion, budget, tokenize).select(*kept)


def supervision_invariants(masked: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Kept rows that break a rule, counted in one aggregate from their tokens and labels.

    no_supervision: nothing learnt but the end. prompt_learnt: a prompt token has a label. completion_masked: a completion token has none or another's.
    no_end, many_ends: end tokens; end_not_last. no_closing_tag, no_box: not inside the supervised characters; tag_in_prompt.
    """
    learnt = F.transform(F.arrays_zip("tokens", "labels"), lambda x: F.struct(x["tokens"]["id"].alias("id"), x["labels"].alias("label"), (x["tokens"]["start"] >= F.col("split")).alias("own")))
    rows = masked.where(F.col("drop_reason").isNull()).withColumn("_t", learnt)
    ends = F.size(F.filter("_t", lambda x: x["id"] == end_id))
    answer, asked = F.substring("text", F.col("split") + 1, F.length("text")), F.substring("text", F.lit(1), F.col("split"))
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("n_kept"),
        count(~F.exists("_t", lambda x: x["own"] & (x["id"] != end_id)), "no_supervision"),
        count(F.exists("_t", lambda x: ~x["own"] & (x["label"] != IGNORED)), "prompt_learnt"),
        count(F.exists("_t", lambda x: x["own"] & (x["label"] != x["id"])), "completion_masked"),
        count(ends == 0, "no_end"), count(ends > 1, "many_ends"),
        count((ends > 0) & (F.coalesce(F.try_element_at("_t", F.lit(-1))["id"] != end_id, F.lit(True))), "end_not_last"),
        count(~answer.contains(CLOSING_TAG), "no_closing_tag"), count(~answer.contains(BOX_OPEN), "no_box"), count(asked.contains(CLOSING_TAG), "tag_in_prompt"))
