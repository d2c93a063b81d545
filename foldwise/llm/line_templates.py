"""Line deduplication by a tree of log templates.

Lines are parsed to a fixed depth: by their number of tokens, then by their
leading tokens, with tokens that hold a digit as a wildcard. In a leaf, a token
that few documents have at its place is a variable field and becomes a wildcard
too. What is left is the line's template. A template that enough documents share
is dropped from all of them but the first.

Two more rules need no template: a long line whose masked form two documents
share, and a line of any length or kind that many documents have letter by
letter. Their documents are among those of the line's template, so the document
that keeps a line is the same by each rule.

Texts are read three times and never shuffled but for the last, and then only where the list of lost
lines is too large to be sent to all. The first reading leaves a row of hashes for each line; they
are counted. The second sends the hashed tokens of those lines whose leaf is busy. Lines of a
leaf are then parsed side by side, one matrix of tokens for a run of leaves; a
leaf with too many different lines is taken apart by token instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import SPACES, hash_filter, mix, passes, quoted, span_hashes, text_blocks, with_columns, word_spans, written
from foldwise.operators.lookup import estimated_bytes

#: Leading tokens that lead to a leaf; documents that make a template recur; tokens from which a line takes part; share of tokens that must be fixed.
DEPTH, LEAST_DOCS, LEAST_TOKENS, FIXED = 3, 3, 4, 0.6
#: Tokens from which a masked line recurs in two documents; documents in which a line recurs whatever its tokens.
PAIR_TOKENS, EXACT_DOCS = 20, 10
#: Different lines from which a leaf is taken apart; bytes up to which the lost lines are sent to all tasks.
LEAF_LINES, SENT_BYTES = 200_000, 32 << 20
#: Hash of a wildcard, and odd factors for places.
WILD, STEP, TURN = np.uint64(0x57494C44), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


# ---- lines of a batch as numbers -----------------------------------------------------

class Lines:
    """All lines of a block of texts that hold a word: row of the text, number in it, tokens, and the hashes of leaf, masked line and exact line."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, depth: int):
        start, end, row = word_spans(data, bounds)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        at = breaks[start] + row
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.n = np.diff(np.append(first, len(at)))
        self.row = row[first]
        self.i = breaks[start[first]] - breaks[bounds[self.row]]
        self.first = first
        self.tokens = np.where(digits[end] > digits[start], WILD, span_hashes(data, start, end))
        place = np.arange(len(at)) - np.repeat(first, self.n)
        with np.errstate(over="ignore"):
            placed = mix(self.tokens + (place.astype(np.uint64) + np.uint64(1)) * STEP)
            size = self.n.astype(np.uint64) * TURN
            if len(first):
                self.line = mix(np.add.reduceat(placed, first) + size)
                self.leaf = mix(np.add.reduceat(np.where(place < depth, placed, np.uint64(0)), first) ^ size)
            else:
                self.line = self.leaf = np.zeros(0, np.uint64)
        self.exact = span_hashes(data, start[first], end[first + self.n - 1]) if len(first) else self.line

    def packed(self, which: np.ndarray) -> pa.Array:
        """Token hashes of the lines `which`, eight bytes each, as binary."""
        n = self.n[which]
        offsets = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.first[which] - offsets[:-1], n) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(self.tokens[at].astype("<u8").tobytes())])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs as struct `row`, with k, the text t and the leading 60 bits d of its md5: a document is told apart by key and text."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    return rows.withColumn("d", F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("long"))


def hashed_lines(docs: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(k, d, i, n, leaf, line, exact) of every line with a word."""
    rows = _keyed(docs, key, text).select("k", "d", "t")

    def run(batches):
        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(2)):
                x = Lines(data, bounds, depth)
                at = pa.array(x.row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.i, pa.int32()), pa.array(x.n, pa.int32()),
                                                  _signed(x.leaf), _signed(x.line), _signed(x.exact)], ["k", "d", "i", "n", "leaf", "line", "exact"])

    return rows.mapInArrow(run, with_columns(rows, ["k", "d"], "i int, n int, leaf long, line long, exact long"))


def busy_lines(docs: DataFrame, key: str, text: str, marked: np.ndarray, depth: int, least_tokens: int) -> DataFrame:
    """(k, d, i, leaf, line, tokens) of the lines whose leaf passes the filter; a few of other leaves come along and make no template."""
    rows = _keyed(docs, key, text).select("k", "d", "t")
    sent = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches):
        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(2)):
                x = Lines(data, bounds, depth)
                which = np.flatnonzero((x.n >= least_tokens) & passes(sent.value, x.leaf))
                at = pa.array(x.row[which] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.i[which], pa.int32()), _signed(x.leaf[which]),
                                                  _signed(x.line[which]), x.packed(which)], ["k", "d", "i", "leaf", "line", "tokens"])

    return rows.mapInArrow(run, with_columns(rows, ["k", "d"], "i int, leaf long, line long, tokens binary"))


# ---- templates ---------------------------------------------------------------------------

def _cells(leaf: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, place, line, cell hash) of all tokens of some lines; a cell is a token at a place of a leaf."""
    n = np.array([len(t) // 8 for t in tokens], np.int64)
    token = np.frombuffer(b"".join(tokens), "<u8")
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        cell = mix(mix(token + (place.astype(np.uint64) + np.uint64(1)) * STEP) + leaf.view(np.uint64)[line] * TURN)
    return token, place, line, cell


def _templates(distinct: DataFrame, least_docs: int, fixed: float) -> DataFrame:
    """(line, template) of the different lines (leaf, line, docs, tokens) of leaves that fit a task: all lines of a leaf come one after another."""
    names = ["leaf", "line", "docs", "tokens"]

    def parse(rows):
        leaf, docs = rows[0], rows[2]
        token, _, line, cell = _cells(leaf, rows[3])
        _, owner = np.unique(cell, return_inverse=True)
        common = (np.bincount(owner, docs[line]) >= least_docs)[owner] & (token != WILD)
        n_lines = len(leaf)
        n, n_fixed = np.bincount(line, minlength=n_lines), np.bincount(line, common, minlength=n_lines)
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            shown = np.add.reduceat(np.where(common, mix(cell + TURN), np.uint64(0)), first)
            template = mix(shown + leaf.view(np.uint64))
        keep = n_fixed >= fixed * n
        return pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), _signed(template[keep])], ["line", "template"])

    def run(batches):
        held, size = [], 0

        def ready(all_of_them):
            nonlocal held, size
            rows = [np.concatenate([h[k] for h in held]) for k in range(3)] + [[t for h in held for t in h[3]]]
            cut = len(rows[0]) if all_of_them else int(np.searchsorted(rows[0], rows[0][-1]))  # the last leaf may go on
            held, size = [[r[cut:] for r in rows]], sum(map(len, rows[3][cut:]))
            return [r[:cut] for r in rows] if cut else None

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(names[k]).to_numpy() for k in range(3)] + [batch.column("tokens").to_pylist()])
            size += batch.column("tokens").nbytes
            if size > 8 << 20 and (rows := ready(False)):
                yield parse(rows)
        if held and len(held[0][0]) + len(held) > 1 and (rows := ready(True)):
            yield parse(rows)

    return distinct.select(*names).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "line long, template long")


def _wide_templates(distinct: DataFrame, least_docs: int, fixed: float) -> DataFrame:
    """The same for leaves of any size: one row for each token of each different line, counted and joined by cell."""
    def run(batches):
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            token, place, line, cell = _cells(leaf, batch.column("tokens").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("line").take(pa.array(line)), batch.column("docs").take(pa.array(line)), pa.array(place, pa.int32()), _signed(cell),
                                              pa.array(token == WILD)], ["line", "docs", "place", "cell", "wild"])

    cells = distinct.select("leaf", "line", "docs", "tokens").mapInArrow(run, "line long, docs long, place int, cell long, wild boolean")
    common = cells.where("NOT wild").groupBy("cell").agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs).select("cell")
    marked = cells.select("line", "place", "cell").join(common.withColumn("fixed", F.lit(1)), "cell", "left")
    shape = marked.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("fixed") == 1, F.col("cell")).alias("cell")))).alias("p"),
                                       F.count("fixed").alias("n_fixed"), F.count("*").alias("n"))
    return shape.where(F.col("n_fixed") >= fixed * F.col("n")).select("line", F.xxhash64("p").alias("template"))


def _but_first(member: DataFrame, by: str, least) -> DataFrame:
    """The rows (k, d, i, `by`) of what at least `least` documents share, less those of its first document."""
    of = member.groupBy(by).agg(F.count_distinct(F.struct("k", "d")).alias("docs"), F.min(F.struct(F.col("k").isNull(), "k", "d")).alias("first"))
    of = of.where(F.col("docs") >= least)
    return member.join(of, by).where(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("d") == F.col("first.d"))))


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS,
                    least_tokens: int = LEAST_TOKENS, fixed: float = FIXED, pair_tokens: int | None = PAIR_TOKENS,
                    exact_docs: int | None = EXACT_DOCS, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(k, d, gone), written: for each document that loses lines, their numbers from 0. least_tokens and fixed are for templates alone."""
    lines = written(hashed_lines(docs, key, text, depth), "template-lines")
    # Rows are counted first, not documents: what is rare by rows needs no closer look.
    kind = lambda k, least, name: F.struct(F.lit(k).alias("kind"), F.lit(least).alias("least"), F.col(name).alias("id"))
    marks = [F.when(F.col("n") >= least_tokens, kind(0, least_docs, "leaf"))]
    marks += [F.when(F.col("n") >= pair_tokens, kind(1, 2, "line"))] if pair_tokens is not None else []
    marks += [kind(2, exact_docs, "exact")] if exact_docs is not None else []
    often = lines.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.kind", "m.least", "m.id").agg(F.count("*").alias("n"))
    often = written(often.where(F.col("n") >= F.col("least")).select("kind", "least", "id"), "template-often")
    gone = []
    # Templates: the tokens of lines in busy leaves, each different line once.
    found = written(busy_lines(docs, key, text, hash_filter(often.where("kind = 0"), "id"), depth, least_tokens), "template-busy")
    distinct = found.groupBy("leaf", "line").agg(F.count_distinct(F.struct("k", "d")).alias("docs"), F.max("tokens").alias("tokens"))
    distinct = written(distinct, "template-distinct")
    wide = written(distinct.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_lines).select("leaf"), "template-wide")
    if wide.limit(1).count():
        shape = _templates(distinct.join(wide, "leaf", "left_anti"), least_docs, fixed).union(_wide_templates(distinct.join(wide, "leaf"), least_docs, fixed))
    else:
        shape = _templates(distinct, least_docs, fixed)
    member = found.select("k", "d", "i", "line").join(shape, "line")
    gone.append(_but_first(member, "template", least_docs).select("k", "d", "i"))
    if len(marks) > 1:
        same = often.where("kind > 0")
        member = lines.select("k", "d", "i", F.explode(F.array_compact(F.array(*marks[1:]))).alias("m")).select("k", "d", "i", "m.*")
        member = member.join(same, ["kind", "least", "id"]).select("k", "d", "i", F.struct("kind", "least", "id").alias("same"))
        gone.append(_but_first(written(member, "template-same"), "same", F.col("same.least")).select("k", "d", "i"))
    gone = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
    return written(gone.groupBy("k", "d").agg(F.collect_set("i").alias("gone")), "template-gone")


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs as struct `row`, with n_lines, n_dropped and `kept`, the text without its recurring lines.

    The first document of a template, by key (null keys last) and then by the text's md5, keeps its lines. Rows with one key and text are one
    document and share its fate. Blank lines always stay, and lines of few tokens unless exact_docs documents have them; a null text counts as empty, with
    one blank line; an empty table gives an empty table. Keys can be of any type that has an order, columns of docs can have any name. Tokens, lines and
    templates are told apart by 64-bit hashes.
    """
    gone = recurring_lines(docs, key, text, **options)
    gone = gone.select(F.col("k").alias("gone_k"), F.col("d").alias("gone_d"), "gone")
    gone = F.broadcast(gone) if estimated_bytes(gone) <= SENT_BYTES else gone
    both = _keyed(docs, key, text).join(gone, (F.col("d") == F.col("gone_d")) & F.col("k").eqNullSafe(F.col("gone_k")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    return both.select("row", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def without_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with their texts less recurring lines; rows that lose all their words go. The columns are those of docs.

    Nulls, empty texts, repeated rows and empty tables are as in drop_recurring_lines; a text that loses nothing stays as it is, null or not.
    """
    d = drop_recurring_lines(docs, key, text, **options)
    d = d.where((F.col("n_dropped") == 0) | (F.trim("kept", F.lit(SPACES)) != ""))
    return d.select(*[F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col(f"row.{quoted(c)}")).alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c)
                      for c in docs.columns])
