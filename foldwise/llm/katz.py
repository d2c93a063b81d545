"""Katz backoff language model of any order, kept in tables: discounted n-gram counts and backoff weights, for scoring whole texts.

The classes are the training words, one end token, and one class for all unknown
words. A seen n-gram has its Good-Turing discounted relative frequency; after a
known context, an unseen one has what that leaves, shared out by the probability of
the next lower order among exactly the classes not seen there, so every distribution
sums to one. Where all counts are too large to be discounted, one more count is set
aside instead. The recursion ends with the discounted counts of single words.

A fitted Model is a few numbers and tables in parts by hash: the words with their
counts, and for each order from 2 the n-grams (context, word, count) by the hash of the
context, and the contexts (context, backoff weight). Texts other than those it
was made from are scored by the same joins, `score_with`.

Tokens are kept in blocks of texts (a written table) as numbers in the block's
own dictionary and never leave it. Words are 64-bit hashes; a block asks for its words
where their hash sends them. For each order a block asks once for each of its distinct
n-grams, where the hash of the context sends them; a context with many occurrences
is dealt out by the next word too. While a model is made, its n-grams are
counted from what the blocks ask, which carries training counts, so the n-grams of a block move once.
The context sums, added up over all parts, give the weights, for which blocks ask last.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.bitplanes import from_planes, to_planes
from foldwise.llm.common import hashed_words, mix, small_batches, text_blocks, written
from foldwise.llm.partenum import pack_by_group

#: Counts up to MOST are discounted. Tokens of a block, and dictionary words or tokens that meet in one group. A context has one part for each eighth of a group.
MOST, BLOCK, GROUP = 5, 1 << 21, 5 << 19
#: N-grams of a block whose probabilities are worked out at once.
PART = 1 << 17
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers under 2 ** 32, as compressed byte planes."""
    import zstandard
    z = zstandard.ZstdCompressor(level=3)
    planes = [z.compress(p) for p in to_planes(x.astype("<u4"), 8)]
    return np.array([len(x), *map(len, planes)], "<u4").tobytes() + b"".join(planes)


def pack_large(x: np.ndarray) -> bytes:
    """Non-negative integers of any size."""
    low = pack(x & 0xFFFFFFFF)
    return np.uint32(len(low)).tobytes() + low + pack(x >> 32)


def unpack_large(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return unpack(raw[4:4 + n]) | unpack(raw[4 + n:]) << 32


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard
    n, *sizes = np.frombuffer(raw, "<u4", 5).tolist()
    z, at, planes = zstandard.ZstdDecompressor(), 20, []
    for s in sizes:
        planes.append(z.decompress(raw[at:at + s]))
        at += s
    return from_planes(planes, n, 8).astype(kind)


@dataclass(frozen=True)
class Discount:
    """What is left of a count: factors of counts 1 to MOST; larger counts stay as they are."""
    factor: tuple[float, ...]

    @staticmethod
    def fitted(n: list[int]) -> Discount:
        """Katz's Good-Turing factors from how many n-grams occur 1, 2, .. MOST + 1 times.

        Where these counts do not allow them (none is zero or more than one), one absolute discount n1 / (n1 + 2 n2) is used, 1/2 without any
        n-gram that occurs once or twice.
        """
        if all(n):
            cut = (MOST + 1) * n[MOST] / n[0]
            f = [((r + 1) * n[r] / n[r - 1] / r - cut) / (1 - cut) if cut != 1 else 0.0 for r in range(1, MOST + 1)]
            if cut < 1 and all(0 < x < 1 for x in f):
                return Discount(tuple(f))
        d = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = min(max(d, 0.01), 0.99)
        return Discount(tuple((r - d) / r for r in range(1, MOST + 1)))

    def table(self) -> np.ndarray:
        """Factor by min(count, MOST + 1); 0 for count 0."""
        return np.array([0.0, *self.factor, 1.0])


@dataclass(frozen=True)
class Unigrams:
    words: int
    tokens: int
    discount: Discount
    unknown: float
    total: int

    @staticmethod
    def fitted(words: int, tokens: int, n: list[int]) -> Unigrams:
        d = Discount.fitted(n)
        left = sum((1 - f) * r * k for r, f, k in zip(range(1, MOST + 1), d.factor, n))
        return Unigrams(words, tokens, d, left / tokens if left else 1 / (tokens + 1), tokens + (not left))

    def probability(self, c: np.ndarray) -> np.ndarray:
        """By training count; unknown words share one class. Without any text to learn from, that class has everything."""
        return np.where(c > 0, self.discount.table()[np.minimum(c, MOST + 1)] * c / self.total, self.unknown)


def held_out(key: int | None, folds: int = 10) -> bool:
    """Whether a text is kept from training: crc32 of its key as text (a null one is empty) divides by `folds`."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds == 0


# ---- blocks ---------------------------------------------------------------------------------

BLOCK_SCHEMA = "block long, keys binary, empty binary, held binary, sizes binary, words binary, tokens binary, n_train long"
HEAD = ["keys", "empty", "held", "sizes", "words", "tokens"]


def blocks_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as blocks of about BLOCK tokens. Each text ends with the end token."""
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        keys, sizes, words, tokens, held = [], [], [], [], 0

        def row():
            u, to = np.unique(np.concatenate(words), return_inverse=True)
            to = np.split(to.astype(np.int32), np.cumsum([len(w) for w in words])[:-1])
            inverse = np.concatenate([own[t] for own, t in zip(to, tokens)])
            return {"block": part << 32 | seq, "keys": np.array([k or 0 for k in keys], np.int64).tobytes(), "empty": bytes(k is None for k in keys),
                    "held": bytes(map(held_out, keys)), "sizes": pack(np.concatenate(sizes)), "words": u.tobytes(), "tokens": pack(inverse), "n_train": len(keys) - sum(map(held_out, keys))}

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, data, bounds in text_blocks(batch.column(1)):
                h, at = hashed_words(data, bounds)
                n = len(bounds) - 1
                size = np.bincount(at, minlength=n)[:n] + 1
                t = np.full(len(h) + n, END, np.uint64)
                t[np.arange(len(h)) + at] = h
                # All tokens are held as numbers in the dictionary of these texts, not as hashes.
                u, t = np.unique(t, return_inverse=True)
                keys += own[first:first + n]
                sizes.append(size)
                words.append(u)
                tokens.append(t.astype(np.int32))
                held += len(t)
                if held >= BLOCK:
                    yield pa.RecordBatch.from_pylist([row()], arrow)
                    keys, sizes, words, tokens, held, seq = [], [], [], [], 0, seq + 1
        if keys:
            yield pa.RecordBatch.from_pylist([row()], arrow)

    arrow = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in HEAD), ("n_train", pa.int64())])
    with small_batches(docs.sparkSession):
        return written(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, BLOCK_SCHEMA), "katz-blocks")


# ---- the model and its tables ----------------------------------------------------------------

@dataclass
class Model:
    """Numbers, and tables with one packed row for each group: `words` (g, words, count), `grams[order]` (g, contexts, runs, numbers, counts: the words
    after each context) and `weights[order]` (g, contexts, bare, weight: log10 of the backoff weight)."""
    order: int
    uni: Unigrams
    begins: int
    n_words: int
    n_groups: int
    part: int
    words: DataFrame
    discounts: dict[int, Discount] = field(default_factory=dict)
    grams: dict[int, DataFrame] = field(default_factory=dict)
    weights: dict[int, DataFrame] = field(default_factory=dict)

    def numbers(self, below: int) -> Numbers:
        """With the discounts of the orders below one."""
        return Numbers(self.uni, self.begins, self.n_words, self.n_groups, self.part, {o: d for o, d in self.discounts.items() if o < below})

    def save(self, path: str) -> None:
        """Write the tables and the numbers under `path`."""
        spark = self.words.sparkSession
        self.words.write.parquet(f"{path}/words")
        for o in range(2, self.order + 1):
            self.grams[o].write.parquet(f"{path}/grams-{o}")
            self.weights[o].write.parquet(f"{path}/weights-{o}")
        plain = {"order": self.order, "uni": asdict(self.uni), "begins": self.begins, "n_words": self.n_words, "n_groups": self.n_groups, "part": self.part,
                 "discounts": {o: d.factor for o, d in self.discounts.items()}}
        spark.createDataFrame([(json.dumps(plain),)], "numbers string").coalesce(1).write.parquet(f"{path}/numbers")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        x = json.loads(spark.read.parquet(f"{path}/numbers").first()[0])
        u = x["uni"] | {"discount": Discount(tuple(x["uni"]["discount"]["factor"]))}
        orders = range(2, x["order"] + 1)
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Model(x["order"], Unigrams(**u), x["begins"], x["n_words"], x["n_groups"], x["part"], read("words"), {int(o): Discount(tuple(f)) for o, f in x["discounts"].items()},
                     {o: read(f"grams-{o}") for o in orders}, {o: read(f"weights-{o}") for o in orders})


@dataclass
class Numbers:
    """What tasks need to know of a model beside its tables."""
    uni: Unigrams
    begins: int
    n_words: int
    n_groups: int
    part: int
    discounts: dict[int, Discount]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)}


STATS = ["n", "tokens", *(f"r{r}" for r in range(1, MOST + 2))]
#: Packed rows of any step: whose, from or for which group, of which kind, up to seven columns, and statistics in the rows of tables.
CELLS = list("abcdefk")
ROW_NAMES = ["block", "g", "kind", *CELLS, *STATS]
ROW_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * len(CELLS), *[pa.int64()] * len(STATS)]
ROW_SCHEMA = ", ".join(["block long, g long, kind int", *(f"{c} binary" for c in CELLS), *(f"{c} long" for c in STATS)])
#: Kinds of rows that are regrouped: those of a table, those of a block that asks, and the head of a block.
TABLE, ASKED, WHOLE = -1, -2, 0


def _row(block: int | None, g: int | None, kind: int, *cells: bytes, stats: list[int] | None = None) -> tuple:
    return (block, g, kind, *cells, *[None] * (len(CELLS) - len(cells)), *(stats or [None] * len(STATS)))


def _packed(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(ROW_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(cols, ROW_KINDS)], ROW_NAMES)


def _stats(c: np.ndarray) -> list[int]:
    """How many counts are above 0, their sum, and how many are 1, 2, .."""
    return [int((c > 0).sum()), int(c.sum()), *np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[1:MOST + 2].tolist()]


def _totals(df: DataFrame) -> list[int]:
    return [x or 0 for x in df.where("n IS NOT NULL").agg(*[F.sum(c).alias(c) for c in STATS]).first()]


def _answered(asks: DataFrame, held: DataFrame | None, answer: Callable, label: str) -> DataFrame:
    """Rows that ask (kind ASKED) meet the table row of their group, if there is one already; `answer` gives the answers, and the table row if it makes it."""
    both = asks if held is None else asks.union(held)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next((r for r in rows if r["kind"] == TABLE), None)
        rows = [r for r in rows if r["kind"] == ASKED]
        return _packed(answer(rows[0]["g"], rows, own) if rows else [])

    out = written(both.groupBy("g").applyInArrow(meet, ROW_SCHEMA).withColumnRenamed("a", "counts"), label)
    return out.withColumnRenamed("counts", "a")


# ---- words: the lowest order -----------------------------------------------------------------

def ask_words(blocks: DataFrame, n_groups: int) -> DataFrame:
    """Each block's words by group, with their training counts in the block."""
    def spread(batches):
        for batch in batches:
            for b in _rows(batch):
                words, tokens = np.frombuffer(b["words"], np.uint64), unpack(b["tokens"])
                count = np.bincount(tokens[np.repeat(np.frombuffer(b["held"], np.uint8) == 0, unpack(b["sizes"]))], minlength=len(words))
                yield from _packed([_row(b["block"], g, ASKED, h.tobytes(), pack(count[o])) for g, o, h in pack_by_group(np.arange(len(words)), words, n_groups)]).to_batches()

    return blocks.select("block", "held", "sizes", "words", "tokens").mapInArrow(spread, ROW_SCHEMA)


def word_answers(blocks: DataFrame, n_groups: int, held: DataFrame | None) -> DataFrame:
    """For each block and group (kind 1) the counts and numbers of its words, in their order; number 0 is an unknown word. Without the table `held` it is
    made of the training counts (kind TABLE)."""
    def answer(g, rows, own):
        words = [np.frombuffer(r["a"], np.uint64) for r in rows]
        if own:
            known, c = np.frombuffer(own["a"], np.uint64), unpack_large(own["b"])
        else:
            known, to = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(to, np.concatenate([unpack(r["b"]) for r in rows]), minlength=len(known)).astype(np.int64)
            known, c = known[c > 0], c[c > 0]
        out = [] if own else [_row(None, g, TABLE, known.tobytes(), pack_large(c), stats=_stats(c))]
        for r, w in zip(rows, words):
            at, there = _places(known, w)
            out.append(_row(r["block"], g, 1, pack_large(np.where(there, c[at], 0) if len(c) else np.zeros(len(w), np.int64)), pack(np.where(there, at + 1, 0))))
        return out

    return _answered(ask_words(blocks, n_groups), held, answer, "katz-words")


def _places(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


# ---- a block and its n-grams -----------------------------------------------------------------

class Block:
    """A block's distinct n-grams of one order after the other, from words up.

    Of the order reached: `pair` (of each token, which n-gram ends there), `context` (which n-gram of the order before, or the number of those for the begin
    of a text), `word`, `lower` (the n-gram without its first word), `hashes` and `total` of the contexts, and log10 probabilities once answered.
    """

    def __init__(self, cells: dict, answers: list[dict], x: Numbers):
        self.x, self.order = x, 1
        self.own, self.tokens, self.sizes = np.frombuffer(cells["e"], np.uint64), unpack(cells["f"], np.int32), unpack(cells["d"])
        self.held = np.frombuffer(cells["c"], np.uint8)
        n = len(self.own)
        self.known, self.number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        given = {a["g"]: a for a in answers}
        for g, o, _ in pack_by_group(np.arange(n), self.own, x.n_words):
            self.known[o] = unpack_large(given[g]["a"])
            number = unpack(given[g]["b"])
            self.number[o] = np.where(number > 0, (number - 1) * x.n_words + g + 1, 0)
        self.first = np.cumsum(np.r_[0, self.sizes])[:-1]
        self.pair, self.count, self.begin, self.of_pair = self.tokens, self.known, BEGIN, self.own
        self.log10 = np.log10(x.uni.probability(self.known))

    def next(self) -> None:
        """Go one order up: the n-grams of this order become contexts."""
        if self.order > 1:
            with np.errstate(over="ignore"):
                self.of_pair = mix(self.hashes[self.context] * np.uint64(0xD6E8FEB86659FD93) + self.own[self.word])
                self.begin = mix(np.array([self.begin]) + BEGIN)[0]
        n, m = len(self.own), len(self.count)
        both = np.empty(len(self.tokens), np.int64)
        both[1:] = self.pair[:-1]
        both[self.first] = m
        both *= n
        both += self.tokens
        order = np.argsort(both).astype(np.int32)
        both = both[order]
        new = np.r_[True, both[1:] != both[:-1]]
        both = both[new]
        self.lower = self.pair[order[new]]
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.context, self.word = (both // n).astype(np.int32), (both % n).astype(np.int32)
        self.hashes, self.total = np.append(self.of_pair, self.begin), np.append(self.count, self.x.begins)
        self.parts = self.total // self.x.part + 1
        self.order += 1

    def trained(self) -> np.ndarray:
        """How often each n-gram occurs in the training texts of the block."""
        return np.bincount(self.pair[np.repeat(self.held == 0, self.sizes)], minlength=len(self.word))

    def dealt(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, n-grams, starts of contexts among them) in one order whenever it is asked for; n-grams after a context without training are left out."""
        n_groups = self.x.n_groups
        some = np.flatnonzero((self.total > 0)[self.context])
        to = (self.hashes % np.uint64(n_groups)).astype(np.int32)[self.context[some]]
        many = np.flatnonzero((self.parts > 1)[self.context[some]])
        with np.errstate(over="ignore"):
            of = some[many]
            place = mix(self.own[self.word[of]]) % self.parts[self.context[of]].astype(np.uint64) + np.uint64(1)
            to[many] = mix(self.hashes[self.context[of]] + place * np.uint64(0x9FB21C651E98DF25)) % np.uint64(n_groups)
        end = np.cumsum(np.bincount(to, minlength=n_groups))
        order = some[np.argsort(to, kind="stable")].astype(np.int32)
        del to, many, place, some, of
        for g in np.flatnonzero(np.diff(end, prepend=0)).tolist():
            o = order[end[g - 1] if g else 0:end[g]]
            o = o[np.lexsort((self.number[self.word[o]], self.hashes[self.context[o]]))]
            yield g, o, np.flatnonzero(np.r_[True, np.diff(self.context[o]) != 0])

    def answered(self, answers: list[dict], weights: list[dict]) -> None:
        """Take counts and weights: a seen n-gram has its discounted share, another one the weight of its context times what the order below gives."""
        c, given = np.zeros(len(self.word), np.int64), {a["g"]: a for a in answers}
        for g, o, _ in self.dealt():
            c[o] = unpack_large(given[g]["a"])
        bare, weight = np.zeros(len(self.total), bool), np.zeros(len(self.total))
        by_hash = np.argsort(self.hashes)
        for w in weights:
            at = by_hash[np.searchsorted(self.hashes, np.frombuffer(w["a"], np.uint64), sorter=by_hash)]
            bare[at], weight[at] = np.frombuffer(w["b"], bool), np.frombuffer(w["c"])
        f, out_of, below = self.x.discounts[self.order].table(), np.maximum(1, self.total + bare), self.log10
        self.log10 = np.empty(len(c))
        for k in range(0, len(c), PART):
            some = slice(k, k + PART)
            of, own = self.context[some], c[some]
            with np.errstate(divide="ignore"):
                seen = np.log10(f[np.minimum(own, MOST + 1)] * own / out_of[of])
            self.log10[some] = np.where(own > 0, seen, weight[of] + below[self.lower[some]])
        self.count = c


def _gathered(blocks: DataFrame, known: list[DataFrame], columns: list[str], x: Numbers, use: Callable, schema: str) -> DataFrame:
    """`use` of (cells of the block's head, Block of the highest order that is answered), block by block. Answers of an order o have kind 2 o - 1, weights 2 o."""
    cells = [(F.col(c) if c in columns else F.lit(None).cast("binary")).alias(n) for c, n in zip(HEAD, CELLS)]
    none = [F.lit(None).cast("binary").alias(n) for n in CELLS[len(HEAD):]] + [F.lit(None).cast("long").alias(n) for n in STATS]
    parts = blocks.select("block", F.lit(None).cast("long").alias("g"), F.lit(WHOLE).alias("kind"), *cells, *none)
    for k in known:
        parts = parts.union(k.where("block IS NOT NULL"))

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            by.setdefault(r["kind"], []).append(r)
        head = by[WHOLE][0]
        b = Block(head, by.get(1, []), x)
        for o in sorted(x.discounts):
            b.next()
            b.answered(by.get(2 * o - 1, []), by.get(2 * o, []))
        return use(head, b)

    return parts.groupBy("block").applyInArrow(run, schema)


# ---- n-grams of an order above 1 -------------------------------------------------------------

def ask_grams(blocks: DataFrame, known: list[DataFrame], x: Numbers) -> DataFrame:
    """Each block's distinct n-grams of the next order by group: contexts, number of words after each, the different words (high and low part of their
    numbers), which of them, training counts in the block, and of the different words the counts (order 2), or of each n-gram the probability one order below."""
    def spread(head, b):
        b.next()
        count, rows, lower = b.trained(), [], None if b.order == 2 else 10 ** b.log10[b.lower]
        for g, o, start in b.dealt():
            w, to = np.unique(b.word[o], return_inverse=True)
            order = np.argsort(b.number[w], kind="stable")
            rank = np.empty(len(w), np.int64)
            rank[order] = np.arange(len(w))
            number, context = b.number[w][order], b.hashes[b.context[o][start]]
            below = pack_large(b.known[w][order]) if lower is None else lower[o].tobytes()
            rows.append(_row(head["block"], g, ASKED, context.tobytes(), pack(np.diff(np.r_[start, len(o)])), pack(number >> 32),
                             pack(np.diff(number & 0xFFFFFFFF, prepend=0) % (1 << 32)), pack(rank[to]), pack(count[o]), below))
        return _packed(rows)

    return _gathered(blocks, known, ["held", "sizes", "words", "tokens"], x, spread, ROW_SCHEMA)


def gram_answers(asks: DataFrame, order: int, uni: Unigrams, held: DataFrame | None, label: str) -> DataFrame:
    """For each block and group (kind 2 order - 1) the counts of its n-grams, in the order of Block.dealt, and the contexts whose weight it needs.

    Without the table `held` it is made of the training counts (kind TABLE): the n-grams, and of each context, or of its part here, the counts of
    counts and the probability that the order below gives to the words seen after it.
    """
    def answer(g, rows, own):
        runs = [unpack(r["b"]) for r in rows]
        contexts, run = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows]), return_inverse=True)
        context = np.repeat(run, np.concatenate(runs))
        w, below = [], []
        for r in rows:
            to = unpack(r["e"])
            w.append((unpack(r["c"]) << 32 | np.cumsum(unpack(r["d"])) % (1 << 32))[to])
            if not own:
                below.append(uni.probability(unpack_large(r["k"]))[to] if order == 2 else np.frombuffer(r["k"]))
        w = np.concatenate(w)
        if own:
            c, bare = _looked_up(own, contexts, context, w)
            out = []
        else:
            below = np.concatenate(below)
            at = np.lexsort((w, context))
            context, w = context[at], w[at]
            new = np.r_[True, (context[1:] != context[:-1]) | (w[1:] != w[:-1])]
            pair = np.empty(len(w), np.int32)
            pair[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            pair_context, pair_below, pair_w = context[new], below[at[new]], w[new]
            del at, below, context, w
            total = np.bincount(pair, np.concatenate([unpack(r["f"]) for r in rows]), minlength=int(new.sum())).astype(np.int64)
            seen = np.bincount(pair_context, np.where(total > 0, pair_below, 0.0), minlength=len(contexts))
            of = np.stack([np.bincount(pair_context[total == r], minlength=len(contexts)) for r in range(1, MOST + 1)], axis=1)
            n = np.bincount(pair_context, total, minlength=len(contexts)).astype(np.int64)
            bare, c, use = of.sum(axis=1) == 0, total[pair], total > 0
            there = np.bincount(pair_context[use], minlength=len(contexts))
            some = there > 0
            out = [_row(None, g, TABLE, contexts[some].tobytes(), pack(there[some]), pack_large(pair_w[use]), pack_large(total[use]),
                        of[some].astype(np.int64).tobytes(), seen[some].tobytes(), n[some].tobytes(), stats=_stats(total))]
        size, n_runs = [int(x.sum()) for x in runs], [len(x) for x in runs]
        for r, n, mine, p in zip(rows, runs, np.split(run, np.cumsum(n_runs)[:-1]), np.split(c, np.cumsum(size)[:-1])):
            need = (np.minimum.reduceat(p, np.cumsum(np.r_[0, n])[:-1]) == 0) | bare[mine]
            out.append(_row(r["block"], g, 2 * order - 1, pack_large(p), contexts[mine[need]].tobytes()))
        return out

    return _answered(asks, held, answer, label)


def _looked_up(table: dict, contexts: np.ndarray, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams, and whether a context has none that is discounted here, from a table's row."""
    held, runs, numbers, counts = np.frombuffer(table["a"], np.uint64), unpack(table["b"]), unpack_large(table["c"]), unpack_large(table["d"])
    at, there = _places(held, contexts)
    if not len(held):
        return np.zeros(len(w), np.int64), np.ones(len(contexts), bool)
    most = int(max(numbers.max(initial=0), w.max(initial=0))) + 1
    low = np.bincount(np.repeat(np.arange(len(held)), runs), counts <= MOST, minlength=len(held)) > 0
    i, found = _places(np.repeat(np.arange(len(held)), runs) * most + numbers, at[context] * most + w)
    return np.where(found & there[context], counts[i], 0), ~(there & low[at])


def context_weights(grams: DataFrame, discount: Discount, n_groups: int, label: str) -> DataFrame:
    """The table of backoff weights: what the discounts of all parts of a context leave, over what the order below gives to the words not seen after it."""
    names = [f"s{r}" for r in range(1, MOST + 1)]

    def parts(batches):
        for batch in batches:
            for t in _rows(batch):
                h = np.frombuffer(t["a"], np.uint64)
                cols = [h.view(np.int64), (h % np.uint64(n_groups)).astype(np.int64), *np.ascontiguousarray(np.frombuffer(t["e"], np.int64).reshape(-1, MOST).T),
                        np.frombuffer(t["k"], np.int64), np.frombuffer(t["f"])]
                for k in range(0, len(h), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 50_000]) for c in cols], ["context", "g", *names, "n", "seen"])

    def packed(table: pa.Table) -> pa.Table:
        h = table["context"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h = h[order]
        get = lambda c: table[c].to_numpy()[order]
        of, n = np.stack([get(c) for c in names], axis=1), get("n")
        left = of @ ((1 - np.array(discount.factor)) * np.arange(1, MOST + 1))
        weight = np.log10(np.where(left > 0, left / n, 1 / (n + 1))) - np.log10(np.maximum(1e-300, 1 - get("seen")))
        return _packed([_row(None, table["g"][0].as_py(), TABLE, h.tobytes(), (of.sum(axis=1) == 0).tobytes(), weight.tobytes())])

    sums = grams.select("a", "e", "f", "k").mapInArrow(parts, ", ".join(["context long, g long", *(f"{n} long" for n in names), "n long, seen double"]))
    sums = sums.groupBy("context", "g").agg(*[F.sum(c).alias(c) for c in (*names, "n", "seen")])
    return written(sums.groupBy("g").applyInArrow(packed, ROW_SCHEMA), label)


def weight_answers(counted: DataFrame, order: int, weights: DataFrame, n_groups: int, label: str) -> DataFrame:
    """For each block and group (kind 2 order) the contexts asked for in `counted`, whether they are bare, and their weights."""
    def spread(batches):
        for batch in batches:
            for r in _rows(batch):
                h = np.frombuffer(r["b"], np.uint64)
                yield from _packed([_row(r["block"], g, ASKED, own.tobytes()) for g, _, own in pack_by_group(np.arange(len(h)), h, n_groups)]).to_batches()

    def answer(g, rows, own):
        out = []
        for r in rows:
            h = np.frombuffer(r["a"], np.uint64)
            at, there = _places(np.frombuffer(own["a"], np.uint64), h) if own else (np.zeros(len(h), np.int64), np.zeros(len(h), bool))
            at = at[there]
            if len(at):
                out.append(_row(r["block"], g, 2 * order, h[there].tobytes(), np.frombuffer(own["b"], bool)[at].tobytes(), np.frombuffer(own["c"])[at].tobytes()))
        return out

    asks = counted.where(f"kind = {2 * order - 1} AND length(b) > 0").select("block", "b").mapInArrow(spread, ROW_SCHEMA)
    return _answered(asks, weights, answer, label)


# ---- fitting and scoring -----------------------------------------------------------------------

def _walk(blocks: DataFrame, order: int, model: Model | None = None) -> tuple[Model, list[DataFrame]]:
    """The answers for all blocks, order by order: from the tables of a model or, without one, from those that are made of the blocks' training texts."""
    learn = model is None
    if learn:
        size = blocks.agg(F.sum(F.length("words") / 8), F.count("*"), F.sum("n_train")).first()
        n_words = max(1, int((size[0] or 0) // GROUP))
        known = [word_answers(blocks, n_words, None)]
        table = known[0].where(f"kind = {TABLE}")
        v, n, *of = _totals(table)
        model = Model(order, Unigrams.fitted(v, n, of), size[2] or 0, n_words, max(1, max((size[1] or 0) * BLOCK, n) // GROUP), max(1, GROUP // 8), table)
    else:
        known = [word_answers(blocks, model.n_words, model.words)]
    for o in range(2, order + 1):
        asks, label = ask_grams(blocks, known, model.numbers(o)), "katz-pairs" if o == 2 else f"katz-{o}-grams"
        counted = gram_answers(asks, o, model.uni, None if learn else model.grams[o], label)
        if learn:
            model.grams[o] = counted.where(f"kind = {TABLE}")
            model.discounts[o] = Discount.fitted(_totals(model.grams[o])[2:])
            model.weights[o] = context_weights(model.grams[o], model.discounts[o], model.n_groups, f"katz-weights-{o}")
        known += [counted, weight_answers(counted, o, model.weights[o], model.n_groups, f"katz-backoff-{o}")]
    return model, known


def _finished(blocks: DataFrame, known: list[DataFrame], model: Model, key: str) -> DataFrame:
    def finish(head, b):
        uni, keys, empty = b.x.uni, np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.uint8)
        base = np.log10((b.known + 0.1) / (uni.tokens + 0.1 * (uni.words + 1)))
        ids = pa.compute.if_else(pa.array(empty == 0), pa.array(keys), pa.scalar(None, pa.int64()))
        return pa.table([ids, pa.array(b.held == 1), pa.array(b.sizes), pa.array(np.add.reduceat((b.known > 0)[b.tokens], b.first, dtype=np.int64)),
                         pa.array(np.full(len(keys), uni.tokens)), pa.array(np.add.reduceat(base[b.tokens], b.first)), pa.array(np.add.reduceat(b.log10[b.pair], b.first))],
                        ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = _gathered(blocks, known, HEAD, model.numbers(model.order + 1), finish,
                    "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> Model:
    """A model of the texts that are not held out."""
    return _walk(blocks_of(docs, key, text), _checked(order))[0]


def score_with(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `scores` for any texts, by a model that was fitted before; held_out goes by their own keys."""
    blocks = blocks_of(docs, key, text)
    return _finished(blocks, _walk(blocks, model.order, model)[1], model, key)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; score is the model's log10 probability of the text.

    A null text counts as empty and has its end token alone. Repeated rows are counted and scored as often as they occur. With nothing to learn
    from, the unknown class has all probability. An empty table gives an empty table.
    """
    blocks = blocks_of(docs, key, text)
    model, known = _walk(blocks, _checked(order))
    return _finished(blocks, known, model, key)


def _checked(order: int) -> int:
    if order < 1:
        raise ValueError("the order is 1 or more")
    return order
