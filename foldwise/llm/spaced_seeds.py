"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: the words at its marked positions
are hashed, those at the others ignored. Seeds of benchmark items and of documents
are joined, and around every hit the document is laid beside the item on that
diagonal: some window of words must be equal but for a few substitutions. The two
masks together meet every window that passes.

Words are lower-cased (A-Z) and lose ASCII punctuation; they are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hashed_words, mix, text_blocks

#: With up to two words of WINDOW substituted, one of the masks still fits somewhere.
MASKS, WINDOW, SUBSTITUTED = ("11101011", "110100111"), 13, 2
#: Items shorter than a window count when they are found whole and exactly; still shorter ones than this say nothing.
LEAST_WORDS = 5
#: Words of benchmark items that are held, and sent to the tasks, at once.
BLOCK_WORDS = 2_000_000

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word without its punctuation; a word of punctuation alone is none."""
    keep = ~PUNCTUATION[data]
    at = np.r_[0, np.cumsum(keep)]
    return hashed_words(data[keep], at[bounds])


def seeds(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash and first word of each place where the whole mask lies in one row."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, len(mask) << 8 | MASKS.index(mask) if mask in MASKS else len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                total += h[j:j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) | 1)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1:])
    return mix(total[at]), at


@dataclass
class Index:
    """Seeds of one block of items. Seeds of short items are their whole text."""
    ids: np.ndarray
    words: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: list[str | None]) -> Index:
        words, masks, found = [], set(MASKS), []
        raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        for k, r in enumerate(raw):
            h, row = plain_words(r, np.array([0, len(r)]))
            words.append(h)
            own = MASKS if len(h) >= WINDOW else ("1" * len(h),) if len(h) >= LEAST_WORDS else ()
            masks.update(own)
            for m in own:
                s, at = seeds(h, row, m)
                found.append((s, np.full(len(s), k), at))
        hashes, item, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
        order = np.argsort(hashes, kind="stable")
        near = np.zeros(1 << 22, bool)
        near[hashes & np.uint64((1 << 22) - 1)] = True
        return Index(np.array(ids, object), words, sorted(masks), hashes[order], item[order], place[order], near)

    def hits(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) with a common seed."""
        out = []
        first = np.searchsorted(row, row)
        for m in self.masks:
            s, at = seeds(h, row, m)
            some = self.near[s & np.uint64((1 << 22) - 1)]
            s, at = s[some], at[some]
            lo, hi = np.searchsorted(self.hashes, s, "left"), np.searchsorted(self.hashes, s, "right")
            n = hi - lo
            at, to = np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(np.r_[0, n])[:-1], n)
            out.append(np.stack([row[at], self.item[to], at - first[at] - self.place[to]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def overlaps(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word in the row, words, equal words) of the best overlap of each row and item."""
        h, row = plain_words(data, bounds)
        start = np.searchsorted(row, np.arange(len(bounds)))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, k, d in self.hits(h, row).tolist():
            own, item = h[start[r]:start[r + 1]], self.words[k]
            a, b = max(0, d), min(len(own), d + len(item))
            w = min(WINDOW, len(item))
            if b - a < w:
                continue
            equal = np.cumsum(np.r_[0, own[a:b] == item[a - d:b - d]])
            ok = np.flatnonzero(equal[w:] - equal[:-w] >= w - (SUBSTITUTED if w == WINDOW else 0))
            if len(ok):
                lo, hi = int(ok[0]), int(ok[-1]) + w
                found = (int(equal[hi] - equal[lo]), -(a + lo), hi - lo)
                best[r, k] = max(best.get((r, k), (0, 0, 0)), found)
        for (r, k), (equal, at, n) in sorted(best.items()):
            yield r, k, -at, n, equal


def index_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark as indexes of a bounded number of words each, one at a time. The benchmark is the stated set of queries; no document goes this way."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).toLocalIterator():
        ids.append(r.k)
        texts.append(r.t)
        held += len(r.t or "") // 2 + 1
        if held >= block_words:
            yield Index.of(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Index.of(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal) for every row of docs that overlaps a benchmark item, from its best diagonal.

    A row overlaps an item if WINDOW neighbouring words of both are equal but for SUBSTITUTED at most, or if it has a shorter item of LEAST_WORDS
    words or more exactly. Start and extent are those of all such windows of the diagonal. Null texts, empty ones and shorter items overlap nothing;
    null keys stay null; repeated rows are reported as often as they occur; an empty table on either side gives an empty table. There is one scan of
    docs for each block of the benchmark and no shuffle.
    """
    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    schema = "doc_id long, item_id long, start_word long, n_words long, n_equal long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in index_blocks(benchmark, item_key, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                rows, keys = [], batch.column(0).to_pylist()
                for first, data, bounds in text_blocks(batch.column(1)):
                    rows += [(keys[first + r], sent.value.ids[k], at, n, equal) for r, k, at, n, equal in sent.value.overlaps(data, bounds)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        out = out.union(picked.mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                         block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that overlap no benchmark item, by the rule of contaminated(), with all their columns."""
    at = docs.columns.index(text)
    for index in index_blocks(benchmark, item_key, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, data, bounds in text_blocks(batch.column(at)):
                    for r, *_ in sent.value.overlaps(data, bounds):
                        clean[first + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
