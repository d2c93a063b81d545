"""Similarity join of word-shingle sets by PartEnum signatures.

Sets of sizes that can be similar share a size level. At a level, similar sets
differ in at most k elements. The domain is dealt into n1 parts of three cells
each; some part then holds at most one difference, so two of its three cells are
equal in both sets. A set's signatures are its elements in each pair of cells of
each part. Similar sets share one, and shared signatures are then verified on
the sets themselves.

Three things keep the join linear: equal sets are one class; a class most of
whose shingles occur in no other class can have no partner and makes no
signatures; and in a bucket of classes with one signature only the class that
shares most is compared with the others, until the components that this gives
leave a bucket with more than one component. The last is for grouping alone:
similar_pairs() compares all members of every bucket and gives all links.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import FILTER_BITS, SPACES, hash_filter, hashed_words, mix, passes, small_batches, text_blocks, written
from foldwise.llm.components import components
from foldwise.operators.lookup import estimated_bytes

WORDS, SIMILAR = 5, Fraction(3, 4)
#: Cells of a part, cells that a signature leaves out, parts for each part that is needed, entries in a group of packed hashes.
CELLS, LEFT_OUT, SLACK, GROUP = 3, 1, Fraction(3, 2), 1 << 20
#: Bytes of texts that are hashed at once; a Python worker holds many times that.
BLOCK_BYTES = 1 << 20
#: Bits of a sketch; bytes up to which a table is sent to all tasks.
SKETCH, SENT_BYTES = 2048, 32 << 20


# ---- sets of a block of texts --------------------------------------------------------

def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted in each, and their bounds. A text with fewer words has one shingle of all of them; without words, none."""
    h, row = hashed_words(data, bounds)
    n = len(bounds) - 1
    with np.errstate(over="ignore"):
        mult = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) | 1) for j in range(words)]
        m = len(h) - words + 1
        if m > 0:
            s = np.zeros(m, np.uint64)
            for j in range(words):
                s += h[j:j + m] * mult[j]
            whole = row[:m] == row[words - 1:]
            s, at = mix(s)[whole], row[:m][whole]
        else:
            s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        count = np.bincount(row, minlength=n)[:n]
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            first = np.searchsorted(row, short)
            size = count[short]
            extra = size.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
            for j in range(words - 1):
                extra[size > j] += h[first[size > j] + j] * mult[j]
            extra = mix(extra)
            to = np.searchsorted(at, short)
            s, at = np.insert(s, to, extra), np.insert(at, to, short)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(s)]):
        s[i:j].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    s, at = s[new], at[new]
    return s, np.searchsorted(at, np.arange(n + 1))


def class_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each set, equal for equal sets: two sums of differently mixed elements."""
    with np.errstate(over="ignore"):
        total = np.zeros((2, len(s) + 1), np.uint64)
        np.cumsum(mix(s ^ np.uint64(0x1234567)), out=total[0, 1:])
        np.cumsum(mix(s + np.uint64(0x9E3779B9)), out=total[1, 1:])
        out = total[:, at[1:]] - total[:, at[:-1]]
    return np.ascontiguousarray(out.T).view("V16").ravel()


def binary(values: np.ndarray) -> pa.Array:
    """Fixed-width values as binary."""
    w = values.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


# ---- levels ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Level:
    """Sizes lo <= size < end; the most differences of similar sets; parts; empty parts from which a set needs its prefix too."""
    lo: int
    end: int
    differences: int
    parts: int
    blind: int


def levels(most: int, similar: Fraction = SIMILAR) -> list[Level]:
    """The levels of sizes up to `most`. A set is in one or two of them; of similar sets, the level of the smaller one's first two thirds has both."""
    out, j, g = [], 0, 1 / similar
    while g ** (2 * j) <= most:
        lo, small, end = ceil(g ** (2 * j)), ceil(g ** (2 * j + 2)), ceil(g ** (2 * j + 3))
        k = floor((small - 1 + end - 1) * (1 - similar) / (1 + similar))
        if k and lo < end:
            parts = ceil(SLACK * (k + 1) / (LEFT_OUT + 1))
            out.append(Level(lo, end, k, parts, parts - k // (LEFT_OUT + 1)))
        j += 1
    return out


def signatures(s: np.ndarray, similar: Fraction = SIMILAR) -> np.ndarray:
    """Signatures of one set of hashes.

    Pairs of cells that are both empty make none. Where so many parts have such a pair that equal ones might all be empty, the set's prefix in
    hash order is added: two similar sets that share empty pairs alone both have it.
    """
    out = []
    with np.errstate(over="ignore"):
        for number, level in enumerate(levels(len(s), similar)):
            if not level.lo <= len(s) < level.end:
                continue
            seed = np.uint64(number * 2 + 1) * np.uint64(0xA0761D6478BD642F)
            part = (mix(s ^ seed) % np.uint64(level.parts * CELLS)).astype(np.int64)
            own = mix(s + seed)
            cell = np.zeros(level.parts * CELLS, np.uint64)
            np.add.at(cell, part, own)
            filled = np.bincount(part, minlength=level.parts * CELLS).reshape(-1, CELLS)
            cell = cell.reshape(-1, CELLS)
            blind = np.zeros(level.parts, bool)
            for left in range(CELLS):
                i, j = (left + 1) % CELLS, (left + 2) % CELLS
                some = (filled[:, i] + filled[:, j]) > 0
                blind |= ~some
                where = np.arange(level.parts, dtype=np.uint64) * np.uint64(CELLS) + np.uint64(left)
                out.append(mix(mix(cell[:, i] + np.uint64(3) * seed) * np.uint64(5) + mix(cell[:, j] ^ seed) + mix(where + seed))[some])
            if blind.sum() >= level.blind:
                out.append(mix(np.sort(s)[:len(s) - ceil(similar * len(s)) + 1] ^ (seed * np.uint64(7))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether the number of elements is odd, for each range of hashes. Two sketches differ in at most as many bits as the sets have different elements."""
    return np.packbits(np.bincount((s >> np.uint64(53)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """The same over SKETCH bits or more, a power of two from four times the elements, as longs. Equal places of its parts of SKETCH bits, or of any
    larger width, add up to a sketch of that width."""
    width = max(SKETCH, 1 << max(0, 4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def bits_apart(a: str, b: str) -> str:
    """SQL: in how many bits two wide sketches differ, the wider one folded."""
    fold = "transform(slice({x}, 1, size({y})), (v, i) -> aggregate(sequence(i, size({x}) - 1, size({y})), 0L, (s, j) -> s ^ get({x}, j)))"
    narrow = lambda x, y: f"if(size({x}) > size({y}), {fold.format(x=x, y=y)}, {x})"
    return f"aggregate(zip_with({narrow(a, b)}, {narrow(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"


# ---- steps -------------------------------------------------------------------------------

def classes_of(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, th (hash of the text), n_shingles and the set's class of every row; rows without words have no class."""
    def run(batches):
        for batch in batches:
            for first, data, bounds in text_blocks(batch.column(2), BLOCK_BYTES):
                s, at = shingle_sets(data, bounds, words)
                n = np.diff(at)
                ids = binary(class_ids(s, at))
                ids = pa.compute.if_else(pa.array(n > 0), ids, pa.scalar(None, pa.binary()))
                out = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(n, pa.int64()), ids], ["key", "th", "n", "class"])

    picked = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return picked.mapInArrow(run, "key long, th long, n long, class binary")


def pack_by_group(owner: np.ndarray, hashes: np.ndarray, n_groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, owners, hashes) of each group of hashes. What is left of a hash after its group is all that need be kept."""
    group = (hashes % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, owner, hashes = group[order], owner[order], hashes[order]
    cut = np.flatnonzero(np.diff(group)) + 1
    for g, o, h in zip(group[np.r_[0, cut]] if len(group) else [], np.split(owner, cut), np.split(hashes, cut)):
        yield int(g), o, h


def steps(who: np.ndarray) -> bytes:
    """Increasing numbers as their steps, in one byte each if all fit."""
    d = np.diff(who, prepend=0)
    return d.astype(np.uint8 if not len(d) or d.max() < 256 else np.uint32).tobytes()


def from_steps(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32), dtype=np.int64)


def sent_shingles(docs: DataFrame, text: str, words: int, n_groups: int) -> DataFrame:
    """(g, block, classes, who, low, tag, many): the shingles of each block of texts by group, and under -1 - block its classes.

    A shingle is 32 bits beside its group, 32 bits that tell its class from others with the same shingle, and a step to its class in the block:
    about nine bytes, however many groups there are. A shingle in many classes of one block is sent once for all of them.
    """
    def spread(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, data, bounds in text_blocks(batch.column(0), BLOCK_BYTES):
                s, at = shingle_sets(data, bounds, words)
                ids, pick = np.unique(class_ids(s, at), return_index=True)
                some = np.diff(at)[pick] > 0
                ids, pick = ids[some], pick[some]
                if not len(pick):
                    continue
                block, number = part << 32 | number, number + 1
                owner = np.repeat(np.arange(len(pick)), np.diff(at)[pick])
                own = np.concatenate([s[at[k]:at[k + 1]] for k in pick])
                order = np.argsort(own)
                equal = own[order[1:]] == own[order[:-1]]
                many = np.zeros(len(own), bool)
                many[order[1:][equal]] = many[order[:-1][equal]] = True
                done = np.bincount(owner[many], minlength=len(ids)).astype(np.int32)
                rows = [(-1 - block, block, ids.tobytes(), done.tobytes(), b"", b"", b"")]  # the block's classes, for its answers
                more = {g: (h // np.uint64(n_groups)).astype(np.uint32) for g, _, h in pack_by_group(np.zeros(many.sum(), np.int8), own[many], n_groups)}
                with np.errstate(over="ignore"):
                    tag = mix(ids.view(np.uint64)[::2][owner] + own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
                alone = np.flatnonzero(~many)
                for g, o, h in pack_by_group(alone, own[alone], n_groups):
                    low = (h // np.uint64(n_groups)).astype(np.uint32)
                    rows.append((g, block, b"", steps(owner[o]), low.tobytes(), tag[o].astype(np.uint32).tobytes(), np.unique(more.pop(g, low[:0])).tobytes()))
                rows += [(g, block, b"", b"", b"", b"", np.unique(low).tobytes()) for g, low in more.items()]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                                                 ["g", "block", "classes", "who", "low", "tag", "many"])

    return docs.select(text).mapInArrow(spread, "g long, block long, classes binary, who binary, low binary, tag binary, many binary")


def shared_counts(docs: DataFrame, text: str, words: int, n_groups: int) -> DataFrame:
    """(class, shared): how many of a class's shingles occur in other classes too, or a little more.

    A shingle may rarely be taken for another one; that only keeps a class that could go. Two classes may rarely look alike in one shingle, so
    that it is missed; each count is therefore one more.
    """
    def count(table: pa.Table) -> pa.Table:
        """For each block that sent something: its classes, once for each shingle that another class has."""
        block = table["block"]
        if table["g"][0].as_py() < 0:
            return pa.table([block, table["classes"], table["who"]], ["block", "classes", "who"])
        get = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
        low = get("low", np.uint32)
        base = np.cumsum([0, *map(len, low)])
        high = np.concatenate([*low, *get("many", np.uint32)]).astype(np.uint64) << np.uint64(32)
        both = np.concatenate([high[:base[-1]] | np.concatenate(get("tag", np.uint32)), high[base[-1]:], high[base[-1]:] | np.uint64(0xFFFFFFFF)])
        order = np.argsort(both)
        both = both[order]
        start = np.flatnonzero(np.r_[True, both[1:] >> np.uint64(32) != both[:-1] >> np.uint64(32)])
        end = np.r_[start[1:], len(both)]
        shared = np.empty(len(both), bool)
        shared[order] = np.repeat(both[start] != both[end - 1], end - start)
        found = []
        for x, i, j in zip(table["who"], base, base[1:]):
            who = from_steps(x.as_py(), j - i)[shared[i:j]]
            found.append(len(who).to_bytes(8, "little") + steps(who))
        return pa.table([block, pa.array([b""] * len(block), pa.binary()), pa.array(found, pa.binary())], ["block", "classes", "who"])

    def answer(table: pa.Table) -> pa.Table:
        """The classes of one block with what its groups found."""
        ids, shared = np.zeros(0, "V16"), 0
        for classes, who in zip(table["classes"].to_pylist(), table["who"].to_pylist()):
            if classes:
                ids, shared = np.frombuffer(classes, "V16"), shared + np.frombuffer(who, np.int32).astype(np.int64)
        for classes, who in zip(table["classes"].to_pylist(), table["who"].to_pylist()):
            if not classes:
                shared = shared + np.bincount(from_steps(who[8:], int.from_bytes(who[:8], "little")), minlength=len(ids))
        return pa.table([binary(ids[shared > 0]), pa.array(shared[shared > 0] + 1)], ["class", "shared"])

    counted = sent_shingles(docs, text, words, n_groups).groupBy("g").applyInArrow(count, "block long, classes binary, who binary")
    return counted.groupBy("block").applyInArrow(answer, "class binary, shared long").groupBy("class").agg(F.max("shared").alias("shared"))


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(class, n, s): the sorted hashes of each wanted class, from the row with its key and text hash (`row`, a hash of both). A class can come more than once.

    Texts are not shuffled: a filter of bounded size lets those of wanted classes through. A few others come along; they cost work and change nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(wanted, "row"))

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(sent.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for _, data, bounds in text_blocks(batch.column(1), BLOCK_BYTES):
                s, at = shingle_sets(data, bounds, words)
                ids = class_ids(s, at)
                new = []
                for k, c in enumerate(ids):
                    if at[k + 1] > at[k] and (b := c.tobytes()) not in seen:
                        seen.add(b)
                        new.append(k)
                if new:
                    arrays = pa.array([s[at[k]:at[k + 1]].view(np.int64) for k in new], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([binary(ids[new]), pa.array(np.diff(at)[new], pa.int64()), arrays], ["class", "n", "s"])

    found = docs.select(F.xxhash64(F.col(key).cast("long"), F.xxhash64(text)).alias("row"), F.col(text).alias("t")).mapInArrow(run, "class binary, n long, s array<bigint>")
    full = wanted.count() > FILTER_BITS // 16  # the filter is exact enough until then
    return found.join(wanted.select("class").distinct(), "class", "left_semi") if full else found


def candidates(sets: DataFrame, n_groups: int, similar: Fraction = SIMILAR, roots: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Pairs (a, b) of classes that share a signature, and `fits`: whether their sizes allow them to be similar.

    Without roots: of each bucket, the class that shares most with the others, with each of them. With roots (node, root): all pairs of a bucket
    of these nodes whose roots differ and whose sizes and sketches allow it; the members are compared in blocks and only what passes is sent.
    With every: all pairs of a bucket whose sketches allow it, sent block by block.
    """
    def spread(batches):
        for batch in batches:
            ids = np.array([np.frombuffer(x.as_py(), "V16")[0] for x in batch.column(0)], "V16")
            root = np.array([np.frombuffer(x.as_py(), "V16")[0] for x in batch.column(2)], "V16") if by_root else None
            values, at = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).offsets.to_numpy()
            for first in range(0, len(ids), 1000):
                span = range(first, min(first + 1000, len(ids)))
                sigs = [signatures(values[at[k]:at[k + 1]], similar) for k in span]
                owner = np.repeat(np.arange(first, first + len(sigs)), [len(x) for x in sigs])
                drawn = {k: sketch(values[at[k]:at[k + 1]]).tobytes() for k in span} if second else {}
                rows = []
                for g, o, h in pack_by_group(owner, np.concatenate([*sigs, np.zeros(0, np.uint64)]), n_groups):
                    who, local = np.unique(o, return_inverse=True)
                    sizes = (at[who + 1] - at[who]).astype(np.int32)
                    sketches = b"".join([drawn[k] for k in who]) if second else b""
                    rows.append((g, ids[who].tobytes(), b"" if root is None else root[who].tobytes(), sizes.tobytes(), sketches, local.astype(np.int32).tobytes(), h.tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                     ["g", "classes", "roots", "sizes", "sketches", "owner", "sig"])

    by_root = roots is not None
    second = by_root or every
    p, q = similar.numerator, similar.denominator

    def possible(i, j, sizes, sketches):
        """Whether sizes, and sketches if there are any, allow i[k] and j[k] to be similar."""
        ok = np.minimum(sizes[i], sizes[j]) * q >= np.maximum(sizes[i], sizes[j]) * p
        for k in range(0, len(i) if second else 0, 20_000):
            x, y = i[k:k + 20_000], j[k:k + 20_000]
            apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
            ok[k:k + 20_000] &= apart * (q + p) <= (sizes[x] + sizes[y]) * (q - p)
        return ok

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c: [x.as_py() for x in table.column(c)]
        classes = [np.frombuffer(x, "V16") for x in get("classes")]
        base = np.cumsum([0, *map(len, classes)])
        ids, first, to = np.unique(np.concatenate(classes), return_index=True, return_inverse=True)
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in get("sizes")])[first].astype(np.int64)
        sketches = np.frombuffer(b"".join(get("sketches")), np.uint64).reshape(-1, SKETCH // 64)[first] if second else None
        owner = to[np.concatenate([np.frombuffer(x, np.int32) + b for x, b in zip(get("owner"), base)]).astype(np.int64)]
        sig = np.concatenate([np.frombuffer(x, np.uint64) for x in get("sig")])
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
        sig, owner = sig[new], owner[new]
        bucket, size = np.unique(sig, return_inverse=True, return_counts=True)[1:]
        sig, owner = bucket[size[bucket] > 1], owner[size[bucket] > 1]
        if every:
            return ids, sizes, sketches, sig, owner
        order = np.lexsort((owner, -np.bincount(owner, minlength=len(ids))[owner], sig))
        sig, owner = sig[order], owner[order]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        end = np.r_[start[1:], len(sig)].astype(np.int64)
        if not second:
            i, j = np.repeat(owner[start], end - start), owner
            pairs = np.unique((i * len(ids) + j)[i != j])
            i, j = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            fits = possible(i, j, sizes, sketches)
        else:
            root = np.unique(np.concatenate([np.frombuffer(x, "V16") for x in get("roots")]), return_inverse=True)[1][first]
            mixed = np.flatnonzero(np.minimum.reduceat(root[owner], start) != np.maximum.reduceat(root[owner], start)) if len(start) else []
            done, found = set(), set()
            for b in mixed:
                who = owner[start[b]:end[b]]
                if (seen := who.tobytes()) in done:
                    continue
                done.add(seen)
                for k in range(0, len(who), 256):
                    x, y = (z.ravel() for z in np.meshgrid(who[k:k + 256], who[k:], indexing="ij"))
                    cross = root[x] != root[y]
                    x, y = x[cross], y[cross]
                    ok = possible(x, y, sizes, sketches)
                    found.update(np.unique(np.minimum(x, y)[ok] * len(ids) + np.maximum(x, y)[ok]).tolist())
            pairs = np.array(sorted(found), np.int64)
            i, j = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            fits = np.ones(len(i), bool)
        return pa.table([binary(ids[i]), binary(ids[j]), pa.array(fits)], ["a", "b", "fits"])

    def meet_every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, sketches, sig, owner = meet(pa.Table.from_batches(list(batches)))
        done = set()
        for who in np.split(owner, np.flatnonzero(np.diff(sig)) + 1):
            if (seen := who.tobytes()) in done:
                continue
            done.add(seen)
            for k in range(0, len(who), 256):
                x, y = (z.ravel() for z in np.meshgrid(who[k:k + 256], who[k:], indexing="ij"))
                x, y = x[x < y], y[x < y]
                ok = possible(x, y, sizes, sketches)
                yield pa.RecordBatch.from_arrays([binary(ids[x[ok]]), binary(ids[y[ok]]), pa.array(ok[ok])], ["a", "b", "fits"])

    rooted = sets.select("class", "s") if not by_root else sets.join(sent(roots), sets["class"] == roots["node"]).select("class", "s", "root")
    packed = rooted.mapInArrow(spread, "g long, classes binary, roots binary, sizes binary, sketches binary, owner binary, sig binary")
    return packed.groupBy("g").applyInArrow(meet_every if every else meet, "a binary, b binary, fits boolean").distinct()


def sent(table: DataFrame) -> DataFrame:
    """The table, marked to be sent to all tasks if its bytes are few."""
    return F.broadcast(table) if estimated_bytes(table) <= SENT_BYTES else table


def sketches(sets: DataFrame) -> DataFrame:
    """(class, n, k): the wide sketch of each set."""
    def run(batches):
        for batch in batches:
            values, at = batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).offsets.to_numpy()
            drawn = [wide_sketch(values[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.int64()))], ["class", "n", "k"])

    return sets.select("class", "n", "s").mapInArrow(run, "class binary, n long, k array<bigint>")


def likely_pairs(pairs: DataFrame, sets: DataFrame, similar: Fraction = SIMILAR) -> DataFrame:
    """(a, b, apart), written: the pairs whose sketches allow them to be similar, and in how many bits those differ."""
    p, q = similar.numerator, similar.denominator
    drawn = written(sketches(sets), "partenum-sketches")
    drawn = sent(drawn.dropDuplicates(["class"]))
    for c in "ba":
        pairs = pairs.join(drawn.toDF(c, f"n{c}", f"k{c}"), c)
    pairs = pairs.withColumn("apart", F.expr(bits_apart("ka", "kb")))
    return written(pairs.where(F.col("apart") * (q + p) <= (F.col("na") + F.col("nb")) * (q - p)).select("a", "b", "apart").distinct(), "partenum-likely")


def exact(pairs: DataFrame, sets: DataFrame, similar: Fraction = SIMILAR) -> DataFrame:
    """The pairs whose sets are similar. Where the pairs are few they go to the sets, and the set of b alone is sent to that of a."""
    p, q = similar.numerator, similar.denominator
    pairs = pairs.select("a", "b")
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    if estimated_bytes(pairs) <= SENT_BYTES:
        right = right.join(F.broadcast(pairs), "b")
        left = left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
        both = right.join(left, "a")
    else:
        both = pairs.join(right, "b").join(left, "a")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(f"{q} * i >= {p} * (na + nb - i)").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similar: Fraction = SIMILAR) -> DataFrame:
    """The pairs whose sets are similar: sketches go first, whole sets are sent for likely pairs only."""
    return exact(likely_pairs(pairs, sets, similar), sets, similar)


def spanning_links(pairs: DataFrame, sets: DataFrame, similar: Fraction = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(links, their components): of the pairs, enough similar ones for the components of all.

    Each b is first compared with the likeliest a alone; then the likely pairs are that still join two components.
    """
    likely = likely_pairs(pairs, sets, similar)
    best = written(likely.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select("m.a", "b"), "partenum-best")
    links = written(exact(best, sets, similar), "partenum-links")
    roots = components(links)
    rest = likely.select("a", "b").join(best, ["a", "b"], "left_anti")
    for c in "ab":
        rest = rest.join(sent(roots).toDF(c, f"r{c}"), c, "left")
    rest = written(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "partenum-open")
    if rest.isEmpty():
        return links, roots
    links = written(links.union(exact(rest, sets, similar)), "partenum-links")
    return links, components(links)


def open_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the classes that may share a bucket with one of another component. `pairs` has, for each bucket, all pairs of one of its classes, a."""
    for c in "ab":
        pairs = pairs.join(sent(roots).toDF(c, f"r{c}"), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    pairs = written(pairs.select("a", "b", "ra", "rb"), "partenum-rooted")
    apart = pairs.where("ra <> rb").select("a").distinct()
    of = pairs.join(sent(apart), "a", "left_semi")
    return of.select(F.col("a").alias("node"), F.col("ra").alias("root")).union(of.select("b", "rb")).distinct()


def _prepared(docs: DataFrame, key: str, text: str, words: int, similar: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows with their class; the classes; the sets of those that can have a partner; groups of signatures."""
    rows = written(classes_of(docs, key, text, words), "partenum-classes")
    classes = rows.where("n > 0").groupBy("class").agg(F.min(F.struct("key", "th")).alias("m"), F.min("key").alias("least"), F.max("n").alias("n"))
    classes = classes.select("class", F.xxhash64("m.key", "m.th").alias("row"), "least", "n")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(docs, text, words, max(1, total // GROUP))
    wanted = written(classes.join(shared, "class").where(f"{similar.denominator} * shared >= {similar.numerator} * n"), "partenum-wanted")
    sets = written(sets_of(docs, wanted, key, text, words), "partenum-sets")
    n_groups = max(1, (sets.agg(F.sum("n")).first()[0] or 0) // (2 * GROUP))
    return rows, classes, sets, n_groups


def _pairs(sets: DataFrame, n_groups: int, similar: Fraction) -> DataFrame:
    return written(verified(candidates(sets, n_groups, similar, every=True).select("a", "b"), sets, similar), "partenum-links")


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """(a, b, rows_a, rows_b): every pair a < b of similar classes, with their numbers of rows, so that it stands for rows_a * rows_b links.

    Classes of one row each give one link a pair; the rows of one class are linked with each other and make no pair here. The number of pairs can
    be the square of a group of near copies.
    """
    rows, _, sets, n_groups = _prepared(docs, key, text, words, similar)
    count = rows.where("n > 0").groupBy("class").agg(F.count("*").alias("rows"))
    pairs = _pairs(sets, n_groups, similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in "ab":
        pairs = pairs.join(count.select(F.col("class").alias(c), F.col("rows").alias(f"rows_{c}")), c)
    return pairs.select("a", "b", "rows_a", "rows_b")


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """(key, th, n_shingles, class, links) for every row of docs: with how many other rows it is similar. Rows without words have no links."""
    rows, _, sets, n_groups = _prepared(docs, key, text, words, similar)
    count = rows.where("n > 0").groupBy("class").agg(F.count("*").alias("rows"))
    pairs = _pairs(sets, n_groups, similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.union(pairs.select("b", "a")).toDF("class", "other")
    of = both.join(count.toDF("other", "more"), "other").groupBy("class").agg(F.sum("more").alias("more"))
    links = count.join(of, "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return rows.join(links, "class", "left").select("key", "th", F.col("n").alias("n_shingles"), "class", F.coalesce("links", F.lit(0)).alias("links"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """(key, th, n_shingles, component_id, class, root) for every row of docs.

    component_id is the least key that links lead to, the row's own included; th is xxhash64 of the text. Rows without words or text have no
    shingles and no links. Null keys are never the least; where a component has no other, component_id is null. Repeated rows are linked with each
    other. An empty table gives an empty table.
    """
    with small_batches(docs.sparkSession):
        rows, classes, sets, n_groups = _prepared(docs, key, text, words, similar)
        pairs = written(candidates(sets, n_groups, similar), "partenum-pairs")
        links, roots = spanning_links(pairs.where("fits"), sets, similar)
        left = written(open_classes(pairs, roots), "partenum-left")
        if not left.isEmpty():
            n_groups = max(1, (sets.join(sent(left), sets["class"] == left["node"]).agg(F.sum("n")).first()[0] or 0) // (2 * GROUP))
            more = candidates(sets, n_groups, similar, left).select("a", "b")
            more = written(more.join(pairs.select("a", "b").union(pairs.select("b", "a")), ["a", "b"], "left_anti"), "partenum-rest")
            if not more.isEmpty():
                roots = components(links.union(spanning_links(more, sets, similar)[0]))
    least = classes.join(roots, classes["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select("class", "root", "component_id")
    out = rows.where("n > 0").join(named, "class").select("key", "th", "n", "component_id", "class", "root")
    alone = rows.where("n = 0").select("key", "th", "n", F.col("key").alias("component_id"), "class", F.col("class").alias("root"))
    return out.union(alone).toDF("key", "th", "n_shingles", "component_id", "class", "root")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of similar_groups(): that with the least key (null keys last), then the least hash of its text.

    Of rows with the same key and text one stays. Rows without words are in no group and all stay. The columns are those of docs.
    """
    groups = similar_groups(docs, key, text, **options).where("root IS NOT NULL")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("f"))
    first = first.select(F.col("f.key").alias("first_k"), F.col("f.th").alias("first_th"))
    bare = F.trim(F.coalesce(docs[text], F.lit("")), F.lit(SPACES)) == ""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].cast("long").alias("k"), F.xxhash64(docs[text]).alias("th"), bare.alias("bare"))
    kept = rows.join(first, (F.col("th") == F.col("first_th")) & F.col("k").eqNullSafe(F.col("first_k")), "left").where("bare OR first_th IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("th", "k").orderBy("bare"))
    return kept.withColumn("place", place).where("bare OR place = 1").select("row.*")
