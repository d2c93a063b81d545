"""Repeated substrings by merging Burrows-Wheeler transforms of shards.

Texts are cut into overlapping strings by content: each window of `length` bytes
belongs to the anchor, a shorter gram of it, whose hash is least, and neighbouring
windows with one anchor make one string. Equal windows have equal anchors, so a
string needs to meet only strings with its own anchor, and an anchor that occurs
once needs to meet none. Strings are dealt out by their anchor's hash.

Where strings meet, they form shards. The Burrows-Wheeler transform of each shard
is built over an alphabet of blocks of `length` / ROUNDS bytes. The transforms are
merged by refining their interleave: each round deals the suffixes out by the
symbol before them, in the order of the round before, after which the interleave
is right to one symbol more. No suffix is compared with another. Neighbours in the
interleave then have their common prefix read off, and a run of common prefixes
of `length` bytes is a repeated interval.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import mix, span_hashes, text_blocks, written
from foldwise.llm.partenum import binary, pack_by_group

LENGTH, ANCHOR, ROUNDS = 200, 64, 5
#: Window starts handled at once; bits of a position; bytes of a shard; anchors and string bytes in a group.
SEGMENT, BITS, SHARD, ANCHORS, BYTES = 1 << 20, 22, 1 << 20, 1 << 20, 6 << 20


# ---- strings of a block of texts -------------------------------------------------------

def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[p:p + w] for each p that has w values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchored_strings(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(hash of the anchor, its position, first window start, last window start, row) of every string. Windows never cross rows."""
    out = []
    if not 2 <= anchor < length or length + SEGMENT >= 1 << BITS:
        raise ValueError("the anchor must be shorter than the length, and the length must fit a segment")
    stop = np.repeat(bounds[1:], np.diff(bounds))
    for first in range(0, len(data) - length + 1, SEGMENT):
        n = min(SEGMENT, len(data) - length + 1 - first)
        part = data[first:first + n + length - 1]
        g = np.arange(len(part) - anchor + 1)
        h = span_hashes(part, g, g + anchor)
        low = np.uint64((1 << BITS) - 1)
        at = (sliding_least((h & ~low) | g.astype(np.uint64), length - anchor + 1) & low).astype(np.int64)
        p = np.flatnonzero(np.arange(first, first + n) + length <= stop[first:first + n])
        if not len(p):
            continue
        a = at[p]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        last = np.r_[new[1:], len(p)] - 1
        out.append((h[a[new]], a[new] + first, p[new] + first, p[last] + first))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    h, a, lo, hi = (np.concatenate(x) for x in zip(*out))
    return h, a, lo, hi, np.searchsorted(bounds, lo, "right") - 1


# ---- transforms --------------------------------------------------------------------------

def stable_order(names: np.ndarray) -> np.ndarray:
    """Stable order of non-negative names, 16 bits at a time."""
    order = np.argsort((names & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(names) and int(names.max()) >> shift:
        order = order[np.argsort(((names[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each different value comes first, number of each value), in order of appearance."""
    to, kinds = pd.factorize(values)
    first = np.empty(len(kinds), np.int64)
    first[to[::-1]] = np.arange(len(values) - 1, -1, -1)
    return first, to


class Strings:
    """Strings end to end, each with one position more than bytes for its end."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS):
        if length % rounds:
            raise ValueError("the length must be a multiple of the rounds")
        self.step, self.rounds = length // rounds, rounds
        n = int(sizes.sum() + len(sizes))
        start = np.cumsum(np.r_[0, sizes + 1])[:-1]
        self.offset = np.arange(n) - np.repeat(start, sizes + 1)
        self.left = np.repeat(sizes, sizes + 1) - self.offset  # bytes from here to the string's end
        flat = np.zeros(n + 8, np.uint8)
        flat[:n][self.left > 0] = data
        self.names = self._names(flat, n)

    def _names(self, flat: np.ndarray, n: int) -> np.ndarray:
        """A number for each block of `step` bytes, equal for equal blocks; -1 where a string has less left, and for blocks found once, which nothing shares."""
        names = np.full(n, -1, np.int64)
        whole = np.flatnonzero(self.left >= self.step)
        if not len(whole):
            return names
        first, to = numbered(span_hashes(flat[:n], whole, whole + self.step))
        words = np.lib.stride_tricks.sliding_window_view(flat, 8)
        for k in (*range(0, self.step - 7, 8), max(0, self.step - 8)) if self.step >= 8 else range(self.step):
            own = words[whole + k] if self.step >= 8 else flat[whole + k]
            own = np.ascontiguousarray(own).view(np.uint64).ravel() if self.step >= 8 else own
            if (own != own[first[to]]).any():
                raise ArithmeticError("two blocks have one hash")
        often = np.bincount(to) > 1
        names[whole] = np.where(often, np.cumsum(often) - 1, -1)[to]
        return names

    def refine(self, order: np.ndarray) -> np.ndarray:
        """From an order by h symbols to one by h + 1: the suffixes that start a symbol earlier, dealt out by that symbol, behind those without a shared one."""
        before = order[self.offset[order] >= self.step] - self.step
        name = self.names[before]
        shared = name >= 0
        before, name = before[shared], name[shared]
        return np.concatenate([order[self.names[order] < 0], before[stable_order(name)]])

    def shard(self, first: int, last: int) -> np.ndarray:
        """Positions first <= p < last of whole strings in suffix order, to `rounds` symbols. The names before them are the shard's transform."""
        order = np.arange(first, last)
        for _ in range(self.rounds):
            order = self.refine(order)
        return order

    def merge(self, shards: list[np.ndarray]) -> np.ndarray:
        """The interleave of the shards' suffixes, refined until it is right to `rounds` symbols or does not change."""
        order = np.concatenate(shards)
        for _ in range(self.rounds if len(shards) > 1 else 0):
            now = self.refine(order)
            if np.array_equal(now, order):
                break
            order = now
        return order

    def common(self, order: np.ndarray) -> np.ndarray:
        """For each suffix but the first, how many symbols it has in common with the one before, `rounds` at most."""
        lcp, same = np.zeros(len(order) - 1, np.int64), np.ones(len(order) - 1, bool)
        for k in range(self.rounds):
            p = np.minimum(order + k * self.step, len(self.names) - 1)
            name = np.where(self.left[order] >= (k + 1) * self.step, self.names[p], -1)
            same &= (name[1:] == name[:-1]) & (name[1:] >= 0)
            lcp += same
        return lcp


def repeated_starts(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS, shard: int = SHARD) -> np.ndarray:
    """For each position of the strings and their ends, whether the `length` bytes from there are also found from another position."""
    s = Strings(data, sizes, length, rounds)
    if not len(sizes):
        return np.zeros(0, bool)
    ends = np.cumsum(sizes + 1)
    cuts = [0]
    while cuts[-1] < ends[-1]:
        cuts.append(int(ends[max(np.searchsorted(ends, cuts[-1] + shard, "right") - 1, np.searchsorted(ends, cuts[-1], "right"))]))
    order = s.merge([s.shard(a, b) for a, b in zip(cuts, cuts[1:])])
    equal = s.common(order) >= rounds
    out = np.zeros(len(s.names), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


# ---- steps ---------------------------------------------------------------------------------

def _runs(flags: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several stretches of flags, the runs of true ones: stretch, first and last position in it."""
    where = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(where)) - np.repeat(np.cumsum(np.r_[0, n])[:-1], n)
    on = flags[np.repeat(start, n) + place]
    where, place = where[on], place[on]
    new = np.r_[True, (where[1:] != where[:-1]) | (place[1:] != place[:-1] + 1)] if len(where) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(where)].astype(np.int64) - 1
    return where[first], place[first], place[last]


def shared_anchors(texts: DataFrame, n_groups: int, length: int, anchor: int) -> DataFrame:
    """(key, at): positions of the anchors of texts (key, t) that occur elsewhere too. An anchor is 32 bits beside its group, so some that do not are among them."""
    def spread(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), "V16")
            for first, data, bounds in text_blocks(batch.column(1), 1 << 22):
                h, at, _, _, row = anchored_strings(data, bounds, length, anchor)
                own, at, rows = keys[first:first + len(bounds) - 1], at - bounds[row], []
                for g, k, x in pack_by_group(np.arange(len(h)), h, n_groups):
                    low = (x // np.uint64(n_groups)).astype(np.uint32)
                    u, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
                    many = count[inverse] > 1
                    who, local = np.unique(row[k], return_inverse=True)
                    rows.append((g, own[who].tobytes(), local.astype(np.int32).tobytes(), at[k].astype(np.int64).tobytes(), many.tobytes(), low.tobytes(), u[count > 1].tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                     ["g", "keys", "owner", "at", "done", "low", "many"])

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c: [x.as_py() for x in table.column(c)]
        keys = [np.frombuffer(x, "V16") for x in get("keys")]
        base = np.cumsum([0, *map(len, keys)])
        ids, to = np.unique(np.concatenate(keys), return_inverse=True)
        owner = to[np.concatenate([np.frombuffer(x, np.int32) + b for x, b in zip(get("owner"), base)]).astype(np.int64)]
        at = np.concatenate([np.frombuffer(x, np.int64) for x in get("at")])
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in get("low")])
        many = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in get("many")]))
        _, inverse, n = np.unique(low, return_inverse=True, return_counts=True)
        hit = (n[inverse] > 1) | np.concatenate([np.frombuffer(x, bool) for x in get("done")]) | np.isin(low, many)
        owner, at = owner[hit], at[hit]
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        who, first = np.unique(owner, return_index=True)
        return pa.table([binary(ids[who]), pa.array([x.tobytes() for x in np.split(at, first[1:])] if len(who) else [], pa.binary()),
                         pa.array(np.diff(np.r_[first, len(at)]), pa.int64())], ["key", "at", "n"])

    packed = texts.select("key", "t").mapInArrow(spread, "g long, keys binary, owner binary, at binary, done binary, low binary, many binary")
    return packed.groupBy("g").applyInArrow(meet, "key binary, at binary, n long")


def strings_of(rows: DataFrame, n_groups: int, length: int, anchor: int) -> DataFrame:
    """Strings at the positions `at` (a list of packed ones) of texts (key, t, copies), packed by group of their anchors.

    Equal strings of a block are sent once, with all their owners. A text that comes again in the task is not read again.
    """
    def spread(batches):
        seen: set[bytes] = set()
        for batch in batches:
            new = [k for k, x in enumerate(batch.column(0)) if not ((b := x.as_py()) in seen or seen.add(b))]
            batch = batch.take(pa.array(new, pa.int64()))
            for first, data, bounds in text_blocks(batch.column(1), 1 << 22):
                n = len(bounds) - 1
                keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(0).slice(first, n)), "V16")
                copies = batch.column(2).slice(first, n).to_numpy(zero_copy_only=False)
                wanted = [np.frombuffer(b"".join(x), np.int64) + b for x, b in zip(batch.column(3).slice(first, n).to_pylist(), bounds)]
                h, at, lo, hi, row = anchored_strings(data, bounds, length, anchor)
                pick = np.flatnonzero(np.isin(at, np.concatenate([*wanted, np.zeros(0, np.int64)])))
                h, lo, hi, row = h[pick], lo[pick], hi[pick], row[pick]
                same = span_hashes(data, lo, hi + length)
                rows = []
                for g, k, _ in pack_by_group(np.arange(len(h)), h, n_groups):
                    _, one, string = np.unique(same[k], return_index=True, return_inverse=True)
                    one = k[one]
                    who, local = np.unique(row[k], return_inverse=True)
                    many = np.maximum(np.bincount(string), np.where(np.bincount(string, copies[row[k]] > 1) > 0, 2, 1))
                    rows.append((g, b"".join(data[lo[i]:hi[i] + length].tobytes() for i in one), (hi[one] + length - lo[one]).astype(np.int64).tobytes(),
                                 same[one].tobytes(), np.minimum(many, 2).astype(np.int8).tobytes(), keys[who].tobytes(), local.astype(np.int32).tobytes(),
                                 string.astype(np.int32).tobytes(), (lo[k] - bounds[row[k]]).astype(np.int64).tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                     ["g", "data", "sizes", "same", "many", "keys", "owner", "string", "lo"])

    return rows.select("key", "t", "copies", "at").mapInArrow(
        spread, "g long, data binary, sizes binary, same binary, many binary, keys binary, owner binary, string binary, lo binary")


def repeated_spans(packed: DataFrame, length: int) -> DataFrame:
    """(key, spans): packed pairs of the first byte and the end of repeated runs, from strings that meet by group."""
    def meet(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x.as_py(), t) for x in table.column(c)]
        sizes, same = get("sizes", np.int64), get("same", np.uint64)
        string_base, key_base = np.cumsum([0, *map(len, sizes)]), np.cumsum([0, *map(len, get("keys", "V16"))])
        data, flat = np.concatenate(get("data", np.uint8)), np.concatenate(sizes)
        begin = np.cumsum(np.r_[0, flat])[:-1]
        # Equal strings of different blocks become one; equality is by a 64-bit hash and the size, then by the bytes.
        one, to = numbered(np.concatenate(same) + flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in np.flatnonzero(one[to] != np.arange(len(to))):
            a, b, n = begin[k], begin[one[to[k]]], flat[k]
            if n != flat[one[to[k]]] or not np.array_equal(data[a:a + n], data[b:b + n]):
                raise ArithmeticError("two strings have one hash")
        many = np.bincount(to, np.concatenate(get("many", np.int8)).astype(np.int64)).astype(np.int64)
        own = flat[one]
        joined = np.concatenate([data[begin[k]:begin[k] + flat[k]] for k in one])
        flags = repeated_starts(joined, own, length)
        at = np.cumsum(np.r_[0, own + 1])[:-1]
        flags |= np.repeat(many > 1, own + 1)
        string, first, last = _runs(flags, at, own - length + 1)
        owners = np.concatenate([x + b for x, b in zip(get("owner", np.int32), key_base)]).astype(np.int64)
        strings = to[np.concatenate([x + b for x, b in zip(get("string", np.int32), string_base)]).astype(np.int64)]
        lo = np.concatenate(get("lo", np.int64))
        # Each owner of a string gets the string's runs.
        from_, count = np.searchsorted(string, strings), np.bincount(string, minlength=len(own))[strings]
        run = np.repeat(from_, count) + np.arange(count.sum()) - np.repeat(np.cumsum(np.r_[0, count])[:-1], count)
        owner, base = np.repeat(owners, count), np.repeat(lo, count)
        keys, to_key = np.unique(np.concatenate(get("keys", "V16")), return_inverse=True)
        owner, spans = to_key[owner], np.stack([base + first[run], base + last[run] + length], axis=1)
        order = np.lexsort((spans[:, 0], owner))
        owner, spans = owner[order], spans[order]
        who, cut = np.unique(owner, return_index=True)
        parts = np.split(spans, cut[1:]) if len(who) else []
        return pa.table([binary(keys[who]), pa.array([join_spans(x).tobytes() for x in parts], pa.binary())], ["key", "spans"])

    return packed.groupBy("g").applyInArrow(meet, "key binary, spans binary")


def join_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, maximal spans; those that overlap or touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    end = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > end[:-1]]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], end[np.r_[first[1:], len(spans)] - 1]], axis=1)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs as struct `row`, with `data` (its text as bytes) and `spans` (packed first byte and end of each maximal run of bytes in a repeated window).

    A window is repeated if its bytes also start anywhere else in any row, the same one included; repeated rows thus repeat each other. Texts shorter
    than the window, empty and null ones (which count as empty) have no spans. An empty table gives an empty table. Columns of docs can have any name.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = rows.select(F.unhex(F.md5("t")).alias("key"), "t", "row")
    texts = rows.select("key", "t").where(F.octet_length("t") >= length)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    anchors = written(shared_anchors(texts, max(1, 2 * size // (length - anchor + 2) // ANCHORS), length, anchor), "bwt-anchors")
    n = anchors.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, n * (length + (length - anchor) // 2) // BYTES)
    wanted = anchors.groupBy("key").agg(F.collect_list("at").alias("at"))
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))
    found = texts.join(wanted.join(copies, "key"), "key")
    spans = written(repeated_spans(strings_of(found, n_groups, length, anchor), length), "bwt-spans")
    by_text = spans.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    return rows.join(by_text, "key", "left").select("row", F.encode("t", "UTF-8").alias("data"), "spans")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256, the digest of the bytes outside all spans."""
    def run(batches):
        for batch in batches:
            rows = []
            for data, packed in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = memoryview(data.as_buffer())
                spans = join_spans(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed])) if packed else np.zeros((0, 2), np.int64)
                kept, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))],
                                             ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = remove_repeats(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")), "t").select("row.key", "data", "spans")
    return found.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)
