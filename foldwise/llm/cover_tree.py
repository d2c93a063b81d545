"""Hard negatives by inner product, searched in cover trees.

Every candidate x gets one more coordinate, sqrt(M^2 - |x|^2), so that all lie on a
sphere of radius M; an anchor q gets a zero there and keeps its inner products.
Candidates are dealt into trees of bounded size by the nearest of a few pivots. In
a tree every node has a centre and the measured radius that covers all below it,
which as an angle on the sphere bounds the inner products of everything in the
node from both sides. The descent takes the nodes with the best bounds first, leaves out those
outside the window or below the best rows found so far, and computes the products
of the leaves that remain exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import written
from foldwise.llm.vectors import by_length, of_length, usual_length, whole

SCALE = 256
#: Rows of a tree, of a leaf, and children that a node gets at once; pivots that rows are dealt out by; anchors of one pass over the trees.
TREE, LEAF, CHILDREN, PIVOTS, ANCHORS = 4096, 48, 64, 64, 16_384
SHRINK = 0.6


# ---- one tree -------------------------------------------------------------------------

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by doubles where they are exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0 ** 53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def lifted(x: np.ndarray, norm2: int) -> np.ndarray:
    """x with the coordinate that puts it on the sphere."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(axis=1)))])


class CoverTree:
    """Nodes level by level: centre (a row), first child and number of children, the rows below as a run of `order`, and their covering radius."""

    def __init__(self, x: np.ndarray, norm2: int):
        self.x, self.norm2 = x, norm2
        y = lifted(x, norm2)
        self.order = np.arange(len(x))
        # [centre, first row, rows, radius, first child, children]
        nodes = [[0, 0, len(x), float(self._distance(y, y[:1]).max(initial=0.0)), 0, 0]]
        at = 0
        while at < len(nodes):
            centre, first, size, radius = nodes[at][:4]
            if size > LEAF and radius > 1e-9:
                rows = self.order[first:first + size]
                centres, owner, near = self._net(y, rows, centre, radius * SHRINK)
                by = np.argsort(owner, kind="stable")
                self.order[first:first + size] = rows[by]
                bounds = np.searchsorted(owner[by], np.arange(len(centres) + 1))
                nodes[at][4:] = len(nodes), len(centres)
                nodes += [[c, first + int(lo), int(hi - lo), float(near[by[lo:hi]].max()), 0, 0] for c, lo, hi in zip(centres, bounds, bounds[1:])]
            at += 1
        cols = list(zip(*nodes))
        self.centre, self.first, self.size, self.child, self.children = (np.array(cols[k], np.int64) for k in (0, 1, 2, 4, 5))
        # Chords with room for rounding, as angles on the sphere.
        chord = np.array(cols[3]) * (1 + 1e-9) + 1e-6
        self.angle = 2 * np.arcsin(np.minimum(1.0, chord / (2 * np.sqrt(max(norm2, 1)))))

    @staticmethod
    def _distance(y: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((y - c) ** 2).sum(axis=1)))

    def _net(self, y, rows, centre, reach):
        """Centres farther apart than `reach` until all rows are that close to one, or CHILDREN centres; the nearest for each row and its distance."""
        own, centres = y[rows], [centre]
        near, owner = self._distance(own, y[centre]), np.zeros(len(rows), np.int64)
        while near.max() > reach and len(centres) < CHILDREN:
            far = int(near.argmax())
            d = self._distance(own, own[far])
            closer = d < near
            near, owner = np.where(closer, d, near), np.where(closer, len(centres), owner)
            centres.append(int(rows[far]))
        left = np.unique(owner)  # a centre equal to an earlier one may be left without rows
        return [centres[k] for k in left], np.searchsorted(left, owner), near

    def bounds(self, q: np.ndarray, length: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product that any row below each node can have with each anchor."""
        full = length[:, None] * np.sqrt(max(self.norm2, 1))
        cos = q @ self.x[self.centre[nodes]].T.astype(np.float64) / np.maximum(full, 1e-300)
        turn = np.arccos(np.clip(cos, -1, 1))
        slack = 1 + 1e-9 * full
        return (full * np.cos(np.minimum(np.pi, turn + self.angle[nodes])) - slack, full * np.cos(np.maximum(0.0, turn - self.angle[nodes])) + slack)


class Best:
    """The best rows found so far for each query: score downwards, then key upwards."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.query, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self._new, self._pending = [], 0

    def add(self, query, score, key):
        self._new.append((query, score, key))
        self._pending += len(query)
        if self._pending > 50_000:
            self.settle()

    def settle(self):
        if self._new:
            q, s, k = (np.concatenate([a, *b]) for a, b in zip((self.query, self.score, self.key), zip(*self._new)))
            by = np.lexsort((k, -s, q))
            q, s, k = q[by], s[by], k[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == self.k - 1
            self.least[q[last]] = s[last]
            keep = place < self.k
            self.query, self.score, self.key = q[keep], s[keep], k[keep]
            self._new, self._pending = [], 0


def search(tree: CoverTree, keys: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, label: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray,
           same: bool, best: Best) -> int:
    """Add to `best` the tree's rows for all queries: query j asks for rows of the same (or another) label with low[j] <= product <= high[j] with anchor
    of[j]. Queries are in the order of their anchors. Returns the number of exact products, for tests."""
    length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    qf, n, exact = q.astype(np.float64), len(q), 0
    if not n or not len(of):
        return 0
    starts = np.searchsorted(of, np.arange(n + 1))
    has = starts[1:] > starts[:-1]

    def wanted(which):
        """The widest window of each anchor: greatest `high`, least bound that still helps."""
        floor = np.maximum(low, best.least)
        lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        at = starts[:-1][has]
        lo[has], hi[has] = np.minimum.reduceat(floor, at), np.maximum.reduceat(high, at)
        return lo[which], hi[which]

    frontier, leaves = np.array([0]), []
    alive = np.ones((n, 1), bool)
    while len(frontier):
        least, most = tree.bounds(qf, length, frontier)
        lo, hi = wanted(slice(None))
        alive &= (most >= lo[:, None]) & (least <= hi[:, None])
        some = alive.any(axis=0)
        leaf = tree.children[frontier] == 0
        for k in np.flatnonzero(some & leaf):
            leaves.append((frontier[k], np.flatnonzero(alive[:, k]), most[alive[:, k], k], least[alive[:, k], k]))
        go = np.flatnonzero(some & ~leaf)
        inner = frontier[go]
        frontier = np.concatenate([np.zeros(0, np.int64), *(np.arange(tree.child[i], tree.child[i] + tree.children[i]) for i in inner)])
        alive = alive[:, np.repeat(go, tree.children[inner])]
    # Best bounds first; what is found there spares later leaves.
    leaves.sort(key=lambda x: -float(x[2].max()))
    for done, (node, who, most, least) in enumerate(leaves):
        if done in (1, 4, 16) or done % 64 == 0:
            best.settle()
        lo, hi = wanted(who)
        who = who[(most >= lo) & (least <= hi)]
        if not len(who):
            continue
        rows = tree.order[tree.first[node]:tree.first[node] + tree.size[node]]
        score = products(q[who], tree.x[rows])
        exact += score.size
        count = starts[who + 1] - starts[who]
        row = np.repeat(np.arange(len(who)), count)
        j = np.repeat(starts[who], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        s = score[row]
        alike = label[who][row][:, None] == labels[rows][None]
        fit = (s >= np.maximum(low[j], best.least[j])[:, None]) & (s <= high[j][:, None]) & (alike if same else ~alike) & (keys[rows][None] != own[who][row][:, None])
        a, b = np.nonzero(fit)
        if len(a):
            best.add(j[a], s[a, b], keys[rows[b]])
    return exact


# ---- the tables -------------------------------------------------------------------------

def limit(d: int) -> int:
    """Entries beyond this are held here, so that products fit a long."""
    return 1 << (61 - max(0, d - 1).bit_length()) // 2


def candidates(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(written rows (id long, label, v binary, norm2), length of the vectors): those that take part; equal rows once."""
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))

    def lengths(batches):
        for batch in batches:
            got = by_length(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([len(r) for r, _ in got.values()], pa.int64())], ["d", "n"])

    d = usual_length(rows.select("v").mapInArrow(lengths, "d int, n long"))
    schema = f"id long, label {df.schema[label].dataType.simpleString()}, v binary, norm2 decimal(20,0)"

    def run(batches):
        for batch in batches:
            at, values = of_length(batch.column(2), d)
            x = whole(values, SCALE, limit(d))
            take = pa.array(at)
            raw = x.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array([raw[8 * d * k:8 * d * (k + 1)] for k in range(len(x))], pa.binary()),
                pa.array([int(n) for n in (x * x).sum(axis=1)], pa.decimal128(20, 0))], ["id", "label", "v", "norm2"])

    return written(rows.mapInArrow(run, schema).dropDuplicates(["id", "label", "v"]), "vectors"), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d).astype(np.int64)


def deal(rows: DataFrame, d: int, most: int, norm2: int) -> DataFrame:
    """(cell, part, id, label, v): rows with an equal vector and label beyond the first `most` go, since no anchor asks for more of them; the rest are dealt
    to the nearest of a few pivots, and a pivot's rows to parts of about TREE rows each."""
    w = Window.partitionBy("v", "label").orderBy("id")
    rows = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).select("id", "label", "v")
    pivots = np.frombuffer(b"".join(bytes(r.v) for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()), "<i8").reshape(-1, d)
    pivots = lifted(pivots.astype(np.int64), norm2)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), d)
            cell = (lifted(x, norm2) @ pivots.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int"
    placed = written(rows.mapInArrow(run, schema), "cells")
    parts = {r.cell: -(-r.n // TREE) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS rows
    n_parts = F.element_at(F.create_map([F.lit(x) for kv in parts.items() for x in kv]), F.col("cell")) if parts else F.lit(1)
    return placed.withColumn("part", F.pmod(F.xxhash64("id", "v"), n_parts).cast("int"))


def plant(placed: DataFrame) -> DataFrame:
    """One row for each (cell, part): its rows packed into arrays."""
    def pack(t):
        return pa.Table.from_arrays([pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), pa.array([t["label"].to_pylist()], pa.list_(t.schema.field("label").type)),
                                          pa.array([b"".join(t["v"].to_pylist())], pa.binary())], ["ids", "labels", "x"])

    kind = dict(placed.dtypes)["label"]
    return written(placed.groupBy("cell", "part").applyInArrow(pack, f"ids array<bigint>, labels array<{kind}>, x binary"), "trees")


def asked(trees: DataFrame, d: int, norm2: int, anchors: list, windows: list, k: int, same: bool) -> DataFrame:
    """One pass over the trees for a bounded block of anchors (id, label, v) and windows (place of the anchor, low, high), in that order.

    Returns (j, score, id): for every window j the best k rows of each task's trees.
    """
    q = np.frombuffer(b"".join(bytes(a.v) for a in anchors), "<i8").reshape(-1, d).astype(np.int64)
    own = np.array([a.id for a in anchors], np.int64)
    names = [a.label for a in anchors]
    of, low, high = (np.array([w[i] for w in windows], np.int64) for i in range(3))

    def run(batches):
        best, seen = Best(len(of), k), {}
        code = lambda xs: np.array([seen.setdefault(x, len(seen)) for x in xs], np.int64)
        label = code(names)
        for batch in batches:
            for ids, labels, x in zip(*(batch.column(c) for c in ("ids", "labels", "x"))):
                rows = np.frombuffer(x.as_py(), "<i8").reshape(-1, d).astype(np.int64)
                keys = ids.values.to_numpy()
                kinds = code(labels.as_py())
                tree = CoverTree(rows, norm2)
                for lo in range(0, len(q), 512):  # products of a level for so many anchors at once
                    hi = min(lo + 512, len(q))
                    a, b = np.searchsorted(of, [lo, hi])
                    part = Best(b - a, k)
                    part.least = best.least[a:b].copy()
                    search(tree, keys, kinds, q[lo:hi], own[lo:hi], label[lo:hi], of[a:b] - lo, low[a:b], high[a:b], same, part)
                    part.settle()
                    best.add(part.query + a, part.score, part.key)
                best.settle()
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.score), pa.array(best.key)], ["j", "score", "id"])

    return trees.mapInArrow(run, "j long, score long, id long")


def hard_negatives(df: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
                   least: int = 80, whole_score: int = 100, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, positive and negative.

    Anchors are the rows where the column `is_anchor` holds. A score is the inner product of floor(256 * component) of two rows; higher ones come first, ties by
    smaller key. Positives of an anchor are its first `positives` other rows of the same label; negatives of a positive the first `negatives` rows of other
    labels with least * positive_score <= whole_score * negative_score <= whole_score * positive_score.

    Rows with a null key, label or vector, an empty vector, a null or non-finite component, or a vector of another length than most (of equally frequent
    lengths the largest counts) take no part. Equal rows count once; a row with an anchor's own key is never its positive or negative. Components that would
    let products overflow a long are held at a bound (2 ** 27 after scaling for 64 of them). Other columns are not read. An empty table, or one
    without anchors or pairs, gives no rows.
    """
    spark = df.sparkSession
    flagged = df.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).select(key, vector, label, "__anchor")
    rows, d = candidates(flagged, key, vector, label)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not d:
        return spark.createDataFrame([], out)
    top = rows.agg(F.max("norm2")).first()[0]
    norm2 = int(top or 0)
    trees = plant(deal(rows, d, max(positives + 1, negatives), norm2))
    named = flagged.where("__anchor").select(F.col(key).cast("long").alias("id"), F.col(label).alias("label")).distinct()
    anchors = written(rows.select("id", "label", "v").join(named, ["id", "label"], "left_semi"), "anchors")
    # Anchors are dealt by the hash of their key into blocks of about `block`; one pass over the trees answers a block.
    n_blocks = -(-anchors.count() // block)
    found = []
    for b in range(n_blocks):
        own = sorted(anchors.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect(), key=lambda a: (a.id, str(a.label), bytes(a.v)))
        big = np.iinfo(np.int64).max // 2
        first = asked(trees, d, norm2, own, [(k, -big, big) for k in range(len(own))], positives, same=True)
        w = Window.partitionBy("j").orderBy(F.desc("score"), "id")
        first = written(first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives).select("j", "id", "score"), "positives")
        scores = sorted({(r.j, r.score) for r in first.select("j", "score").distinct().collect()})  # at most `positives` for each anchor of the block
        windows = [(j, -(-least * s // whole_score), s) for j, s in scores]
        second = asked(trees, d, norm2, own, windows, negatives, same=False)
        second = second.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
        at = spark.createDataFrame([(k, int(j), int(s), int(own[j].id)) for k, (j, s) in enumerate(scores)], "w long, j long, score long, anchor_id long")
        named_first = first.join(at, ["j", "score"])
        second = second.withColumnRenamed("j", "w").select("w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found.append(named_first.join(second, "w").select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
                                                          F.col("score").alias("positive_score"), "negative_score"))
        found[-1] = written(found[-1], "hard-negatives")
    if not found:
        return spark.createDataFrame([], out)
    result = found[0]
    for f in found[1:]:
        result = result.union(f)
    return result
