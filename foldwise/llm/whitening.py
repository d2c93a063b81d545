"""Whitening directions of a table of vectors by way of a bidiagonal matrix.

The centred rows are never multiplied with each other. Each task reduces its rows,
block by block, to one triangular factor; factors are stacked and reduced again,
sixteen at a time, until one is left. Householder reflections make that one upper
bidiagonal. The differential quotient-difference algorithm with shifts finds its
singular values to high relative accuracy, and twisted factorisations at those
values give the directions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import with_columns, written
from foldwise.llm.vectors import by_length, of_length, usual_length, whole

SCALE, SHIFT = 1024, 100_000
#: Larger entries are held here, so that every entry is exact as a double.
LIMIT = 1 << 51
#: Rows of a block; triangular factors that one task stacks.
BLOCK, FAN = 2048, 16
EPS = np.finfo(float).eps


# ---- the small matrix --------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, p): r = q * bidiag(a, b) * p.T with orthogonal q and p; a is the diagonal, b what stands above it."""
    m = np.array(r, float)
    d = len(m)
    p = np.eye(d)

    def reflector(x):
        v, norm = x.copy(), np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v[0] += math.copysign(norm, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k + 2 < d and (v := reflector(m[k, k + 1:])) is not None:
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), p


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of bidiag(a, b), largest first, by quotient-difference sweeps with shifts.

    A sweep turns the squares (q, e) into those of a matrix whose eigenvalues are all smaller by the shift. A shift that turns out too large makes a
    negative pivot and is taken back; where e has become negligible, the matrix falls apart.
    """
    found, todo = [], [((np.asarray(a, float) ** 2).tolist(), (np.asarray(b, float) ** 2).tolist(), 0.0)]
    while todo:
        q, e, total = todo.pop()
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (q[k] + q[k + 1] + total) or e[k] < 1e-300), None)
            if n == 1 or cut == n - 2:
                found.append(total + q.pop())
                del e[n - 2:]
                continue
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], total))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            # The smaller eigenvalue of the last two rows is close above the least one.
            x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = 0.5 * (x - y)
            least = y - z / (half + math.copysign(math.hypot(half, math.sqrt(z)), half)) if z else min(x, y)
            for shift in (max(0.0, least - 0.25 * e[-1]) if least > 0 else 0.0, 0.25 * max(0.0, least), 0.0):
                qq, ee, d = [], [], q[0] - shift
                for k in range(n - 1):
                    if d < 0:
                        break
                    qq.append(d + e[k])
                    ratio = q[k + 1] / qq[-1]
                    ee.append(e[k] * ratio)
                    d = d * ratio - shift
                if len(qq) == n - 1 and d >= 0:
                    q, e, total = [*qq, d], ee, total + shift
                    break
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """A unit vector z with bidiag(a, b).T * bidiag(a, b) * z close to value * z: one factorisation from above and one from below are joined where
    the pivot that they leave between them is smallest."""
    n, tiny = len(a), 1e-290
    q, l = a * a, b / a[:-1]
    s, low = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i] or tiny
        low[i] = q[i] * l[i] / pivot
        s[i + 1] = low[i] * l[i] * s[i] - value
    p, up = np.empty(n), np.empty(n - 1)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * l[i] * l[i] + p[i + 1] or tiny
        up[i] = l[i] * q[i] / pivot
        p[i] = p[i + 1] * q[i] / pivot - value
    r = int(np.argmin(np.abs(np.nan_to_num(s + p + value, nan=np.inf))))
    z = np.zeros(n)
    z[r] = 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(r - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z / np.linalg.norm(z)


def leading(r: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of r: the `top` largest that stand out from rounding.

    Values closer to each other than a thousandth are one cluster. Its twisted vectors only begin it: inverse iteration keeps them apart, and the
    cluster's own small eigenproblem turns them into eigenvectors.
    """
    a, b, p = bidiagonal(r)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((len(a), 0))
    values = dqds(a, b)
    keep = int(np.sum(values > (len(a) * EPS) ** 2 * values[0]))
    top = min(top, keep)
    a = np.where(np.abs(a) < EPS * scale * 1e-3, EPS * scale * 1e-3, a)
    full = np.diag(a) + np.diag(b, 1)
    t = full.T @ full
    bounds = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS * scale) + 1).tolist(), len(a)]
    parts = [(lo, hi) for lo, hi in zip(bounds, bounds[1:])]
    own = [dqds(a[lo:hi], b[lo:hi - 1]) for lo, hi in parts]
    cells = sorted(((v, k) for k, vs in enumerate(own) for v in vs), reverse=True)
    out, first, rng = [], 0, np.random.default_rng(0)
    while first < top:
        last = first + 1
        while last < len(cells) and cells[last - 1][0] - cells[last][0] <= 1e-3 * cells[first][0]:
            last += 1
        z = np.zeros((len(a), last - first))
        for j, (v, k) in enumerate(cells[first:last]):
            lo, hi = parts[k]
            z[lo:hi, j] = twisted(a[lo:hi], b[lo:hi - 1], v) if hi - lo > 1 else 1.0
        if last - first > 1:
            z = np.where(np.isfinite(z), z, 0)
            mean = float(np.mean([v for v, _ in cells[first:last]]))
            solve = np.linalg.inv(t - (mean + 2 * EPS * values[0]) * np.eye(len(a)))
            z = np.linalg.qr(z + 1e-8 * rng.standard_normal(z.shape))[0]
            for _ in range(4):
                z = np.linalg.qr(solve @ z)[0]
            small = full @ z
            _, s, turn = np.linalg.svd(small, full_matrices=False)
            z = z @ turn.T
        out += list(z.T)
        first = last
    z = np.array(out[:top]).T
    return values[:top], p @ z


# ---- the table --------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: n rows with sums S, the trace of their covariance, its leading eigenvalues and eigenvectors (columns)."""
    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n with one rounding: the whole part of S/n is taken off exactly."""
        parts = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([k for k, _ in parts], np.int64)) - np.array([r / self.n for _, r in parts])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exactly."""
        if not len(x):
            return []
        s = np.array(self.sums, object)
        reach = self.n * int(np.abs(x).max()) + max(abs(k) for k in self.sums)
        if reach < 1 << 62:
            y = self.n * x - s.astype(np.int64)
            if int(np.abs(y).max()) ** 2 * len(s) < 1 << 63:
                return (y * y).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in self.n * x.astype(object) - s]


def integers(values: np.ndarray) -> np.ndarray:
    return whole(values, SCALE, LIMIT) + SHIFT


def totals(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """(n, sums) of the vectors that count: those of the usual length. Sums are taken apart into high and low bits, so none overflows."""
    def run(batches):
        got = {}
        for batch in batches:
            for d, (rows, values) in by_length(batch.column(0)).items():
                x = integers(values)
                n, high, low = got.get(d, (0, 0, 0))
                got[d] = n + len(rows), high + (x >> 26).sum(axis=0), low + (x & (1 << 26) - 1).sum(axis=0)
        for d, (n, high, low) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([high], pa.list_(pa.int64())),
                                              pa.array([low], pa.list_(pa.int64()))], ["d", "n", "high", "low"])

    part = written(vectors.select(column).mapInArrow(run, "d int, n long, high array<bigint>, low array<bigint>"), "vector-sums")
    d = usual_length(part.select("d", "n"))
    if not d:
        return 0, []
    part = part.where(F.col("d") == d)
    n = part.agg(F.sum("n")).first()[0]
    each = part.select(F.posexplode(F.arrays_zip("high", "low")).alias("k", "x")).groupBy("k").agg(
        F.sum(F.col("x.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("x.low").cast("decimal(38,0)")).alias("low"))
    return n, [(int(r.high) << 26) + int(r.low) for r in each.orderBy("k").collect()]  # one row for each dimension


def triangular(vectors: DataFrame, column: str, model: Whitening) -> np.ndarray:
    """The triangular factor of all centred rows. Every task stacks blocks on the factor it has, FAN factors meet in each later task."""
    d = model.dimension
    schema = "slot long, r array<double>"

    def packed(slot, r):
        full = np.zeros((d, d))
        full[:len(r)] = r
        return [pa.array([slot], pa.int64()), pa.array([full.ravel()], pa.list_(pa.float64()))], ["slot", "r"]

    def rows(batches):
        r = np.zeros((0, d))
        for batch in batches:
            x = model.centred(integers(of_length(batch.column(0), d)[1]))
            for k in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, x[k:k + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays(*packed(TaskContext.get().partitionId(), r))

    def stack(factors):  # at most FAN
        r = np.zeros((0, d))
        for one in factors.column("r"):
            r = np.linalg.qr(np.vstack([r, np.array(one.as_py()).reshape(d, d)]), mode="r")
        return pa.Table.from_arrays(*packed(factors["slot"][0].as_py(), r))

    out = written(vectors.select(column).mapInArrow(rows, schema), "factors")
    while out.count() > 1:
        out = written(out.select(F.expr(f"slot div {FAN}").alias("slot"), "r").groupBy("slot").applyInArrow(stack, schema), "factors")
    return np.array(out.first()["r"]).reshape(d, d)


def fit(vectors: DataFrame, column: str = "embedding", top: int = 8) -> Whitening | None:
    """Fit on all rows whose vector counts. None if there is none."""
    n, sums = totals(vectors, column)
    if not n:
        return None
    bare = Whitening(n, tuple(sums), 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    r = triangular(vectors, column, bare)
    values, directions = leading(r, top)
    return Whitening(n, tuple(sums), float((r * r).sum() / n), values / n, directions)


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = len(model.values)
    if not k:
        return None

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whitened(integers(of_length(batch.column(0), model.dimension)[1]))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["k", "x"])

    cells = vectors.select(column).mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    return float(np.abs(np.array([c.x for c in cells]).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_text) for each row that counts and each component from 1.

    Rows with a null or empty vector, with null or non-finite entries, or of another length than most rows (of equally frequent lengths the largest
    counts) are left out; entries beyond 2 ** 41 are held there. Null and repeated keys are rows of their own, keys may be of any type, other columns
    are not read. Components are those whose variance stands out from rounding: fewer than `top` if the rows span fewer dimensions, none
    (an empty result) for equal rows, one row or an empty table. deviation is null where it is beyond a long; deviation_text always has it.
    """
    rows = df.select(key, vector)
    model = fit(rows, vector, top)
    schema = with_columns(rows, [key], "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, vector, model), len(model.values)
    explained = model.values / model.trace

    def run(batches):
        for batch in batches:
            at, values = of_length(batch.column(1), model.dimension)
            x = integers(values)
            exact = np.repeat(np.array(model.deviations(x), object), k)
            m = len(at)
            columns = [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                       pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)),
                       pa.array(np.full(m * k, error)), pa.array([str(v) for v in exact], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"]
    return rows.mapInArrow(run, schema)
