"""Singular values, directions and whitened rows."""

import numpy as np
import pytest

from foldwise.llm import whitening as w
from foldwise.llm.queries import QUERIES


def matrices():
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.standard_normal((20, 20)))[0]
    yield from (np.triu(r.standard_normal((d, d))) for d in (1, 2, 3, 17, 64))
    yield np.eye(10)
    yield np.diag([1.0, 1, 1, 0, 0])
    yield np.zeros((4, 4))
    yield np.linalg.qr(np.diag([5.0] * 6 + [4.9999999] * 3 + [1e-3] * 5 + [1e-6] * 6) @ q, mode="r")
    yield np.linalg.qr(r.standard_normal((100, 3)) @ r.standard_normal((3, 12)), mode="r")
    glued = np.diag([abs(i - 10) + 15.0 for i in range(21)]) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield np.linalg.cholesky(glued).T


@pytest.mark.parametrize("r", list(matrices()))
def test_leading_values_and_directions(r):
    values, z = w.leading(r, 64)
    s = np.linalg.svd(r, compute_uv=False)
    assert len(values) == np.sum(s > 1e-13 * max(s.max(), 1e-300) * len(s))
    if len(values):
        assert np.allclose(values, s[:len(values)] ** 2, rtol=1e-8, atol=0)
        assert np.allclose(z.T @ z, np.eye(len(values)), atol=1e-9)
        assert np.abs(r.T @ (r @ z) - z * values).max() < 1e-10 * values[0]


def test_bidiagonal_form():
    r = np.triu(np.random.default_rng(1).standard_normal((9, 9)))
    a, b, p = w.bidiagonal(r)
    m = np.diag(a) + np.diag(b, 1)
    assert np.allclose(p.T @ p, np.eye(9)) and np.allclose(p @ m.T @ m @ p.T, r.T @ r)


def test_graded_values_keep_all_digits():
    # Down to 1e-38 of the largest square, where a covariance would have lost everything.
    a = 10.0 ** -np.arange(20)
    q = 0.3 * a[:-1]
    exact = np.linalg.svd(np.diag(a) + np.diag(q, 1), compute_uv=False)
    assert np.allclose(np.sqrt(w.dqds(a, q)), exact, rtol=1e-13)


def reference(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    return x, n, s, c, e[::-1], u[:, ::-1], np.trace(v)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, n, s, c, e, u, trace = reference([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, sf).collect()}
    assert len(got) == 8 * len(rows)
    sign = [None] * 8
    for k, r in enumerate(rows):
        deviation = int(((n * x[k].astype(object) - s) ** 2).sum())
        for j in range(8):
            g = got[r.vec_id, j + 1]
            want = c[k] @ u[:, j] / np.sqrt(e[j])
            if sign[j] is None and abs(want) > 0.1:
                sign[j] = np.sign(want * g.whitened)
            assert (g.n, g.deviation) == (n, deviation) and g.explained == pytest.approx(e[j] / trace, rel=1e-9) and g.identity_error < 1e-9
            assert abs(abs(g.whitened) - abs(want)) < 1e-9 and (sign[j] is None or abs(want) < 1e-6 or np.sign(want * g.whitened) == sign[j])


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").selectExpr("*", "1 AS component", "2 AS n", "'x' AS whitened")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, (i * i) % 7 / 10, 0.3] for i in range(30)]
    rows = [(str(i), v) for i, v in enumerate(good)] + [(None, good[3]), ("3", good[3]), ("bad", None), ("bad", []), ("bad", [nan, 1.0, 2.0]), ("bad", [inf, 1.0, 2.0]),
                                                        ("bad", [None, 1.0, 2.0]), ("bad", [1.0]), ("bad", [1.0, 2.0, 3.0, 4.0])]
    got = w.whiten(frame(spark, rows, "string").repartition(7)).collect()
    # The third entry never differs, so there are two components.
    assert {r.component for r in got} == {1, 2} and len(got) == 64 and "bad" not in {r.vec_id for r in got} and {r.n for r in got} == {32}
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == "3" for r in got) == 4
    assert max(r.identity_error for r in got) < 1e-9 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert w.whiten(frame(spark, rows)).count() == 0


def test_huge_entries_and_deviations(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, -2.5])]
    got = w.whiten(frame(spark, rows)).where("component = 1").collect()
    x = np.array([[w.LIMIT, 0], [-w.LIMIT, 1024], [5120, -2560]], object) + 100_000
    want = [int(((3 * r - x.sum(axis=0)) ** 2).sum()) for r in x]
    assert {r.vec_id: int(r.deviation_text) for r in got} == dict(zip((1, 2, 3), want))
    assert all(r.deviation is None or r.deviation == int(r.deviation_text) for r in got) and got[0].deviation is None


def test_many_factors_meet_in_rounds(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=5).tolist()) for i in range(900)]
    got = {(x.vec_id, x.component): x for x in w.whiten(frame(spark, rows).repartition(70)).collect()}
    *_, e, u, trace = reference([v for _, v in rows])
    assert len(got) == 4500 and max(x.identity_error for x in got.values()) < 1e-9
    assert [got[0, k + 1].explained for k in range(5)] == pytest.approx((e / trace).tolist())
