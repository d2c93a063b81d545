"""PartEnum against all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import partenum as p
from foldwise.llm.queries import QUERIES


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    counts = {}
    for who in post.values():
        for a in range(len(who)):
            for b in range(a):
                counts[who[b], who[a]] = counts.get((who[b], who[a]), 0) + 1
    for (a, b), n in counts.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    for _ in range(300):
        n = int(r.integers(2, 30) if seed < 3 else r.integers(30, 900))
        a = r.integers(0, 2 ** 63, n).astype(np.uint64)
        gone = int(r.integers(0, n // 4 + 1))
        b = np.concatenate([a[gone:], r.integers(0, 2 ** 63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)])
        same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 4 * same >= 3 * union and same < union:
            assert len(np.intersect1d(p.signatures(np.sort(a)), p.signatures(np.sort(b)))), (n, len(b))


def test_levels_hold_similar_sizes_together():
    found = p.levels(3000)
    for a in range(3, 2000):
        for b in (a, a + 1, 4 * a // 3):
            if b > a and 3 * b <= 4 * a:
                most = (a + b) // 7
                assert any(x.lo <= a < x.end and x.lo <= b < x.end and x.differences >= most for x in found), (a, b)
    assert p.levels(0) == []


def corpus(seed, n=220):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, out = words(60), []
    for _ in range(n // 11):
        base = words(r.choice([3, 5, 6, 9, 20, 120, 300]))
        out.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(copy)
        out.append(words(80) + passage + words(40))
        out.append(base + words(max(1, len(base) // 6)))
        out.append(passage + words(r.randint(1, 30)))
        out.append(words(r.randint(1, 7)))
    texts = [" ".join(x).upper() if r.random() < 0.2 else "\n".join(x) for x in out]
    rows = list(zip(r.sample(range(10_000), len(texts)), texts))
    return rows + [rows[3], rows[3], (None, rows[5][1]), (None, "quite alone here"), (5, None), (6, ""), (7, " \t\n"), (11, "a b"), (12, "A B")]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(x.key, x.n_shingles, x.component_id) for x in p.similar_groups(df.selectExpr("*", "1 AS key", "2 AS class", "3 AS n")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert p.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_is_a_parameter(spark):
    words = [f"x{i}" for i in range(104)]
    other = words[:60] + ["y"] + words[61:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    ids = lambda s: sorted(r.component_id for r in p.similar_groups(df, similar=s).collect())
    assert ids(Fraction(9, 10)) == [1, 1] and ids(Fraction(19, 20)) == [1, 2]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_partenum"](spark, sf).collect()), key=str) == brute(rows)


def test_pairs_equal_all_pairs(spark):
    rows = corpus(1, 110)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and 4 * len(a & b) >= 3 * len(a | b)
    want = [sum(near(s, t) for t in sets) - bool(s) for s in sets]
    got = p.link_counts(df).collect()
    assert sorted((str(x.key), x.n_shingles, x.links) for x in got) == sorted((str(k), len(s), n) for (k, _), s, n in zip(rows, sets, want))
    pairs = p.similar_pairs(df).collect()
    assert all(x.a < x.b for x in pairs) and len({(x.a, x.b) for x in pairs}) == len(pairs)
    equal = sum(s == t for i, s in enumerate(sets) for t in sets[:i] if s)
    assert sum(x.rows_a * x.rows_b for x in pairs) + equal == sum(want) // 2
    classes = {frozenset(s) for s in sets if s}
    assert len(pairs) == sum(near(a, b) for a in classes for b in classes if a != b) // 2
    assert p.similar_pairs(df.limit(0)).count() == p.link_counts(df.limit(0)).count() == 0


def test_sent_bytes_do_not_grow_with_groups(spark):
    """Shingles of a class go to ever more groups in larger tables; what is sent for one must not."""
    rows = [(i, " ".join(f"w{i * 7919 + j}" for j in range(400))) for i in range(200)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(2000 + i, t + " more") for i, (_, t) in enumerate(rows[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    size = F.expr("octet_length(who) + octet_length(low) + octet_length(tag) + octet_length(many)")
    sent = {g: p.sent_shingles(df, "text", 5, g).where("g >= 0").agg(F.sum(size)).first()[0] for g in (2, 2000)}
    assert sent[2000] <= 1.2 * sent[2]
    for g in sent:
        shared = [r["shared"] for r in p.shared_counts(df, "text", 5, g).collect()]
        assert sum(n >= 397 for n in shared) == 60 and sum(n < 397 for n in shared) < 10


def test_steps_are_read_back():
    for who in ([], [0], [5, 5, 9], [0, 300, 300, 70_000]):
        raw = p.steps(np.array(who, np.int64))
        assert p.from_steps(raw, len(who)).tolist() == who


@pytest.mark.parametrize("n", [3, 600, 5000])
def test_wide_sketches_bound_differences(spark, n):
    r = np.random.default_rng(n)
    a = r.integers(0, 2 ** 63, n).astype(np.uint64)
    cases = [np.concatenate([a[gone:], r.integers(0, 2 ** 63, more).astype(np.uint64)]) for gone, more in ((0, 0), (1, 0), (n // 4, n // 3), (n // 2, n // 2), (0, n))]
    rows = [(len(np.setxor1d(a, b)), p.wide_sketch(a).tolist(), p.wide_sketch(b).tolist()) for b in cases]
    got = spark.createDataFrame(rows, "d int, ka array<bigint>, kb array<bigint>").selectExpr("d", f"{p.bits_apart('ka', 'kb')} AS apart", f"{p.bits_apart('kb', 'ka')} AS back").collect()
    assert all(x.apart <= x.d and x.apart == x.back and (x.d - x.apart) % 2 == 0 for x in got)
    assert n < 5000 or got[3].apart > 2 * n * 0.25  # the sketch of fixed width let these through


def test_batches_are_small(spark):
    """Memory of an executor: both the JVM and the Python worker hold a batch of texts."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
    most = lambda: spark.range(0, 30_000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with p.small_batches(spark):
        assert most() <= 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before and most() == int(before)
