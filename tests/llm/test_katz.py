"""Katz scores against plain counting, and distributions that sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from foldwise.llm import katz as k
from foldwise.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</end>"]


class Plain:
    def __init__(self, rows):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for key, text in rows:
            if zlib.crc32(b"" if key is None else str(key).encode()) % 10:
                w = words(text)
                self.uni.update(w)
                for a, b in zip(["<begin>", *w], w):
                    self.bi[a][b] += 1
        of = lambda counts: [sum(c == r for c in counts) for r in range(1, k.MOST + 2)]
        self.n = sum(self.uni.values())
        self.d1 = [0, *k.Discount.fitted(of(self.uni.values())).factor, 1]
        self.d2 = [0, *k.Discount.fitted(of([c for x in self.bi.values() for c in x.values()])).factor, 1]
        self.bare = not any(c <= k.MOST for c in self.uni.values())
        self.unknown = 1 / (self.n + 1) if self.bare else 1 - sum(self.p1(w) for w in self.uni)

    def p1(self, w):
        c = self.uni[w]
        return self.d1[min(c, k.MOST + 1)] * c / (self.n + self.bare) if c else self.unknown

    def p2(self, a, b):
        seen = self.bi.get(a)
        if not seen:
            return self.p1(b)
        total = sum(seen.values()) + all(c > k.MOST for c in seen.values() if c)
        if seen[b]:
            return self.d2[min(seen[b], k.MOST + 1)] * seen[b] / total
        left = 1 - sum(self.d2[min(c, k.MOST + 1)] * c / total for c in seen.values())
        return left / (1 - sum(self.p1(w) for w in seen if seen[w])) * self.p1(b)

    def row(self, key, text):
        w = words(text)
        base = sum(math.log10((self.uni[x] + 0.1) / (self.n + 0.1 * (len(self.uni) + 1))) for x in w)
        return (key, zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0, len(w), sum(self.uni[x] > 0 for x in w), self.n, base,
                sum(math.log10(self.p2(a, b)) for a, b in zip(["<begin>", *w], w)))


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("group", [40, 3 << 20])
def test_scores(spark, monkeypatch, group):
    monkeypatch.setattr(k, "GROUP", group)
    monkeypatch.setattr(k, "BLOCK", 300)
    r = random.Random(4)
    rows = [(i, " ".join(f"W{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(None, None), (None, "w1 w1 never"), (5, ""), (7, "w1\tw2\x0bw3"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS score").repartition(3)
    plain = Plain(rows)
    same([tuple(x) for x in k.scores(df).collect()], [plain.row(*x) for x in rows])
    for context in ("w1", "<begin>", "w299", "never"):
        assert sum(plain.p2(context, w) for w in [*plain.uni, "unknown word"]) == pytest.approx(1)


def test_empty_table_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(k_, "a b") for k_ in range(60) if k.held_out(k_)], "doc_id long, text string")
    got = k.scores(df).collect()
    assert got and all(x.score == pytest.approx(0) and x.train_tokens == 0 and x.n_known == 0 for x in got)
    assert k.scores(df.limit(0)).count() == 0


def test_discounts():
    assert all(0 < x < 1 for x in k.Discount.fitted([1000, 300, 150, 90, 60, 40]).factor)
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 50, 900, 1, 1, 1]):
        assert all(0 < x < 1 for x in k.Discount.fitted(odd).factor)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Plain(rows)
    got = [tuple(x) for x in QUERIES["op4_katz"](spark, sf).collect()]
    same(got, [plain.row(*x) for x in rows])
    held = [x for x in got if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)


@pytest.mark.parametrize("begins", [False, True])
def test_no_context_meets_in_one_group(spark, monkeypatch, begins):
    monkeypatch.setattr(k, "GROUP", 800)
    monkeypatch.setattr(k, "BLOCK", 400)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    rows = [(i, word() if begins else " ".join(f"hot {word()}" for _ in range(10))) for i in range(4000 if begins else 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables = {}
    monkeypatch.setattr(k, "written", lambda df, label, f=k.written: tables.setdefault(label, f(df, label)))
    plain = Plain(rows)
    same([tuple(x) for x in k.scores(df).collect()], [plain.row(*x) for x in rows])
    met = Counter()
    for x in tables["katz-pairs"].where("block IS NOT NULL").select("g", "counts").collect():
        met[x.g] += len(k.unpack_large(x.counts))
    assert max(met.values()) < 2 * k.GROUP < 4000


def test_occurrences_stay_in_their_block(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(k, "written", lambda df, label, f=k.written: tables.setdefault(label, f(df, label)))
    rows = [(i, "a b " * 200) for i in range(50)]
    plain = Plain(rows)
    same([tuple(x) for x in k.scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()], [plain.row(*x) for x in rows])
    sent = [len(k.unpack_large(x.counts)) for x in tables["katz-pairs"].where("block IS NOT NULL").collect()]
    assert sum(sent) == 4  # begin a, a b, b a, b end


def recursive(rows, order):
    """log10 probability of a text by plain recursion over the orders; counts of (context, word) by context length."""
    plain = Plain(rows)
    after = {o: defaultdict(Counter) for o in range(2, order + 1)}
    for key, text in rows:
        if zlib.crc32(b"" if key is None else str(key).encode()) % 10:
            w = ["<begin>"] * (order - 1) + words(text)
            for o in after:
                for i in range(order - 1, len(w)):
                    after[o][tuple(w[i - o + 1:i])][w[i]] += 1
    counts = {o: [c for x in after[o].values() for c in x.values()] for o in after}
    factor = {o: [0, *k.Discount.fitted([sum(c == r for c in counts[o]) for r in range(1, k.MOST + 2)]).factor, 1] for o in after}

    def p(o, context, w):
        if o == 1:
            return plain.p1(w)
        seen = after[o].get(context)
        if not seen:
            return p(o - 1, context[1:], w)
        total = sum(seen.values()) + all(c > k.MOST for c in seen.values())
        if seen[w]:
            return factor[o][min(seen[w], k.MOST + 1)] * seen[w] / total
        left = 1 - sum(factor[o][min(c, k.MOST + 1)] * c / total for c in seen.values())
        return left / (1 - sum(p(o - 1, context[1:], v) for v in seen if seen[v])) * p(o - 1, context[1:], w)

    def score(text):
        w = ["<begin>"] * (order - 1) + words(text)
        return sum(math.log10(p(order, tuple(w[i - order + 1:i]), w[i])) for i in range(order - 1, len(w)))

    return plain, p, score


@pytest.mark.parametrize("group", [300, 3 << 20])
def test_recursion_over_orders_and_a_stored_model(spark, monkeypatch, tmp_path, group):
    monkeypatch.setattr(k, "GROUP", group)
    monkeypatch.setattr(k, "BLOCK", 400)
    r = random.Random(8)
    text = lambda: " ".join(f"W{int(r.paretovariate(0.9)) % 40}" for _ in range(r.randint(0, 40)))
    rows = [(i, text()) for i in range(150)] + [(None, None), (151, "w1 w1 never")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    others = [(i, text() + " unheard of w2 w1") for i in range(1000, 1040)]
    more = spark.createDataFrame(others, "doc_id long, text string")
    for order in (1, 2, 3):
        _, p, score = recursive(rows, order)
        got = {(x.doc_id, x.n_tokens): x.score for x in k.scores(df, order=order).collect()}
        assert got == pytest.approx({(key, len(words(t))): score(t) for key, t in rows}, rel=1e-9)
        if order > 1:
            assert sum(p(order, ("<begin>", "w1")[3 - order:], w) for w in [*Plain(rows).uni, "unknown word"]) == pytest.approx(1)
        k.fit(df, order=order).save(str(tmp_path / str(order)))
        model = k.Model.load(spark, str(tmp_path / str(order)))
        assert {x.doc_id: x.score for x in k.score_with(model, more).collect()} == pytest.approx({key: score(t) for key, t in others}, rel=1e-9)
    assert k.score_with(model, more.limit(0)).count() == 0
    with pytest.raises(ValueError):
        k.scores(df, order=0)


def test_blocks_are_made_in_little_memory(spark, monkeypatch):
    """A worker holds numbers of four bytes for the tokens of a block, not their hashes several times over."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    docs, caught = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append((f, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    monkeypatch.setattr(k, "written", lambda df, label: df)
    monkeypatch.setattr(k, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    k.blocks_of(docs, "doc_id", "text")
    [(run, rows)] = caught
    text = " ".join(f"w{i * i % 9973}" for i in range(1000))
    batches = [pa.RecordBatch.from_pydict({"k": list(range(i, i + 300)), "t": [text] * 300}) for i in range(0, 2400, 300)]
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 and peak < 75e6 and rows <= 2000, peak
