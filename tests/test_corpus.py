"""Corpus operators against small, independent Python checks."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from foldwise.functions import num as N
from foldwise.operators import prompts as P
from foldwise.operators import records as R
from foldwise.operators import textstats as T

UNIT = "In Alice's Wonderland, a secret unit conversion is applied to measurements. For example:\n{pairs}\nNow, convert the following measurement: {q} m"
FALL = "the gravitational constant has been secretly changed.\n{pairs}\nNow, determine the falling distance for t = {q} s given d = 0.5*g*t^2."
CIPHER = "secret encryption rules are used on text. Examples:\n{pairs}\nNow, decrypt the following text: {q}"
NUMERAL = "numbers are secretly converted into a different numeral system. Now, write the number {n} in the Wonderland numeral system."


def test_number_text_equals_python(spark):
    rng = random.Random(1)
    xs = [0.125, 0.16725, 2.675, 0.83625, 1.005, 45.0, 38.6, 0.03125, 1e-3, 123456.5, 0.0005] + [rng.randint(1, 9999) / rng.choice([8, 16, 32, 40, 50, 100, 1000]) for _ in range(400)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    x = F.col("x")
    for r in df.select("x", N.fixed_text(x, 4).alias("f4"), N.fixed_text(x, 6).alias("f6"), N.short_text(x).alias("g"), N.half_up_text(x).alias("h"),
                       (N.exact_scaled(x, 2) / F.lit(100.0)).cast("string").alias("r2")).collect():
        v = r["x"]
        assert (r["f4"], r["f6"], r["g"]) == (f"{v:.4f}", f"{v:.6f}", f"{v:g}")
        assert r["h"] == f"{Decimal(str(v)).quantize(Decimal('0.01'), rounding=ROUND_HALF_UP):.2f}"
        assert r["r2"] == str(round(v, 2))


def test_classification(spark):
    rows = [(NUMERAL.format(n=3), "numeral"), (UNIT, "unit_conversion"), ("nothing", None), (NUMERAL + FALL, None)]
    df = spark.createDataFrame(rows, "prompt string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", P.classify(F.col("prompt"))).collect())


ROMAN = {1: "I", 4: "IV", 9: "IX", 14: "XIV", 40: "XL", 90: "XC", 99: "XCIX", 400: "CD", 944: "CMXLIV", 1994: "MCMXCIV", 3999: "MMMCMXCIX"}


def test_roman_and_its_trace(spark):
    df = P.solve_numeral(spark.createDataFrame([(n, NUMERAL.format(n=n)) for n in [0, *ROMAN]], "n int, prompt string"))
    got = {r["n"]: r for r in df.withColumn("trace", P.numeral_trace()).collect()}
    assert got[0]["derived"] is None and {n: got[n]["derived"] for n in ROMAN} == ROMAN
    lines = got[944]["trace"].split("\n")
    assert lines[1:4] == ["944: 1 of CM, rest 44", "44: 1 of XL, rest 4", "4: 1 of IV, rest 0"] and lines[-1] == "\\boxed{CMXLIV}"
    assert "3999: 3 of M, rest 999" in got[3999]["trace"]


def test_unit_interval_and_fallback(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        f = rng.uniform(0.3, 2.0)
        xs = [round(rng.uniform(5, 40), 2) for _ in range(4)]
        ys = [round(x * f, 2) + (1.0 if i % 6 == 0 and j == 0 else 0.0) for j, x in enumerate(xs)]
        rows.append((i, UNIT.format(pairs="\n".join(f"{x:.2f} m becomes {y:.2f}" for x, y in zip(xs, ys)), q="12.50"), list(zip(xs, ys))))
    df = P.solve_unit(spark.createDataFrame([r[:2] for r in rows], "id int, prompt string"))
    got = {r["id"]: r for r in df.withColumn("trace", P.unit_trace()).collect()}
    for i, _, pairs in rows:
        pairs = [(x, float(f"{y:.2f}")) for x, y in pairs]
        lo, hi = max((y - .005) / x for x, y in pairs), min((y + .005) / x for x, y in pairs)
        want = (lo + hi) / 2 if lo <= hi else sum(x * y for x, y in pairs) / sum(x * x for x, _ in pairs)
        assert got[i]["factor"] == pytest.approx(want, rel=1e-12)
        assert got[i]["derived"] == f"{Decimal(str(got[i]['factor'] * 12.5)).quantize(Decimal('0.01'), rounding=ROUND_HALF_UP):.2f}"
        assert ("least squares" in got[i]["trace"]) == (lo > hi)
        assert f"in {pairs[0][0]:g}, out {pairs[0][1]:g}: k from {(pairs[0][1] - .005) / pairs[0][0]:.4f} to " in got[i]["trace"]
    assert P.solve_unit(spark.createDataFrame([("no pairs here",)], "prompt string")).first()["derived"] is None


def test_fall_answers_drop_trailing_zeros(spark):
    g = 9.0
    pairs = "\n".join(f"For t = {t} s, distance = {round(0.5 * g * t * t, 2)} m" for t in (1.0, 2.0, 3.5))
    r = P.solve_fall(spark.createDataFrame([(FALL.format(pairs=pairs, q="2.0"),)], "prompt string")).withColumn("trace", P.fall_trace()).first()
    assert r["derived"] == "18.0" and r["factor"] == pytest.approx(9.0, abs=1e-2) and r["trace"].endswith("\\boxed{18.0}")


# ---- cipher, checked against a plain sequential solver ----------------------------------

def solve_plainly(pairs, query, vocab):
    m = {}
    for c, p in pairs:
        for cw, pw in zip(c.split(), p.split()):
            m.update(zip(cw, pw))
    cw = query.split()

    def fits(w):
        out = []
        for v, n in vocab:
            if len(v) == len(w):
                d = {}
                if all(m.get(a, b) == b and d.setdefault(a, b) == b for a, b in zip(w, v)):
                    out.append((-n, v))
        return [v for _, v in sorted(out, key=lambda t: t[0])]

    res = [None] * len(cw)
    moved = True
    while moved:
        moved = False
        for i, w in enumerate(cw):
            if res[i] is None and len(fits(w)) == 1:
                res[i] = fits(w)[0]
                m.update(zip(w, res[i]))
                moved = True
    return " ".join(r or (fits(w)[0] if fits(w) else "".join(m.get(ch, ch) for ch in w)) for r, w in zip(res, cw))


def cipher_rows(n=30, seed=5):
    rng = random.Random(seed)
    vocab = list(P.CLOSED_VOCABULARY)
    rows = []
    for i in range(n):
        letters = [chr(97 + j) for j in range(26)]
        key = letters[:]
        rng.shuffle(key)
        enc = str.maketrans("".join(letters), "".join(key))
        pick = lambda k: " ".join(rng.choice(vocab)[0] for _ in range(k))
        plain = [pick(3) for _ in range(3)]
        ask = pick(4) if i % 5 else pick(2) + " zzyzx"
        pairs = [(p.translate(enc), p) for p in plain]
        rows.append((i, CIPHER.format(pairs="\n".join(f"{c} -> {p}" for c, p in pairs), q=ask.translate(enc)), ask, pairs, ask.translate(enc)))
    return rows, vocab


def test_cipher_equals_sequential_solver(spark):
    rows, vocab = cipher_rows()
    df = spark.createDataFrame([r[:2] for r in rows], "id int, prompt string")
    out = P.solve_cipher(df, P.vocabulary(spark), first_pass=True)
    got = {r["id"]: r for r in out.withColumn("trace", P.cipher_trace()).collect()}
    assert len(got) == len(rows)
    for i, _, _, pairs, q in rows:
        assert got[i]["derived"] == solve_plainly(pairs, q, vocab)
    assert sum(got[i]["derived"] == ask for i, _, ask, _, _ in rows) > len(rows) * 0.6
    assert any("raw-map" in got[i]["kinds"] for i in got) and all(got[i]["trace"].endswith("}") for i in got)


def test_cipher_rejects_inconsistent_examples(spark):
    rows = [("ab -> xy", True), ("ab -> xx", False), ("ab ac -> xy zz", False), ("ab -> xyz", False), ("ab c -> xy", False)]
    df = spark.createDataFrame([(CIPHER.format(pairs=p, q="ab"), w) for p, w in rows], "prompt string, want boolean")
    got = df.select("want", P.cipher_map(P.cipher_parts(F.col("prompt"))[0]).isNotNull().alias("ok")).collect()
    assert all(r["ok"] == r["want"] for r in got)


def test_last_boxed_variants(spark):
    rows = [("a \\boxed{1} b \\boxed{ 2 }", "2", "2"), ("none", None, None), ("\\boxed{x} \\boxed{open", "x", "open"), ("\\boxed{}", "", None), ("\\boxed{a{b}c}", "a{b", "a{b"),
            ("\\boxed{two\nlines}", "two\nlines", "two\nlines")]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    for r in df.select("a", "b", R.last_boxed(F.col("t")).alias("x"), R.last_boxed(F.col("t"), True, True).alias("y")).collect():
        assert (r["x"], r["y"]) == (r["a"], r["b"])


def test_assembly(spark):
    rows = [("body \\boxed{1}\n tail \\boxed{2}", "2", "body \\boxed{1}\n tail\n</think>\n\\boxed{2}"), ("\\boxed{2}", "2", None), ("no box", "2", None)]
    df = spark.createDataFrame(rows, "t string, a string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", R.assemble_completion(F.col("t"), F.col("a"))).collect())


def test_records_and_funnel_add_up(spark):
    rows, _ = cipher_rows(6)
    data = [(i, p, ask) for i, p, ask, _, _ in rows] + [(100, NUMERAL.format(n=9), "ix"), (101, NUMERAL.format(n=9), "X"), (102, "free text", "x")]
    rec = R.build_records(spark.createDataFrame(data, "id int, prompt string, answer string"), P.vocabulary(spark)).persist()
    f = {r["category"]: r for r in R.funnel(rec).collect()}
    t = f["TOTAL"]
    assert t["classified"] == 8 and t["unclassified"] == 1 and t["written"] + t["unsolved"] + t["bad_assembly"] + t["bad_box"] == t["classified"]
    assert f["numeral"]["written"] == 1 and f["numeral"]["unsolved"] == 1
    for r in R.written(rec).collect():
        user, bot = r["messages"]
        assert user["content"].endswith("`\\boxed{your answer}`") and bot["content"].count("</think>") == 1 and bot["role"] == "assistant"


def test_supervision_and_lengths(spark):
    df = spark.createDataFrame([(1, "a b", "x </think> \\boxed{1}"), (2, "a b c d e f", "x y z")], "id int, p string, c string")
    s = R.supervision_split(df, "p", "c", 7)
    got = {r["id"]: (r["prompt_len"], r["completion_len"], r["drop_reason"]) for r in s.collect()}
    assert got == {1: (2, 4, None), 2: (6, 4, "prompt_fills_budget")}
    inv = R.supervision_invariants(R.supervision_masks(df, "p", "c", 7)).first()
    assert inv["n_kept"] == 1 and sum(inv[c] for c in inv.asDict() if c != "n_kept") == 0
    xs = [random.Random(3).randint(1, 50) for _ in range(97)]
    r = T.length_stats(spark.createDataFrame([(x,) for x in xs], "n int"), "n").first()
    assert (r["n"], r["max"], r["p95"]) == (97, max(xs), sorted(xs)[int(97 * 0.95)])


def test_tfidf_equals_plain_computation(spark):
    import math
    import re
    from collections import Counter
    docs = ["the cat sat", "the cat ran", "a dog sat on the mat", "Ünïcode the dog"]

    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return w + [" ".join(p) for p in zip(w, w[1:])]

    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    v = T.fit_tfidf(df, "id", "t", max_features=6, min_df=2)
    tf, dfc = Counter(), Counter()
    for d in docs:
        tf.update(grams(d))
        dfc.update(set(grams(d)))
    want = sorted((t for t in tf if dfc[t] >= 2), key=lambda t: (-tf[t], t))[:6]
    assert sorted(r["term"] for r in v.collect()) == sorted(want)
    got = {(r["id"], r["term"]): r["weight"] for r in T.apply_tfidf(df, v, "id", "t").collect()}
    for i, d in enumerate(docs):
        c = Counter(g for g in grams(d) if g in want)
        w = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + dfc[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            assert got[i, t] == pytest.approx(x / norm)


def test_padding_plan_covers_all_rows(spark):
    df = spark.range(53).withColumn("n", (F.col("id") % 20 + 1).cast("int"))
    rows = T.padding_plan(df, ["id"], "n", 8).collect()
    assert sum(r["n_rows"] for r in rows) == 53 and len(rows) == 7 and all(r["padded_to"] % 8 == 0 and r["padded_to"] >= r["longest"] for r in rows)


def test_no_number_kills_the_job(spark):
    from foldwise.functions.num import half_up_text
    from foldwise.operators import prompts
    rows = spark.createDataFrame([(1e30,), (2.5,), (None,)], "x double").select(half_up_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [None, "2.50", None]
    pairs = spark.createDataFrame([([(0.0, 1.0), (2.0, 4.0)],), ([(2.0, 4.0)],)], "p array<struct<a:double,b:double>>")
    bands = [r.b for r in pairs.select(prompts.rounding_band(F.col("p"), lambda a: a).alias("b")).collect()]
    assert bands[0] is None and bands[1].fit == 2.0
    big = spark.createDataFrame([(9_999_999_999_999,), (14,)], "n long").select(prompts.roman(F.col("n")).alias("r")).collect()
    assert [r.r for r in big] == [None, "XIV"]


def test_rows_of_zeros_blend_to_missing(spark):
    from foldwise.operators.blend import blend_columns
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in df.select(*blend_columns([[F.col("a"), F.col("b")]])).collect()] == [(None, None), (0.25, 0.75)]


def test_one_pass_equals_the_kinds_alone(spark):
    data = [(1, NUMERAL.format(n=49)), (2, UNIT.format(pairs="2.00 m becomes 3.00\n4.00 m becomes 6.00", q="10.00")),
            (3, FALL.format(pairs="For t = 1.0 s, distance = 4.5 m\nFor t = 2.0 s, distance = 18.0 m", q="3.0")), (4, "free text"), (5, None)]
    df = spark.createDataFrame(data, "id int, prompt string").withColumn("category", P.classify(F.col("prompt")))
    got = {r.id: (r.derived, r.trace) for r in P.solve_rows(df).withColumn("trace", P.trace_rows()).collect()}
    for i, solve, trace in ((1, P.solve_numeral, P.numeral_trace), (2, P.solve_unit, P.unit_trace), (3, P.solve_fall, P.fall_trace)):
        r = solve(df.where(F.col("id") == i)).withColumn("trace", trace()).first()
        assert got[i] == (r.derived, r.trace) and r.trace.endswith(f"\\boxed{{{r.derived}}}")
    assert got[4] == got[5] == (None, None)
    own = P.TRACES | {"numeral": {"open": "n={n}", "row": "{symbol}", "close": "{r}"}}
    assert P.solve_rows(df).where("id = 1").select(P.trace_rows(traces=own).alias("t")).first().t == "n=49\nXL\nIX\nXLIX\n\\boxed{XLIX}"


def test_funnel_has_rows_for_absent_categories(spark):
    rec = R.build_records(spark.createDataFrame([(1, NUMERAL.format(n=9), "IX")], "id int, prompt string, answer string"))
    f = {r.category: r for r in R.funnel(rec, list(P.CATEGORY_PHRASES)).collect()}
    assert set(f) == {"numeral", "unit_conversion", "gravity", "cipher", "TOTAL"} and f["numeral"].written == 1 and f["cipher"].classified == 0 and f["gravity"].coverage_pct == 0


def test_signatures_find_what_every_pair_would(spark):
    vocab = spark.createDataFrame([(w, n, 0) for n, w in enumerate(["noon", "moon", "mood", "deed", "abba", "aaaa", "abcd", "x=#1", "né", "ab"])], "word string, freq long, ord int")
    rows = [(1, "qrrq", {}), (2, "qrrq", {"q": "n"}), (3, "qrrs", {"s": "d"}), (4, "qqqq", {}), (5, "zz", {}), (6, "zy", {"y": "é"}), (7, "qrst", {}), (8, "abcd", {"a": "Z"}), (9, "wxyz", {"w": "x", "x": "="})]
    df = spark.createDataFrame(rows, "id int, w string, cmap map<string,string>")
    index = P.vocabulary_index(vocab)
    got = sorted((r.id, r.word) for r in P.candidates(df, index, ["id"]).collect())
    want = []
    for i, w, m in rows:
        for v in [r.word for r in vocab.collect()]:
            d = {}
            if len(v) == len(w) and all(m.get(a, b) == b and d.setdefault(a, b) == b for a, b in zip(w, v)):
                want.append((i, v))
    assert got == sorted(want)
    top = {r.id: (r.n, r.word) for r in P.answers(df, index, ["id"]).collect()}
    assert top[1] == (4, "aaaa") and top[2] == (1, "noon") and 5 not in top and 8 not in top


def faults(m):
    return {k: v for k, v in R.supervision_invariants(m).first().asDict().items() if v and k != "n_kept"}


def test_masks_are_checked_token_by_token(spark):
    rows = [(1, "ask  this", f"so it is {R.CLOSING_TAG}\n\\boxed{{a}}"), (2, None, f"{R.CLOSING_TAG} \\boxed{{b}}"), (3, "x", None), (4, f"p {R.CLOSING_TAG}", "nothing"),
            (5, "word " * 40, f"{R.CLOSING_TAG} \\boxed{{c}}"), (6, "a b", "c " * 60)]
    df = spark.createDataFrame(rows, "id int, p string, c string").selectExpr("*", "1 AS split_", "2 AS label")
    m = R.supervision_masks(df, "p", "c", 40).persist()
    got = {r.id: r for r in m.collect()}
    assert (got[1].prompt_len, got[1].completion_len, got[1].drop_reason) == (2, 6, None) and got[1].labels[:2] == [R.IGNORED] * 2
    assert got[1].labels[2:] == [t.id for t in got[1].tokens[2:]] and got[1].tokens[-1].id == R.END_ID
    assert [got[1].text[t.start:t.stop] for t in got[1].tokens[:3]] == ["ask", "this", "so"]
    assert got[2].prompt_len == 0 and got[3].completion_len == 1 and got[5].drop_reason == "prompt_fills_budget" and got[6].drop_reason == "truncated"
    assert faults(m) == {"no_supervision": 1, "no_closing_tag": 2, "no_box": 2, "tag_in_prompt": 1}
    one = m.where("id = 1")
    flat = lambda i, v: one.withColumn("labels", F.transform("labels", lambda y, k: F.when(k == i, F.lit(v).cast("long")).otherwise(y)))
    assert faults(one) == {} and faults(flat(0, 7)) == {"prompt_learnt": 1} and faults(flat(3, R.IGNORED)) == {"completion_masked": 1}
    assert faults(one.withColumn("tokens", F.slice("tokens", 1, 7)).withColumn("labels", F.slice("labels", 1, 7))) == {"no_end": 1}
    turned = one.withColumn("tokens", F.concat(F.slice("tokens", 8, 1), F.slice("tokens", 1, 7)))
    assert faults(turned)["end_not_last"] == 1


def test_a_library_tokenizer_can_be_plugged_in(spark):
    def letters(texts):
        return [[(ord(c), i, i + 1) for i, c in enumerate(t) if not c.isspace()] for t in texts]

    m = R.supervision_masks(spark.createDataFrame([("ab", "c d")], "p string, c string"), "p", "c", 100, tokenize=letters).first()
    assert m.labels == [R.IGNORED, R.IGNORED, ord("c"), ord("d"), R.END_ID] and m.prompt_len == 2


def test_prompts_are_dealt_out_and_maps_computed_once(spark):
    """A small one-file table is no single task, and neither the filter nor the size repeats the letter map."""
    from foldwise.plans import corpus as C
    assert C.prompts(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 8
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(C.bijection_check(spark, "/root/testdata/sf0.001")).count("map_from_") == 1
    ex, _ = P.cipher_parts(F.col("prompt"))
    d = C.prompts(spark, "/root/testdata/sf0.001").select("id", P.known_map(ex).alias("cmap")).where("cmap IS NOT NULL")
    assert plan(d).count("map_from_") == 1


def test_worked_traces_hold_every_step(spark):
    """Each subtraction, each row as read and each rough value have a line; chat records are made from these."""
    n = P.solve_numeral(spark.createDataFrame([(NUMERAL.format(n=3008),)], "prompt string")).select(P.numeral_trace(P.WORKED["numeral"]).alias("t")).first()["t"]
    assert n.split("\n")[1:5] == ["3008 holds 1000: M is added, so far M, rest 2008", "2008 holds 1000: M is added, so far MM, rest 1008",
                                  "1008 holds 1000: M is added, so far MMM, rest 8", "8 holds 5: V is added, so far MMMV, rest 3"]
    u = P.solve_unit(spark.createDataFrame([(UNIT.format(pairs="2.00 m becomes 3.00\n4.00 m becomes 6.00", q="12.50"),)], "prompt string"))
    t = u.select(P.unit_trace(P.WORKED["unit_conversion"]).alias("t")).first()["t"]
    assert "read: in 4, out 6" in t and "about 1.5000 as it stands, k from 1.4975 to 1.5025" in t and "1.5000 times 12.5 makes 18.75" in t
    from foldwise.plans import corpus as C
    records = C.chat_records(spark, "/root/testdata/sf0.001")
    assert records.where(F.col("record").contains('"numeral"') & ~F.col("record").contains("so far")).count() == 0


def test_pairs_of_rare_words_are_not_counted(spark):
    """The pruned vocabulary is that of all terms, ties included."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(rng.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame(docs, "id int, t string")
    counts = {}
    for _, t in docs:
        w = t.split() if t else []
        for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            counts.setdefault(g, [0, set()])
            counts[g][0] += 1
            counts[g][1].add(_)
    want = sorted(((-n, g) for g, (n, d) in counts.items() if len(d) >= 5))[:30]
    got = T.fit_tfidf(df, "id", "t", 30, 5)
    assert sorted((-r["tf"], r["term"]) for r in got.collect()) == want
    only = {r["x"] for r in df.select(F.explode(T.grams(F.col("t"), 2, 2, ["w0", "w1"])).alias("x")).collect()}
    assert only == {g for g in counts if set(g.split()) <= {"w0", "w1"} and " " in g}


def test_tokens_are_objects_for_few_texts_at_a_time(spark):
    def counted(texts):
        assert len(texts) <= R.TEXTS
        return R.space_tokens(texts)

    df = spark.range(1000, numPartitions=1).selectExpr("id", "repeat('a b ', cast(id % 5 as int)) AS t")
    got = R.with_tokens(df, "t", tokenize=counted).selectExpr("count_if(size(tokens) = 2 * (id % 5)) AS n").first()["n"]
    assert got == 1000


# ---- traces and gate over every prompt -----------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few_parts(tmp_path):
    """Parts with ciphers of every kind of line: only one word fits, one is left after others, several fit; and parts without a name or type."""
    import duckdb
    import oracle
    types = ["cat", "bat", "bat cabin", "cabin", "top", "pot", "pot oops", "red", None]
    rows = ", ".join(f"({i}, {['NULL', quoted('Red den')][i % 17 > 0]}, {quoted(types[i % len(types)])})" for i in range(40))
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(p_partkey, p_name, p_type)) TO '{tmp_path}/narrow.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY (SELECT p_partkey::BIGINT AS p_partkey, p_name, p_type FROM '{tmp_path}/narrow.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    return str(tmp_path), con, oracle.compare


def quoted(text):
    return "NULL" if text is None else f"'{text}'"


def test_render_trace_has_every_prompt(spark):
    from foldwise.plans import load
    queries, sql = load()
    got = queries["render_trace"](spark, SF).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("trace").alias("t"), F.count_if(F.col("trace").startswith(
        P.TRACES["cipher"]["open"][:20]) & F.col("trace").endswith("}")).alias("c")).collect()
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    plain = n - spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 9 = 0").count()
    assert {r.category: (r.n, r.t, r.c) for r in got} == {
        "numeral": (n, n, 0), "unit_conversion": (n, n, 0), "gravity": (n, n, 0), "cipher": (n, plain, plain), None: (2 * n, 0, 0)}


def test_render_trace_of_ciphers_equals_sql(spark, few_parts):
    from foldwise.plans import load
    path, con, compare = few_parts
    queries, sql = load()
    assert compare(queries["render_trace"](spark, path), con, sql["render_trace"]) is None
    text = "\n".join(r[0] for r in con.execute(f"SELECT trace FROM ({sql['render_trace']}) WHERE category = 'cipher' AND trace IS NOT NULL").fetchall())
    assert "no other word fits" in text and "all that is left of" in text and "the most frequent of" in text


def test_verification_gate_has_every_prompt(spark, few_parts):
    from foldwise.plans import load
    path, con, compare = few_parts
    queries, sql = load()
    d = queries["verification_gate"](spark, path)
    assert compare(d, con, sql["verification_gate"]) is None
    got = {(r.category, r.drop_reason): r.n for r in d.groupBy("category", "drop_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    named = [i for i in range(40) if i % 17 and i % 9 != 8]
    assert sum(n for (c, _), n in got.items() if c == "cipher") == len(named) and got["cipher", "unsolved"] == sum(i % 9 == 0 for i in named)
    assert got["cipher", "answer_mismatch"] > 0 and got["cipher", None] > 0 and got[None, "unclassified"] == 80 + 40 - len(named)
    assert sum(got.values()) == 240
