"""Spaced seeds against every diagonal of every pair."""

import itertools
import random
import re

import pytest

from foldwise.llm import spaced_seeds as s
from foldwise.llm.queries import QUERIES


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c for c in low if ord(c) > 127 or not s.PUNCTUATION[ord(c)])) if w]


def brute(docs, items):
    """All diagonals of the pairs that share three words in a row; every window that passes has such."""
    out = []
    split = [(k, words(t)) for k, t in items]
    held = {g for _, w in split for g in zip(w, w[1:], w[2:])}
    docs = [x for x in docs if any(g in held for w in [words(x[1])] for g in zip(w, w[1:], w[2:]))]
    for key, text in docs:
        own = words(text)
        for k, item in split:
            best, w = None, min(s.WINDOW, len(item))
            if len(item) < s.LEAST_WORDS:
                continue
            allowed = s.SUBSTITUTED if w == s.WINDOW else 0
            for d in range(-len(item), len(own)):
                a, b = max(0, d), min(len(own), d + len(item))
                same = [own[i] == item[i - d] for i in range(a, b)]
                ok = [i for i in range(len(same) - w + 1) if sum(same[i:i + w]) >= w - allowed]
                if ok:
                    lo, hi = ok[0], ok[-1] + w
                    found = (sum(same[lo:hi]), -(a + lo), hi - lo)
                    best = max(best or found, found)
            if best:
                out.append((key, k, -best[1], best[2], best[0]))
    return sorted(out, key=str)


def test_a_mask_fits_whatever_is_substituted():
    for gone in itertools.combinations(range(s.WINDOW), s.SUBSTITUTED):
        assert any(all(m[j] == "0" or o + j not in gone for j in range(len(m))) for m in s.MASKS for o in range(s.WINDOW - len(m) + 1)), gone


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_overlaps(spark, block):
    r = random.Random(7)
    text = lambda n: [f"w{r.randint(0, 60)}" for _ in range(n)]
    items = [text(n) for n in (3, 5, 9, 12, 13, 14, 30, 80)] + [[]]
    items.append(items[6])
    docs = []
    for item in items:
        for gone in (0, 1, 2, 3, 6):
            copy = list(item)
            for k in r.sample(range(len(copy)), min(gone, len(copy))):
                copy[k] = "other"
            docs.append(" ".join(text(r.randint(0, 20)) + [w.upper() + r.choice(["", ",", ".", "!?"]) for w in copy] + ["--"] + text(r.randint(0, 20))))
        docs.append(" ".join(text(4) + item[len(item) // 2:] + text(4)))
    rows = [(k, t) for k, t in enumerate(docs)] + [(None, docs[31]), (1005, None), (1006, ""), (31, docs[31]), (31, docs[31])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS k").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (None, "q w e r t y u i o p a s d f")], "item_id long, text string")
    got = sorted(map(tuple, s.contaminated(df, bench, block_words=block).collect()), key=str)
    want = brute(rows, [(k, " ".join(x)) for k, x in enumerate(items)])
    assert got == want and len({x[0] for x in got}) > 20
    bad = {x[0] for x in want}
    clean = s.without_contaminated(df, bench, block_words=block)
    assert clean.columns == df.columns
    assert sorted((str(x.doc_id) for x in clean.collect())) == sorted(str(k) for k, _ in rows if k not in bad)
    assert s.contaminated(df, bench.limit(0)).count() == 0 and s.contaminated(df.limit(0), bench).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_spaced_seeds"](spark, sf).collect()), key=str) == brute(docs, items)
