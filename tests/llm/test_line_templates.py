"""Line templates: what recurs, what varies, who keeps the first; and the query against its SQL."""

import oracle

from foldwise.llm import line_templates as t
from foldwise.llm.queries import ORACLES, QUERIES


def kept(df, **options):
    return sorted(((x.row.doc_id, x.kept, x.n_dropped) for x in t.drop_recurring_lines(df, **options).collect()), key=str)


def test_variable_fields_are_generalised(spark):
    names = ["ann", "bob", "cleo", "dan"]
    rows = [(k, f"own line of words number {w} here\nthe user called {w} signed in from page {k} today\nshort one") for k, w in enumerate(names)]
    rows += [(9, "the user called zed went out to buy some bread today\nuser x\n\nuser"), (10, None), (11, ""), (None, "alone but for this line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS gone").repartition(3)
    got = kept(df)
    assert got == sorted([(0, rows[0][1], 0), *[(k, "short one", 2) for k in (1, 2, 3)], (9, rows[4][1], 0), (10, "", 0), (11, "", 0), (None, rows[7][1], 0)], key=str)


def test_repeats_inside_a_document_and_ties(spark):
    line = "the very same footer line again"
    rows = [(1, f"{line}\n{line}\nx"), (1, f"{line}\n{line}\nx"), (2, f"{line}\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == sorted([(k, x, 0) for k, x in rows], key=str)  # two documents only
    more = df.union(spark.createDataFrame([(None, f"z\n{line}"), (None, f"{line}\r\nz")], "doc_id long, text string"))
    assert kept(more) == sorted([*[(1, rows[0][1], 0)] * 2, (2, "y", 1), (None, "z", 1), (None, "z", 1)], key=str)
    assert kept(df.limit(0)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(QUERIES["op8_line_templates"](spark, sf), oracle.connect(sf), ORACLES["op8_line_templates"]) is None


def test_a_long_line_recurs_in_two_documents(spark):
    passage = " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(55))
    rows = [(1, f"a\n{passage} 17"), (2, f"b\n{passage} 18"), (3, f"c\n{passage[60:]} other"), (4, "d\nsix words that two documents share"), (5, "e\nsix words that two documents share")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(df) == sorted([rows[0] + (0,), (2, "b", 1), *[r + (0,) for r in rows[2:]]], key=str)
    assert kept(df, pair_tokens=None) == sorted([r + (0,) for r in rows], key=str)


def test_exact_repeats_of_any_tokens(spark):
    rows = [(i, f"own{chr(97 + i)} text\n\nAll rights reserved.\n12 03 2020 10:30 5 comments\n12 03 2020 10:30 {i} views") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(0, rows[0][1], 0), *[(i, f"own{chr(97 + i)} text\n\n12 03 2020 10:30 {i} views", 2) for i in range(1, 12)]]
    assert kept(df) == sorted(want, key=str)
    assert kept(df, exact_docs=13) == sorted([(*r, 0) for r in rows], key=str)


def test_wide_leaves_are_parsed_by_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert kept(docs, leaf_lines=2) == kept(docs)


def test_long_texts_and_text_keys(spark):
    same = "one footer of five words"
    rows = [("b", "word " * 300_000 + "end"), ("a", "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26)} of its own{chr(97 + k % 7)}" for k in range(600)) + f"\n{same}"),
            ("c", f"{same}\nx"), (None, f"{same}\ny"), ("d", "\n\n"), ("d", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    got = {(x.row.doc_id, x.n_lines): (x.n_dropped, x.kept) for x in t.drop_recurring_lines(df).collect()}
    assert got[("b", 1)] == (0, rows[0][1]) and got[("a", 601)][0] == 0 and got[("c", 2)] == (1, "x") and got[(None, 2)] == (1, "y")
    assert got[("d", 3)] == (0, "\n\n") and got[("d", 1)] == (0, "")
