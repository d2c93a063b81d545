"""The pipeline against its stages done plainly, one after the other."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
from test_partenum import brute as similar
from test_spaced_seeds import brute as overlaps

from foldwise.llm.queries import ORACLES, vocabulary

SF = "/root/testdata/sf0.001"


def plainly(rows, items):
    from tokenizers import Tokenizer
    con = duckdb.connect()
    docs = lambda r: pa.table({"doc_id": pa.array([k for k, _ in r], pa.int64()), "text": pa.array([t for _, t in r], pa.string())})
    con.register("documents", docs(rows))
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLES['op7_quality_rules']}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in good]
    con.unregister("documents")
    con.register("documents", docs(rows))
    sql = ORACLES["op8_line_templates"].replace("md5(array_to_string(coalesce(kept, []), chr(10))) AS kept_md5", "array_to_string(coalesce(kept, []), chr(10)) AS kept")
    rows = [(k, t) for k, n, t in con.sql(f"SELECT doc_id, n_dropped, kept FROM ({sql})").fetchall() if not n or t.split()]
    rows = [r for r in rows if r[0] in {k for k, _, c in similar(rows) if k == c}]
    bad = {x[0] for x in overlaps(rows, items)}
    t, out = Tokenizer.from_file(vocabulary()), []
    for k, text in rows:
        if k not in bad:
            ids = t.encode(text, add_special_tokens=False).ids
            out.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                        hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_run_equals_plain_stages(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    want = plainly(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = "une phrase tout à fait ordinaire avec des mots et encore des mots " * 3
    text = " ".join(f"{w}{k % 7}" if k % 11 == 0 else w for k, w in enumerate(docs.where("length(text) > 900").first().text.split()))
    rows = [(1, text, None, None, None), (1, text, "en", "s", 3), (None, text, None, "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (4, long, "fr", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "1 AS row", "2 AS n_words", "3 AS k", "4 AS class", "5 AS gone", "6 AS th")
    odd = spark.createDataFrame(odd.collect(), odd.schema).coalesce(1)
    for frame, most in ((odd, 6), (odd.limit(0), 0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            assert out.count() <= most, name
            if name != "tokens":
                assert out.columns == frame.columns, name
                now = spark.createDataFrame(out.collect(), out.schema).coalesce(1)
        if most:
            assert [r.doc_id for r in now.select("doc_id").collect()] == [1]
