"""Archives: exact round trips, references, and the query against its SQL."""

import hashlib
import io

import oracle
import pyarrow as pa
import pytest

from foldwise.llm import warc as w
from foldwise.llm.queries import ORACLES, QUERIES
from foldwise.sources.tables import shared_path

BIG, OTHER = "<p>é" * 400, "<b>x</b>" * 300


def test_references_ties_and_nulls(spark):
    rows = [(1, "u", BIG), (7, None, BIG), (7, "v", BIG), (None, "w", BIG), (2, "u", "small"), (9, "u", "small"), (3, "u", None), (4, "u", ""), (5, "a b", OTHER),
            (None, None, OTHER * 2), (None, None, OTHER * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in w.archived(df).collect()), key=str)
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        to = 7 if html == BIG and k != 7 else None
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    assert w.archived(df.limit(0)).count() == 0


def test_small_archives_hold_payloads_and_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    d = w.train_dictionary(pages)
    assert len(d) > 256
    files = w.write_archives(w.with_references(pages), d, shared_path(spark, "test-warc"), archive_bytes=20_000)
    assert files.count() > 2
    got = {r.page_id: r.payload.decode() for r in w.read_archives(files).where("record_type = 'response'").collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}


@pytest.mark.parametrize("dictionary", [b"", bytes(range(256)) * 8])
def test_any_record_can_be_read_alone(dictionary):
    out = io.BytesIO()
    a = w.ArchiveWriter(out, dictionary)
    raws = [w.record(k, "http://x", bytes([k]) * 5000, hashlib.sha1(bytes([k]) * 5000).hexdigest(), None) for k in range(5)]
    at = [a.add(r) for r in raws]
    assert list(w.read_archive(pa.BufferReader(out.getvalue()), chunk=7)) == raws
    assert list(w.read_archive(pa.BufferReader(out.getvalue()), offset=at[3])) == [raws[3]]
    assert w.parse(raws[2])["payload"] == bytes([2]) * 5000
    with pytest.raises(ValueError):
        list(w.read_archive(pa.BufferReader(out.getvalue()[:-3])))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(QUERIES["op6_warc"](spark, sf), oracle.connect(sf), ORACLES["op6_warc"]) is None
