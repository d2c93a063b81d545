"""Separator scans of flat files."""

import numpy as np
import oracle
import pytest

from foldwise.llm import separators as s
from foldwise.llm.queries import ORACLES, QUERIES


def plain(ids, ends):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x in ends:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, block, width):
    r = np.random.default_rng(block)
    files = [r.integers(0, 4, n).tolist() for n in (0, 1, 5, 64)] + [[9] * 40, [0, 0, 0], [1] * 7 + [0]]
    rows = []
    for k, ids in enumerate(files):
        (tmp_path / str(k)).write_bytes(np.array(ids, f"<u{width}").tobytes())
        rows.append((str(tmp_path / str(k)), len(ids)))
    df = spark.createDataFrame(rows, "path string, n_ids long")
    for ends in ((0,), (0, 2)):
        got = sorted((int(x.path[-1]), x.place, x.start, x.n_tokens, x.ended) for x in s.scan_separators(df, ends, width, block).collect())
        assert got == [(k, i, *x) for k, ids in enumerate(files) for i, x in enumerate(plain(ids, ends))]


def test_counts_of_odd_texts(spark):
    rows = [(1, "a b  c"), (None, "x\ty"), (1, "a b  c"), (2, ""), (3, None), (4, "w " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS n_tokens")
    got = sorted((str(x.doc_id), x.n_tokens) for x in s.token_counts(df, block=11).collect())
    assert got == [("1", 3), ("1", 3), ("2", 0), ("3", 0), ("4", 5000), ("None", 2)]
    assert s.token_counts(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(QUERIES["op1_separator_scan"](spark, sf), oracle.connect(sf), ORACLES["op1_separator_scan"]) is None
