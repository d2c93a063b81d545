"""Every registered query with SQL equals DuckDB at the smallest scale."""

import oracle
import pytest

from foldwise.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["cipher_solve", "corpus_funnel_cipher", "file_fingerprint"])
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
