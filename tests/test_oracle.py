"""Every registered query against its DuckDB oracle at sf0.01 (exact values),
and the driver contract of __spark_entry__."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"
NAMES = sorted(set(E.queries()) - set(E.LLM_QUERIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] in ("ok", "no-oracle"), r


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) - set(E.LLM_ORACLES) == set(NAMES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "trend" in df.columns and "providerName" in df.columns
