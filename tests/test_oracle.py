"""Every registered query against its SQL oracle (DuckDB) on sf0.001, the way
the driver checks them on sf0.01."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck_connection  # noqa: E402

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, name, entry.queries()[name], ORACLES[name], con)
    assert res["status"] == "match", res


def test_every_query_registered_returns_frame(spark):
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    df = entry.entry(spark)
    assert df.count() > 0
