"""Every SQL-checkable plan equals its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tripwire.plans.oracle import compare

NAMES = sorted(entry.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, sf_dir, name):
    res = compare(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name])
    assert res["ok"], res
    assert "type_diff" not in res, res
