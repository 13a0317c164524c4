"""Every registered query against its oracle SQL, over the whole sf0.001 tables."""

from __future__ import annotations

import pytest

from checks.compare import differences, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    _, diff = differences(spark, con, SF, name)
    assert diff == []


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 25
    assert set(e.queries()) >= set(e.oracle_sql())
