"""The catalogue against SQL at the smallest scale."""

import pytest

import oracle_check
from __spark_entry__ import entry, oracle_sql, queries
from flowsieve.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
# Many fits; and layers of fifty that 1,500 rows do not fix exactly. oracle_check.py runs them at sf0.01.
SLOW = {"grid_search", "fit_mlp", "nested_cv"}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_equals_sql(spark, con, name):
    assert oracle_check.compare(con, oracle_sql()[name], queries()[name](spark, SF)) == []


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    row = entry(spark).first()
    assert row.tn + row.fp + row.fn + row.tp == 200
