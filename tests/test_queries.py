"""Every registered query of the domain: against its SQL where there is one, else that it runs and gives rows."""

import importlib

import pytest
from conftest import same

from plumery import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_sql(spark, duck, small, name):
    same(plans.QUERIES[name](spark, small), duck, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, small, name):
    df = plans.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
