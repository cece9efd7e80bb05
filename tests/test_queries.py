from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from claimloom.plans import registry
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
