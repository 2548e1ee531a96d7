"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from workload import registry

ORACLE = dict(registry.ORACLE)
WITHOUT_SQL = {
    "feature_matrix", "automl_classification", "automl_regression", "leaderboard", "stacked_ensemble", "predict",
    "feature_importance", "model_roundtrip",
}


def test_every_query_has_sql_or_is_a_model():
    assert set(registry.QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(registry.QUERIES) <= set(contract.queries())
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, db, key):
    assert differences(contract.queries()[key](spark, sf_dir), db, ORACLE[key]) == []


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["unique_values"] > 0
