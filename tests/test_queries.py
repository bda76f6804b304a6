"""Every registered query of the main library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from skarn.plans import catalog
from tests import expected


@pytest.mark.parametrize("name", sorted(catalog.EXPECTED_SQL))
def test_query_equals_sql(spark, name):
    expected.check(spark, name, catalog.QUERIES[name], catalog.EXPECTED_SQL[name])


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 1


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.EXPECTED_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, expected.SF_DIR).count() >= 0
