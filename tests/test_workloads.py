"""Every registered query of the engine gives what its SQL gives."""

from __future__ import annotations

import pytest
from compare import of_spark, of_sql

from docspark import workloads


@pytest.mark.parametrize("name", sorted(workloads.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert of_spark(workloads.QUERIES[name](spark, sf_dir)) == of_sql(workloads.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(workloads.QUERIES) - set(workloads.ORACLE_SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    assert workloads.QUERIES[name](spark, sf_dir).count() > 0
