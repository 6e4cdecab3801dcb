"""Every core query with SQL against DuckDB over sf0.001; the others give rows."""

import pytest
from oracle import compare

from voltlake.plans.catalogue import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    ok, why = compare(spark, D, QUERIES[name], SQL[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0
