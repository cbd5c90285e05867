"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

import pytest

from snapforge.plans.catalog import oracle_sql, queries
from snapforge.plans.compare import compare

from conftest import SF_SMALL

QUERIES = sorted(queries())
ORACLES = oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.startswith("OK") or res.startswith("rows-only"), res
