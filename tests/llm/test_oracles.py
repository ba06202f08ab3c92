"""Every statement of ``ORACLE_SQL`` against its query, over the small tables."""

from __future__ import annotations

import pytest

from adpulse.llm import queries
from tests.oracle_compare import compare, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = compare(spark, duck_connection(SF), name, queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])
    assert got["ok"], got
