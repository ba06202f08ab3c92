"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from adpulse.plans.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_connection

# Jobs that write a whole warehouse are covered by test_pipeline.py.
JOBS = {"backfill_range", "incremental_checked", "warehouse_inventory"}


def _names():
    return [n for n in QUERIES if n not in JOBS]


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    r = compare(spark, con, name, queries()[name](spark, SF_SMALL), oracle_sql()[name])
    assert r["ok"], r


def test_every_query_has_an_oracle():
    from __spark_entry__ import oracle_sql, queries
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


def test_a_replace_that_does_nothing_is_seen(spark, con, monkeypatch):
    from __spark_entry__ import oracle_sql
    from adpulse.plans import pipeline
    monkeypatch.setattr(pipeline, "ingest_bronze_dates", lambda *a: True)
    for name in ("incremental_replace", "incremental_events"):
        assert not compare(spark, con, name, QUERIES[name](spark, SF_SMALL), oracle_sql()[name])["ok"], name


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    out = entry(spark)
    assert out.count() > 0 and "avg_roas" in out.columns
