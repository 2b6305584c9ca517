"""Every registered query against its SQL check at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as spark_entry  # noqa: E402
import check_queries  # noqa: E402

from claimlens.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for name in check_queries.TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf, connection, key):
    state, _, _, note = check_queries.compare(
        spark, connection, sf, key, QUERIES[key], ORACLES.get(key)
    )
    assert state in ("ok", "rows"), note


def test_entry(spark):
    rows = spark_entry.entry(spark)
    assert rows.columns == ["claim_id", "actual_label", "predicted_label", "score"]
    assert rows.count() > 0


def test_every_query_with_a_fixed_result_has_sql():
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())
    without = set(QUERIES) - set(ORACLES)
    assert not without
