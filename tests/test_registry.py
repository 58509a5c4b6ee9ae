"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from boardsieve.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
# Both build the responses of all 17 boards, which takes minutes.
SLOW = {"union_sources", "scan_landed"}
CHECKED = sorted(set(registry.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).map(str).values.tolist()))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"scan_landed"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, database, name):
    found = registry.queries()[name](spark, FOLDER).toPandas()
    expected = database.sql(registry.oracle_sql()[name]).df()
    assert _rows(found) == _rows(expected)
