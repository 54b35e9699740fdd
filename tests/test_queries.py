"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from papyra.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.9g}" if isinstance(v, (int, float)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    found = catalog.QUERIES[name](spark, D)
    want = db.sql(catalog.ORACLES[name])
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_ledgers_of_events_without_user_or_time(spark, db, tmp_path):
    """entries without user, time or id are edited and counted in their chains like all others."""
    gaps = "CASE WHEN event_id % 9 <> 4 THEN user_id END AS user_id, CASE WHEN event_id % 100 <> 53 THEN ts END AS ts, CASE WHEN event_id % 7 <> 1 THEN event_id END AS event_id"
    db.execute(f"COPY (SELECT * REPLACE ({gaps}) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = catalog.ORACLES["ledger_partitioned"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    found, want = catalog.QUERIES["ledger_partitioned"](spark, str(tmp_path)), db.sql(sql)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())
