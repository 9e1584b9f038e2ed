"""Queries over the whole log: against their SQL with the filters lifted that once kept them to a part of it."""

import duckdb
import pytest
from test_queries import ALL, SQL, cell

MORE = "/root/testdata/sf0.01"
LIFTED = {
    "round_robin_read": " where event_id < 2000",
    "txn_status": " where event_id < 900",
    "txn_illegal": " where event_id < 900",
    "large_event_round_trip": " where event_id < 500",
    "fetch_event": " where event_id % 100 = 0",
    "epoch_asof_event": " where event_id % 50 = 0",
}


@pytest.mark.parametrize("name", sorted(LIFTED))
def test_every_event_is_covered(spark, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{MORE}/events.parquet'")
    r = c.execute(SQL[name].replace(LIFTED[name], ""))
    order = sorted(x[0] for x in r.description)
    at = [[x[0] for x in r.description].index(k) for k in order]
    want = sorted([cell(row[k]) for k in at] for row in r.fetchall())
    got = ALL[name](spark, MORE)
    assert sorted(got.columns) == order
    assert sorted([cell(row[k]) for k in order] for row in got.collect()) == want
