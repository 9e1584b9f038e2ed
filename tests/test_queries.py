"""Every registered log query against its DuckDB SQL, and the folds against plain Python."""

import duckdb
import pytest

import __spark_entry__
from tideline.plans import client_queries, state_queries, stream_queries, stream_time_queries

SQL = {**stream_queries.ORACLES, **state_queries.ORACLES, **stream_time_queries.ORACLES, **client_queries.ORACLES}
ALL = {**stream_queries.QUERIES, **state_queries.QUERIES, **stream_time_queries.QUERIES, **client_queries.QUERIES}


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return f"{x:.6f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, db, name):
    got = ALL[name](spark, sf)
    r = db.execute(SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted([cell(row[columns.index(c)]) for c in order] for row in r.fetchall())
    mine = sorted([cell(row[c]) for c in order] for row in got.collect())
    assert mine == want


def test_entry(spark):
    rows = {r["segment_id"]: r for r in __spark_entry__.entry(spark).collect()}
    assert rows and set(rows) <= {0, 1, 4294967298, 4294967299, 8589934596}


def test_golden_sizes(spark, sf):
    got = {r["segment_id"]: (r["n"], r["bytes"]) for r in ALL["segment_sizes"](spark, sf).collect()}
    assert got == {0: (61, 1029), 1: (557, 9414), 4294967298: (42, 707), 4294967299: (55, 928), 8589934596: (285, 4824)}


def test_compare_and_set(spark, sf):
    rows = ALL["attr_cas"](spark, sf).orderBy("user_id", "event_id").collect()
    raw = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    state, before, want = {}, {}, {}
    for r in raw:
        u, e, n = r["user_id"], r["event_id"], int(r["value"] // 1)
        wish = None if e % 5 == 0 else -1 if e % 3 == 0 else before.get(u)
        before[u] = n
        ok = wish is None or (u in state and state[u] == wish)
        if ok:
            state[u] = n
        want[e] = (ok, state.get(u))
    assert {r["event_id"]: (r["ok"], r["current"]) for r in rows} == want and any(not w[0] for w in want.values())


def test_conditional_append(spark, sf):
    from tideline.sources.events import events_log

    size, want = {}, {}
    for r in events_log(spark, sf).orderBy("event_id").collect():
        s = size.get(r["segment_id"], 0)
        ok = r["event_id"] % 4 == 0 or r["offset"] == s
        size[r["segment_id"]] = s + (r["len"] if ok else 0)
        want[r["event_id"]] = (ok, size[r["segment_id"]])
    assert {r["event_id"]: (r["accepted"], r["size"]) for r in ALL["conditional_append"](spark, sf).collect()} == want


def test_state_fold(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    state, last, want = {}, {}, {}
    for r in raw:
        u, e, v = r["user_id"], r["event_id"], int(r["value"] // 1)
        wish = e - 1 if e % 9 == 0 else None
        if e % 400 == 0:
            state[u], ok = v, True
        elif u not in state or (wish is not None and wish != last[u]):
            ok = False
        else:
            state[u], ok = state[u] + v, True
        if ok:
            last[u] = e
        want[e] = (ok, state.get(u))
    assert {r["revision"]: (r["applied"], r["state"]) for r in ALL["state_fold"](spark, sf).collect()} == want


def test_watermarks_rise_and_cover(spark, sf):
    rows = ALL["wm_emit"](spark, sf).collect()
    days = sorted({r["day"] for r in rows})
    lows = [next(r["lower"] for r in rows if r["day"] == d) for d in days]
    assert len(days) > 2 and lows == sorted(set(lows))
    windows = ALL["wm_reader_window"](spark, sf).orderBy("step").collect()
    lows = [r["lower"] for r in windows if r["lower"] is not None]
    assert lows == sorted(lows) and lows


def test_unmuted(spark):
    from tideline.operators import rates

    rows = [(1, 0, "up"), (1, 300, "down"), (1, 601, "down"), (1, 700, "up"), (1, 1500, "down"), (1, 1600, "up"), (2, 5, "down")]
    got = rates.unmuted(spark.createDataFrame(rows, "segment_id long, at long, kind string")).collect()
    assert sorted((r["segment_id"], r["at"], r["kind"]) for r in got) == [(1, 0, "up"), (1, 601, "down"), (1, 700, "up"), (1, 1500, "down"), (1, 1600, "up"), (2, 5, "down")]


def test_conditional_table(spark):
    from tideline.operators import kv

    rows = [(1, 0, "a", "insert", 1.0, None), (1, 1, "a", "insert", 1.0, None), (1, 2, "a", "put", 1.0, 9), (1, 3, "a", "put", 1.0, 1), (1, 4, "b", "put", 1.0, 1), (1, 5, "b", "remove", None, None), (1, 6, "a", "remove", None, None), (1, 6, "b", "put", 1.0, None), (1, 7, "a", "put", 1.0, 1), (1, 7, "c", "put", 1.0, None)]
    u = spark.createDataFrame(rows, "pk long, batch long, sk string, kind string, value double, expected long")
    got = [r["results"] for r in kv.conditional(u, "pk long, batch long, results array<string>, live long, version long").orderBy("batch").collect()]
    assert got == [["Ok"], ["BadKeyVersion"], ["BadKeyVersion"], ["Ok"], ["NoSuchKey"], ["Ok"], ["MixedBatch", "MixedBatch"], ["BadKeyVersion", "Aborted"]]


def test_segment_source_and_sink(spark, sf, tmp_path):
    from tideline.sources.batch import SegmentSource
    from tideline.sources.events import events_log
    from tideline.sources.sinks import write_log

    log = events_log(spark, sf).select("segment_id", "offset", "len", "event_id", "props")
    write_log(log, str(tmp_path / "log"))
    spark.dataSource.register(SegmentSource)
    got = spark.read.format("segments").option("path", str(tmp_path / "log")).option("ranges", "0:100:500,1:0:").load()
    want = log.where("(segment_id = 0 and offset >= 100 and offset < 500) or segment_id = 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_state_survives_batches(spark, sf):
    from tideline.streaming import pipelines

    dup = pipelines.deduplicated(pipelines.source(spark, sf), ["event_id"])
    assert pipelines.run(dup).count() == 1000


def test_illegal_moves(spark):
    from tideline.sources.catalog import illegal_moves

    rows = [("s", "ACTIVE", "SCALING"), ("s", "SCALING", "ACTIVE"), ("s", "ACTIVE", "ACTIVE"), ("s", "SEALED", "ACTIVE"), ("s", "CREATING", "SEALING")]
    got = illegal_moves(spark.createDataFrame(rows, "stream string, was string, becomes string")).collect()
    assert [(r["was"], r["becomes"]) for r in got] == [("SEALED", "ACTIVE"), ("CREATING", "SEALING")]


@pytest.mark.parametrize("name,scans", [("retention_size", 2), ("retention_time", 2), ("next_cut", 2)])
def test_written_tables_are_read_instead_of_the_log(spark, sf, name, scans):
    plan = ALL[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.split("== Physical Plan ==")[1].count("events.parquet") <= scans


def test_full_cut_validity(spark, sf):
    rows = {r["cut_id"]: r["valid"] for r in ALL["cut_fully_valid"](spark, sf).collect()}
    assert len(rows) == 120 and all(rows[k] for k in rows if k % 4 == 0) and not any(rows[k] for k in rows if k % 4 == 1)
