"""Writes, marks, state and keys of clients, on cases that their queries don't hold."""

from pyspark.sql import functions as F
from test_queries import ALL

from tideline import model
from tideline.functions import codecs, hashing
from tideline.operators import epochs, rates, watermarks
from tideline.sources import sinks
from tideline.streaming import pipelines, state


def test_batches_are_all_or_nothing(spark):
    rows = [("a", 1, 10, 0), ("a", 1, 10, 1), ("a", 2, 30, 0), ("b", 1, 15, 0), ("b", 1, 15, 0), ("c", 1, None, 0), ("c", 1, 1, 0), (None, 1, 1, 0)]
    got = sinks.batches(spark.createDataFrame(rows, "k string, batch int, len int, epoch int"), "k", "batch", "len", 20, 25).collect()
    assert sorted((r["k"] or "", r["batch"], r["result"], r["epoch"]) for r in got) == [
        ("", 1, "NoKey", 0), ("a", 1, "Ok", 1), ("a", 1, "Ok", 1), ("a", 2, "EventTooLarge", 0), ("b", 1, "BatchTooLarge", 0), ("b", 1, "BatchTooLarge", 0), ("c", 1, "NoEvent", 0), ("c", 1, "NoEvent", 0),
    ]


def test_a_replayed_batch_overwrites_itself(spark, sf, tmp_path):
    path = str(tmp_path / "sink")
    write = sinks.idempotent_batch(path, model.epochs(spark))
    part = spark.createDataFrame([(k, 0.1 * k, 0) for k in range(9)], "event_id long, frac double, epoch int")
    for number in (0, 1, 1):
        write(part.where(F.col("event_id") % 2 == number), number)
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == list(range(9))


def test_long_transactions_are_spread(spark):
    df = spark.createDataFrame([(6500, 65000, 595000), (100, 900, 4999), (100, 901, 5000), (7, 90, 0)], "n int, size int, life int")
    got = df.select(rates.contribution(F.col("n"), F.col("size"), F.col("life"), "events"), rates.contribution(F.col("n"), F.col("size"), F.col("life"), "bytes")).collect()
    assert [tuple(r) for r in got] == [(54, 546), (100, 900), (100, 901), (7, 90)]


def test_one_controller_wins(spark):
    rows = [("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("s", 4, None), ("s", 5, 2), ("t", 9, 3)]
    got = watermarks.appended_marks(spark.createDataFrame(rows, "stream string, seq long, expected long")).orderBy("stream", "seq").collect()
    assert [tuple(r)[2:] for r in got] == [(True, 1, 0), (False, 1, 0), (True, 2, 1), (True, 3, 2), (False, 3, 2), (False, 0, 0)]


def test_both_controllers_write_and_fail(spark, sf):
    assert {r["written"] for r in ALL["wm_append"](spark, sf).collect()} == {True, False}


def test_table_keys_are_hashed_by_their_bytes(spark, sf):
    seed = hashing.string_seed(hashing.TABLE_ROUTER)
    rows = ALL["route_table_key"](spark, sf).collect()
    assert rows and all(r["frac"] == hashing.to_fraction(hashing.murmur3_128(r["pk"].encode(), seed)[0]) for r in rows)
    assert {r["segment_id"] for r in rows} == {0, 1, 2, 3} and all(r["segment_id"] / 4 < r["frac"] <= (r["segment_id"] + 1) / 4 for r in rows)


def test_merges_are_counted(spark):
    ep = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 0.5, 1.0), (1, 2, 0.0, 1.0), (2, 3, 0.0, 0.3), (2, 4, 0.3, 1.0)], model.EPOCHS)
    assert [tuple(r) for r in epochs.split_merge_counts(ep).orderBy("epoch").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 1)]


def test_no_state_without_an_init(spark):
    rows = [("a", 1, "init", 5, 1), ("a", 4, "update", 2, 1), ("b", 3, "init", 1, 1), ("b", 4, "update", 2, 2), ("b", 5, "init", 7, 3), ("b", 6, "update", 1, 4)]
    log = spark.createDataFrame(rows, "k string, revision long, kind string, value long, bytes long")
    assert [tuple(r) for r in state.restarted(log, ["k"], 2).orderBy("k").collect()] == [("a", None, None, None), ("b", 5, 8, 7)]


def test_codecs_keep_nulls(spark):
    number = codecs.custom(lambda x: x.encode()[::-1], lambda b: b[::-1].decode(), "string")
    df = spark.createDataFrame([("äb",), (None,), ("",)], "s string")
    for codec in (number, codecs.TEXT):
        assert [r[0] for r in df.select(codec.decode(codec.encode(F.col("s")))).collect()] == ["äb", None, ""]
