"""Golden values: hashes, watermarks, segments between cuts, ranges, rates, retention."""

import random

import pytest

from tideline import model
from tideline.functions import hashing
from tideline.operators import cuts, epochs, rates, watermarks
from tideline.sources import batch

VECTORS = {
    "": (4448956735870400463, 0.24117842791623523), "a": (-1044246655373090880, 0.9433912753816884), "key": (-2860917593966022649, 0.8449093464660018),
    "user-1": (4046898853996268721, 0.21938282646659246), "user-2": (-4257599811153515029, 0.7691950517586741), "1": (6780761970558655926, 0.36758584297933905),
    "42": (-7287983756571845501, 0.6049176089042867), "login": (1464454760643792523, 0.07938825164983676),
}


def test_router_hash():
    seed = hashing.string_seed(hashing.ROUTER)
    assert seed == 1741865571
    for key, (h, f) in VECTORS.items():
        got, _ = hashing.murmur3_128(key.encode("utf-16-le"), seed)
        assert (got - (1 << 64) if got >> 63 else got) == h and hashing.to_fraction(got) == f


def test_exact_fraction_column(spark):
    df = spark.createDataFrame([(k,) for k in VECTORS] + [(None,)], "k string")
    got = {r["k"]: r["f"] for r in df.select("k", hashing.exact_fraction("k").alias("f")).collect()}
    assert all(got[k] == f for k, (_, f) in VECTORS.items()) and (got[None] is None or got[None] != got[None])


def test_four_segments_all_get_keys(spark):
    keys = spark.createDataFrame([(str(i), 0) for i in range(20)], "k string, epoch int").withColumn("frac", hashing.exact_fraction("k"))
    four = epochs.create(spark, 4).selectExpr("0 epoch", "segment_id", "key_start", "key_end")
    n = hashing.route(keys, four).groupBy("segment_id").count().collect()
    assert len(n) == 4 and all(r["count"] > 1 for r in n)


def test_range_ends(spark):
    f = spark.createDataFrame([(0.0, 0), (0.5, 0), (0.5000001, 0), (1.0, 0)], "frac double, epoch int")
    got = [r["segment_id"] for r in hashing.route(f, model.epochs(spark)).orderBy("frac").collect()]
    assert got == [0, 0, 1, 1]


def test_consistent_bucket_moves_only_to_the_new_one():
    r = random.Random(1)
    for _ in range(300):
        h = r.getrandbits(64)
        a, b = hashing.consistent_bucket(h, 9), hashing.consistent_bucket(h, 10)
        assert b in (a, 9)


RANGES = {0: (0, 0.5), 1: (0.5, 1), 2: (0, 0.5), 3: (0.5, 1)}


@pytest.mark.parametrize("position,want", [
    ({1: 1, 2: 2}, 1), ({0: 0, 1: 1}, -1), ({1: 0, 2: 1}, -1), ({1: 1, 2: 1}, -1), ({1: 0, 2: 3}, 0), ({2: 2, 3: 3}, 1), ({1: 2, 2: 3}, 1), ({1: 1, 2: 3}, 1), ({0: 0, 3: 3}, 0), ({1: 3, 2: 0}, 0),
])
def test_position_against_mark(position, want):
    assert watermarks.compare_position(position, {1: 1, 2: 2}, RANGES) == want


def test_time_window():
    rows = [(10, 19, {0: 0, 1: 0}), (20, 29, {0: 2, 1: 0}), (30, 39, {0: 2, 1: 2}), (40, 49, {2: 0, 1: 2}), (50, 59, {2: 4, 1: 2}), (60, 69, {2: 4, 1: 4}), (70, 79, {2: 4, 3: 0}), (80, 89, {2: 6, 3: 4})]
    w = watermarks.TimeWindow([{"lower": a, "upper": b, "cut": c} for a, b, c in rows], RANGES)
    steps = [({0: 1, 1: 0}, (10, 29)), ({0: 3, 1: 0}, (20, 49)), ({0: 5, 1: 0}, (20, 49)), ({0: 6, 1: 0}, (20, 49)), ({0: 6, 1: 1}, (20, 49)), ({0: 6, 1: 3}, (30, 69)), ({2: 0, 1: 3}, (40, 69)), ({2: 4, 1: 3}, (50, 69))]
    assert [w.advance(p) for p, _ in steps] == [x for _, x in steps]


THIRD = 1 / 3
TREE = [(0, 0, THIRD), (1, THIRD, 2 * THIRD), (2, 2 * THIRD, 1), (3, 0, 0.16), (4, 0.16, THIRD), (5, THIRD, 0.5), (6, 0.5, 2 * THIRD), (7, 2 * THIRD, 0.83), (8, 0.83, 1), (9, 0, 0.5), (10, 0.5, 1)]


@pytest.mark.parametrize("cut,want", [([0, 1, 2], set(range(11))), ([0, 2, 5, 6], set(range(11)) - {1}), ([0, 5, 10], {0, 3, 4, 5, 9, 10})])
def test_segments_between(spark, cut, want):
    segments = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in TREE], "segment_id long, key_start double, key_end double")
    got = batch.segment_ranges(spark, dict.fromkeys(cut, 0), None, segments).collect()
    assert {r["segment_id"] for r in got} == want


def test_lower_bound_keeps_segments_not_reached(spark):
    segments = spark.createDataFrame([(0, 0.0, 0.2), (1, 0.2, 0.6), (2, 0.6, 1.0), (5, 0.1, 0.6)], "segment_id long, key_start double, key_end double")
    rows = lambda *cut: [(k, s, o) for k, c in enumerate(cut) for s, o in c.items()]
    get = lambda *cut: {r["segment_id"] for r in cuts.lower_bound(spark.createDataFrame(rows(*cut), model.CUT), segments).collect()}
    assert get({0: 1, 5: -1}, {0: 1, 2: 1, 5: -1}) == {0, 2, 5}
    assert get({0: 1, 5: -1}, {0: 1, 2: 1, 5: -1}, {0: 1, 1: 1, 2: 1}) == {0, 1, 2}


def test_next_cut_of_fixed_events(spark):
    log = spark.createDataFrame([(0, i * 30, 30) for i in range(10)], "segment_id long, offset long, len long")
    size = spark.createDataFrame([(0, 300)], "segment_id long, bytes long")
    links = spark.createDataFrame([], "segment_id long, successor long")
    for start, step, want in ((270, 93, 300), (60, 1 << 40, 300), (60, 30, 90), (60, 31, 120)):
        got = cuts.next_cut(spark.createDataFrame([(1, 0, start)], model.CUT), log, size, links, step).collect()
        assert [(r["segment_id"], r["offset"]) for r in got] == [(0, want)]


def test_next_cut_goes_to_both_successors(spark):
    log = spark.createDataFrame([(0, i * 30, 30) for i in range(4)], "segment_id long, offset long, len long")
    size = spark.createDataFrame([(0, 120), (1, 60), (2, 60)], "segment_id long, bytes long")
    links = spark.createDataFrame([(0, 1), (0, 2)], "segment_id long, successor long")
    one = cuts.next_cut(spark.createDataFrame([(1, 0, 60)], model.CUT), log, size, links, 80)
    assert [(r["segment_id"], r["offset"]) for r in one.collect()] == [(0, 120)]
    two = cuts.next_cut(one, log, size, links, 80).collect()
    assert sorted((r["segment_id"], r["offset"]) for r in two) == [(1, 0), (2, 0)]


def ewma(counts):
    """The fold itself: (tick, n), with silent ticks between."""
    state, last = None, None
    for t, n in counts:
        x = n / rates.TICK
        state = {m: x for m in rates.MINUTES} if state is None else {m: s * (1 - rates.ALPHAS[m]) ** (t - last) + rates.ALPHAS[m] * x for m, s in state.items()}
        last = t
    return state


def test_ewma_equals_the_fold(spark):
    r = random.Random(2)
    t, counts = 0, []
    for _ in range(60):
        t += r.randrange(1, 9)
        counts.append((t, r.randrange(1, 50)))
    df = spark.createDataFrame([(1, a, n) for a, n in counts], "segment_id long, tick long, n long")
    got, want = rates.ewma(df, ["segment_id"], t).first(), ewma(counts)
    assert all(abs(got[f"rate_{m}"] - want[m]) < 1e-9 for m in rates.MINUTES)
    steady = spark.createDataFrame([(1, k, 25) for k in range(360)], "segment_id long, tick long, n long")
    assert all(4.5 < x < 5.5 for x in rates.ewma(steady, ["segment_id"], 359).first()[1:])


def test_mark_fills_gaps():
    assert watermarks.emit([{"ts_ms": 5, "position": {0: 7}}], None, list(model.HISTORY))["cut"] == {0: 7, 1: 0}
    first = {"lower": 5, "upper": 5, "cut": {0: 7, 1: 0}}
    assert watermarks.emit([{"ts_ms": 5, "position": {0: 9}}], first, list(model.HISTORY)) is None
    later = watermarks.emit([{"ts_ms": 8, "position": {4294967298: 3}}, {"ts_ms": 6, "position": {1: 4}}], first, list(model.HISTORY))
    assert later["lower"] == 6 and later["cut"] == {4294967298: 3, 4294967299: 0, 1: 4}


def marks(spark, rows):
    df = spark.createDataFrame(rows, "writer_id int, seq long, ts_ms long, position map<long,long>")
    return [r["result"] for r in watermarks.accepted_marks(df).orderBy("writer_id", "seq").collect()]


def test_rejected_marks_leave_the_stored_one(spark):
    assert marks(spark, [(1, 1, 10, {0: 100}), (1, 2, 20, {0: 50}), (1, 3, 15, {0: 120}), (2, 1, 5, {0: 1})]) == ["SUCCESS", "INVALID_POSITION", "SUCCESS", "SUCCESS"]


def test_positions_are_held_against_each_other_by_segment(spark):
    rows = [(1, 1, 10, {0: 5, 1: 5}), (1, 2, 10, {0: 4, 1: 9}), (1, 3, 9, {0: 9, 1: 9}), (1, 4, 11, {2: 0, 1: 5}), (1, 5, 12, {0: 0, 2: 1}), (1, 6, 12, {}), (1, 7, 12, {2: 0}), (1, 8, None, {2: 9})]
    assert marks(spark, rows) == ["SUCCESS", "INVALID_POSITION", "INVALID_TIME", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "INVALID_TIME"]


E1, E2 = 1 << 32, 2 << 32
SCALES = ((0, 0, 0.0, 0.5), (0, 1, 0.5, 1.0), (1, E1 + 2, 0.0, 0.25), (1, E1 + 3, 0.25, 0.5), (1, 1, 0.5, 1.0), (2, E1 + 2, 0.0, 0.25), (2, E2 + 4, 0.25, 1.0))


@pytest.mark.parametrize("cut,want", [
    ({0: 5, 1: 5}, True), ({0: 5}, False), ({0: 5, 1: 5, E1 + 2: 1}, False), ({E1 + 2: 0, E1 + 3: 1, 1: 1}, True), ({E1 + 2: 0, 1: 1}, False),
    ({E1 + 2: 0, E1 + 3: -1, 1: 1}, True), ({E1 + 2: 0, E2 + 4: -1, 1: 1}, True), ({E1 + 2: 0, E2 + 4: 3}, True), ({0: 5, 1: 5, E1 + 3: -1}, True), ({E1 + 2: 3, E1 + 3: 4, 0: -1, 1: 3}, False),
])
def test_cuts_with_future_segments(spark, cut, want):
    rows = spark.createDataFrame([(7, s, o) for s, o in cut.items()], model.CUT)
    assert [tuple(r) for r in cuts.fully_valid(rows, SCALES).collect()] == [(7, want)]


def test_revisions_before_the_head_are_truncated(spark):
    log = spark.createDataFrame([(0, 10 * k, 10, k) for k in range(3, 9)], "segment_id long, offset long, len long, event_id long")
    heads = spark.createDataFrame([(0, 30)], "segment_id long, head long")
    assert [r["event_id"] for r in batch.read_revisions(log, 40, 70, heads).orderBy("revision").collect()] == [4, 5, 6]
    with pytest.raises(batch.TruncatedData):
        batch.read_revisions(log, 20, heads=heads)
