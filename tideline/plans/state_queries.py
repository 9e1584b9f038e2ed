"""Queries over attributes, key-value tables, watermarks, retention, rates, transactions and reader groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import model
from tideline.operators import attributes as A
from tideline.operators import cuts as C
from tideline.operators import epochs as E
from tideline.operators import groups as G
from tideline.operators import kv as K
from tideline.operators import rates as R
from tideline.operators import retention as T
from tideline.operators import transactions as X
from tideline.operators import watermarks as W
from tideline.plans.sql import CUTS, EVENTS
from tideline.plans.stream_queries import daily_cuts, sizes
from tideline.scratch import saved
from tideline.sources.events import events, events_log, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# attributes


@query("with " + EVENTS + "select segment_id, cast(sum(len) as bigint) value from lg group by segment_id")
def attr_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return A.accumulate(events(spark, d), ["segment_id"], "len")


@query("select user_id, event_type, arg_max(value, event_id) as value from events group by all")
def attr_replace(spark, d):
    return A.replace(read(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


@query("""with p as (select user_id, value, max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) m from events)
select user_id, max(value) as value, count(*) filter (value <= m) rejected from p group by user_id""")
def attr_max_rejects(spark, d):
    return A.replace_if_greater(read(spark, d, "events"), ["user_id"], "value", "event_id")


@query("select user_id, arg_min(value, event_id) as value, count(*) - 1 rejected from events group by user_id")
def attr_set_once(spark, d):
    return A.set_once(read(spark, d, "events"), ["user_id"], "value", "event_id")


@query()
def attr_cas(spark, d):
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.floor("value").cast("long")
    wish = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.lag(n).over(w)).cast("long")
    log = e.select("user_id", "event_id", n.alias("value"), wish.alias("expected"))
    return A.compare_and_set(log, ["user_id"], "value", "expected", "event_id", "user_id long, event_id long, ok boolean, current long")


@query()
def conditional_append(spark, d):
    e = events_log(spark, d)
    wish = F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("offset")).cast("long")
    return A.conditional_appends(e.withColumn("expected", wish), ["segment_id"], "event_id", "len", "expected")


@query("""with s as (select event_id, event_id seen, user_id % 4 w, case when event_id % 10 = 9 then event_id - 20 else event_id end no from events),
p as (select *, max(no) over (partition by w order by seen rows between unbounded preceding and 1 preceding) m from s)
select event_id, no from p where m is null or no > m""")
def writer_dedup(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_id").alias("at"), (F.col("user_id") % 4).alias("w"), F.when(F.col("event_id") % 10 == 9, F.col("event_id") - 20).otherwise(F.col("event_id")).alias("no"))
    return A.first_by_number(e, "w", "no", "at").select("event_id", "no")


@query("select event_id, octet_length(encode(props)) n_bytes, props from events")
def large_event_round_trip(spark, d):
    """Events cut into slices of 4 bytes and put together again."""
    from tideline.sources.sinks import reassemble, slices

    e = read(spark, d, "events").select("event_id", F.col("props").cast("binary").alias("payload"))
    back = reassemble(slices(e, "event_id", "payload", 4), "event_id", "payload")
    return back.select("event_id", F.octet_length("payload").alias("n_bytes"), F.col("payload").cast("string").alias("props"))


# key-value tables


def kv_log(spark, d):
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("pk"), F.col("event_type").alias("sk"), "value", F.col("event_id").alias("version"), ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("is_delete"))


_KV = """kv as (select cast(user_id as varchar) pk, event_type sk, value, event_id as version, event_type = 'error' and event_id % 2 = 0 is_delete from events),
lt as (select pk, sk, arg_max(value, version) as value, max(version) as version, arg_max(is_delete, version) del from kv group by pk, sk), live as (select pk, sk, value, version from lt where not del)"""


@query(f"with {_KV} select * from live")
def kv_latest(spark, d):
    return K.latest(kv_log(spark, d))


@query(f"with {_KV} select * from live where sk between 'error' and 'purchase'")
def kv_range_scan(spark, d):
    return K.in_range(K.latest(kv_log(spark, d)), None, "error", "purchase")


@query(f"with {_KV} select * from live where starts_with(pk, '1')")
def kv_prefix_scan(spark, d):
    return K.with_prefix(K.latest(kv_log(spark, d)), "1", "pk")


@query(f"with {_KV}, k as (select i as place, cast(i * 3 as varchar) pk, 'click' sk from (select unnest(range(0, 100)) i)) select place, k.pk, k.sk, value, version from k left join live on live.pk = k.pk and live.sk = k.sk")
def kv_multi_get(spark, d):
    keys = spark.range(100).select(F.col("id").alias("place"), (F.col("id") * 3).cast("string").alias("pk"), F.lit("click").alias("sk"))
    return K.multi_get(K.latest(kv_log(spark, d)), keys)


@query(f"with {_KV} select * from live where (pk, sk) > ('1', 'click') order by pk, sk limit 10")
def kv_page(spark, d):
    return K.page(K.latest(kv_log(spark, d)), ("1", "click"), 10)


@query(f"with {_KV}, x as (select pk, sk, arg_max(value, version) as v, max(version) as version, arg_max(is_delete, version) is_delete from kv where version >= 700 group by pk, sk) select pk, sk, case when is_delete then null else v end as value, version, is_delete, true should_clear from x")
def kv_delta(spark, d):
    return K.delta(kv_log(spark, d), 700, head=800)


@query(f"with {_KV}, n as (select pk, sk, count(*) n from kv group by pk, sk) select pk, cast(sum(n) as bigint) total, count(*) as \"unique\", cast(round(100 * count(*) / sum(n)) as integer) percent from n group by pk")
def kv_compaction_stats(spark, d):
    return K.utilisation(kv_log(spark, d), ["pk"])


@query(f"with {_KV}, low as (select pk from (select pk, sk, count(*) n from kv group by pk, sk) group by pk having cast(round(100 * count(*) / sum(n)) as integer) < 75) select pk, sk, value, version, is_delete from kv where pk not in (select pk from low) union all select *, false from live where pk in (select pk from low)")
def kv_compaction(spark, d):
    return K.compact(kv_log(spark, d))


@query()
def kv_conditional(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "remove").when(F.col("event_id") % 3 == 0, "insert").otherwise("put")
    wish = F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long") % 40)
    u = e.select(F.col("user_id").alias("pk"), F.floor(F.col("event_id") / 500).alias("batch"), F.col("event_type").alias("sk"), kind.alias("kind"), F.col("value"), wish.alias("expected"))
    return K.conditional(u, "pk long, batch long, results array<string>, live long, version long")


# watermarks


def marks(spark, d):
    return read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 4).cast("int").alias("writer_id")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts_ms"), F.max("event_id").alias("pos"))


_MARKS = "mk as (select cast(ts as date) as \"day\", cast(user_id % 4 as integer) writer_id, max((epoch_us(ts) // 1000)) ts_ms, max(event_id) pos from events group by all), rd as (select \"day\", min(ts_ms) lower, max(ts_ms) upper, count(*) writers from mk group by \"day\")"


@query(f"with {_MARKS} select * from rd")
def wm_min_over_writers(spark, d):
    return W.bounds(marks(spark, d), "day")


@query(f"with {_MARKS}, s as (select *, case when day_of_year % 5 = 0 then lower - 200000000 else lower end l from (select *, dayofyear(\"day\") day_of_year from rd)), p as (select *, max(l) over (order by \"day\" rows between unbounded preceding and 1 preceding) m from s) select \"day\", l lower, upper, writers from p where m is null or l > m")
def wm_monotone(spark, d):
    late = F.when(F.dayofyear("day") % 5 == 0, F.col("lower") - 200000000).otherwise(F.col("lower"))
    return W.strictly_rising(W.bounds(marks(spark, d), "day").withColumn("lower", late), "day")


@query("""with recursive s as (select cast(user_id % 4 as integer) writer_id, event_id seq, (epoch_us(ts) // 1000) - case when event_id % 11 = 0 then 3600000 else 0 end ts_ms, user_id % 3 segment, event_id - case when event_id % 13 = 0 then 50 else 0 end pos,
  row_number() over (partition by user_id % 4 order by event_id) rn from events),
r as (select writer_id, seq, rn, 'SUCCESS' result, ts_ms kept, segment seg, pos o from s where rn = 1
union all select writer_id, seq, rn, result, case when result = 'SUCCESS' then ts_ms else kept end, case when result = 'SUCCESS' then segment else seg end, case when result = 'SUCCESS' then pos else o end from (
  select s.*, r.kept, r.seg, r.o, case when s.ts_ms < r.kept then 'INVALID_TIME' when s.segment = r.seg and s.pos < r.o then 'INVALID_POSITION' else 'SUCCESS' end result from r join s on s.writer_id = r.writer_id and s.rn = r.rn + 1))
select writer_id, seq, ts_ms, segment, pos, result from r join s using (writer_id, seq)""")
def wm_note_mark(spark, d):
    e = read(spark, d, "events")
    ts = F.unix_millis(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 11 == 0, 3600000).otherwise(0)
    segment, pos = F.col("user_id").cast("long") % 3, F.col("event_id") - F.when(F.col("event_id") % 13 == 0, 50).otherwise(0)
    m = e.select((F.col("user_id") % 4).cast("int").alias("writer_id"), F.col("event_id").alias("seq"), ts.alias("ts_ms"), F.create_map(segment, pos).alias("position"))
    return W.accepted_marks(m).select("writer_id", "seq", "ts_ms", F.map_keys("position")[0].alias("segment"), F.map_values("position")[0].alias("pos"), "result")


@query("""with m as (select event_type stream, user_id writer_id, max((epoch_us(ts) // 1000)) ts_ms, user_id % 3 > 0 alive, max((epoch_us(ts) // 1000)) + 5 reported_at from events group by all),
p as (select stream, quantile_disc(ts_ms, 0.5) lower from m where stream <> 'view' group by stream),
j as (select m.stream, lower is null or ts_ms > lower p, alive and 1706745600000 - reported_at < 259200000 keep from m left join p using (stream))
select stream, count(*) filter (p or keep) active, count(*) filter (p) participating, case when count(*) filter (p or keep) = 0 then 'stop' when count(*) filter (p) < count(*) filter (p or keep) then 'wait' else 'emit' end decision from j group by stream""")
def wm_gate(spark, d):
    ts = F.max(F.unix_millis(F.col("ts").cast("timestamp")))
    m = read(spark, d, "events").groupBy(F.col("event_type").alias("stream"), F.col("user_id").alias("writer_id")).agg(ts.alias("ts_ms")).withColumn("alive", F.col("writer_id") % 3 > 0).withColumn("reported_at", F.col("ts_ms") + 5)
    previous = m.where("stream <> 'view'").groupBy("stream").agg(F.expr("percentile_disc(0.5) within group (order by ts_ms)").cast("long").alias("lower"))
    return W.gate(m, previous, 1706745600000, 259200000)


@query()
def wm_emit(spark, d):
    """The watermark of each day, from writers' positions; days and positions are metadata."""
    log = events_log(spark, d)
    day, writer = F.col("ts").cast("date"), F.col("writer_id")
    pos = log.groupBy(day.alias("day"), writer, "segment_id").agg(F.max(F.col("offset") + F.col("len")).alias("o"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("t"))
    rows = pos.groupBy("day", "writer_id").agg(F.max("t").alias("ts_ms"), F.map_from_entries(F.collect_list(F.struct("segment_id", "o"))).alias("position")).orderBy("day", "writer_id").collect()
    previous, out = None, []
    for day in sorted({r["day"] for r in rows}):
        mark = W.emit([r.asDict() for r in rows if r["day"] == day], previous, list(model.HISTORY))
        if mark:
            previous = mark
            out += [(day, mark["lower"], mark["upper"], s, o) for s, o in sorted(mark["cut"].items())]
    return spark.createDataFrame(out, "day date, lower long, upper long, segment_id long, offset long")


@query()
def wm_reader_window(spark, d):
    """The time window of a reader that follows the daily cuts half a day behind."""
    mark_rows = wm_emit(spark, d).collect()
    by_day: dict = {}
    for r in mark_rows:
        by_day.setdefault(r["day"], {"lower": r["lower"], "upper": r["upper"], "cut": {}})["cut"][r["segment_id"]] = r["offset"]
    ranges = {s: (a, b) for _, s, a, b in model.HISTORY}
    window = W.TimeWindow([by_day[k] for k in sorted(by_day)], ranges)
    cuts: dict = {}
    for r in daily_cuts(spark, d).collect():
        cuts.setdefault(r["cut_id"], {})[r["segment_id"]] = r["offset"] // 2 if r["cut_id"] < 3 else r["offset"]
    out = [(k, *window.advance(cuts[k])) for k in sorted(cuts)]
    return spark.createDataFrame(out, "step long, lower long, upper long")


# retention


def recordings(spark, d):
    """cut_id, time (days), size: bytes before each daily cut."""
    log = events_log(spark, d)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    by_day = log.groupBy(day.alias("cut_id")).agg(F.sum("len").alias("n"))
    every = spark.range(30).select(F.col("id").alias("cut_id")).join(by_day, "cut_id", "left")
    return every.select("cut_id", F.col("cut_id").alias("time"), F.coalesce(F.sum("n").over(Window.orderBy("cut_id")), F.lit(0)).alias("size"))


_REC = ", rec as (select cut_id, cut_id as time, cast(coalesce((select sum(len) from lg where date_diff('day', date '2024-01-01', cast(ts as date)) <= cut_id), 0) as bigint) size from (select unnest(range(0, 30)) cut_id))"


@query("with " + EVENTS + _REC + "select * from rec")
def retention_cuts(spark, d):
    return recordings(spark, d)


def _retention_set(spark, d, bounds: list[int]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The recordings, and by bound the orders of each recorded cut to it.  Both are metadata: they are worked out once and written."""
    rec = saved(recordings(spark, d))
    cuts, s = saved(daily_cuts(spark, d)), model.segments(spark)
    b = F.explode(F.array(*(F.lit(k).cast("long") for k in bounds)))
    ids = rec.select(F.col("cut_id").alias("id"), b.alias("bound"))
    pairs = ids.select(F.col("id").alias("a"), F.col("bound").alias("b")).unionByName(ids.select(F.col("bound").alias("a"), F.col("id").alias("b"))).distinct()
    order = saved(C.compare(cuts, s, pairs))
    each = {}
    for k in bounds:
        there = order.where(F.col("b") == k).select(F.col("a").alias("cut_id"), F.col("ordering").alias("record_vs_bound"))
        back = order.where(F.col("a") == k).select(F.col("b").alias("cut_id"), F.col("ordering").alias("bound_vs_record"))
        each[k] = there.join(back, "cut_id")
    return rec, each


@query("with " + EVENTS + _REC + """, t as (select max(size) total from rec), d as (select cut_id, total - size d, total from rec, t)
select 'no bound' as "case", cast(arg_min(cut_id, d) filter (d >= total / 4) as varchar) choice from d
union all select 'few left', case when arg_min(cut_id, d) filter (d >= total / 4) < 26 then cast(arg_min(cut_id, d) filter (d >= total / 4) as varchar) else '26' end from d
union all select 'between', 'LB'
union all select 'too many', case when (arg_max(d, d) filter (d >= total / 4 and d <= total / 2)) < any_value((select total - size from rec, t where cut_id = 9)) then cast(arg_max(cut_id, d) filter (d >= total / 4 and d <= total / 2) as varchar) else 'LB' end from d""")
def retention_size(spark, d):
    rec, orders = _retention_set(spark, d, [26, 20, 9])
    rows = {r["cut_id"]: r["size"] for r in rec.collect()}
    total = max(rows.values())
    least, most = -(-total // 4), total // 2
    cases = [("no bound", None, None), ("few left", 26, total - rows[26]), ("between", 20, total // 3), ("too many", 9, total - rows[9])]
    out = None
    for name, bound, left in cases:
        one = T.truncate_by_size(rec, total, least, most, left, orders.get(bound)).select(F.lit(name).alias("case"), "choice")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select * from (values ('no bound', '19'), ('early', '19'), ('middle', 'LB'), ('late', '9')) t("case", choice)""")
def retention_time(spark, d):
    rec, orders = _retention_set(spark, d, [25, 15, 2])
    out = None
    for name, bound in (("no bound", None), ("early", 25), ("middle", 15), ("late", 2)):
        one = T.truncate_by_time(rec, 29, 10, 20, orders.get(bound)).select(F.lit(name).alias("case"), "choice")
        out = one if out is None else out.unionByName(one)
    return out


@query("with " + CUTS + """, c as (select * from rc where cut_id = 14), gone as (select distinct s.segment_id from seg s, c where s.key_start < c.key_end and s.key_end > c.key_start and s.segment_id < c.segment_id)
select lg.segment_id, count(*) n, min(event_id) first_event from lg left join c using (segment_id) where lg.segment_id not in (select segment_id from gone) and lg."offset" >= coalesce(c."offset", 0) group by lg.segment_id""")
def truncate_scan(spark, d):
    cut = daily_cuts(spark, d).where("cut_id = 14").select("segment_id", "offset")
    return T.truncate(events_log(spark, d), cut, model.segments(spark)).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("with " + CUTS + """, c as (select * from rc where cut_id = 14) select distinct s.segment_id from seg s, c where s.key_start < c.key_end and s.key_end > c.key_start and s.segment_id < c.segment_id
and s.segment_id not in (select segment_id from cut where cut_id = 14)""")
def truncated_segments(spark, d):
    """What a truncation deletes: segments between the head and the cut, less those of the cut."""
    cuts, s = daily_cuts(spark, d), model.segments(spark)
    head = spark.createDataFrame([(-1, 0, 0), (-1, 1, 0)], model.CUT)
    pair = spark.createDataFrame([(-1, 14)], "a long, b long")
    got = C.between(cuts.unionByName(head), s, pair).select("segment_id")
    return got.join(cuts.where("cut_id = 14"), "segment_id", "left_anti")


# rates


def ticks(spark, d):
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * R.TICK)).cast("long")
    return events(spark, d).groupBy("segment_id", at.alias("tick")).agg(F.count("*").alias("n"))


_RATES = "tk as (select segment_id, cast(floor(epoch(ts) / 300) as bigint) tick, count(*) n from lg group by all), f as (select segment_id, min(tick) f, max(tick) m from tk group by segment_id), g as (select max(tick) g from tk), rt as (select segment_id, " + ", ".join(f"sum(n / 5 * pow(exp(-5 / 60e0 / {m}), g - tick) * case when tick = f then 1 else 1 - exp(-5 / 60e0 / {m}) end) rate_{m}" for m in R.MINUTES) + " from tk join f using (segment_id), g group by segment_id)"


@query("with " + EVENTS + ", " + _RATES + "select segment_id, " + ", ".join(f"round(rate_{m}, 6) rate_{m}" for m in R.MINUTES) + " from rt")
def ewma_rates(spark, d):
    """One tick here is five minutes of event time, since the events are sparse."""
    t = ticks(spark, d)
    last = t.agg(F.max("tick")).first()[0]
    r = R.ewma(t, ["segment_id"], last)
    return r.select("segment_id", *(F.round(f"rate_{m}", 6).alias(f"rate_{m}") for m in R.MINUTES))


@query("with " + EVENTS + ", " + _RATES + """, a as (select rt.*, (g - f) * 5 age, target from rt join f using (segment_id), g, (values (0.01e0), (0.2e0), (5e0)) v(target))
select segment_id, target, case when age <= 600 then 'none' when (rate_2 > 5 * target and age > 120) or (rate_5 > 2 * target and age > 300) or (rate_10 > target and age > 600) then 'up'
when rate_2 < target and rate_5 < target and rate_10 < target and rate_20 < target / 2 and age > 1200 then 'down' else 'none' end decision,
greatest(2, cast(trunc(greatest(rate_2, rate_5, rate_10) / target) as integer)) splits from a""")
def scale_decisions(spark, d):
    t = ticks(spark, d)
    last = t.agg(F.max("tick")).first()[0]
    r = R.ewma(t, ["segment_id"], last).join(t.groupBy("segment_id").agg(((F.lit(last) - F.min("tick")) * R.TICK).alias("age")), "segment_id")
    r = r.withColumn("target", F.explode(F.lit([0.01, 0.2, 5.0])))
    return r.select("segment_id", "target", R.decision(F.col("target"), F.col("age")).alias("decision"), R.splits(F.col("target")).alias("splits"))


@query()
def scale_unmuted(spark, d):
    e = events(spark, d).where("event_type in ('click', 'view')")
    return R.unmuted(e.select("segment_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 100).alias("at"), F.when(F.col("event_type") == "click", "up").otherwise("down").alias("kind")))


# transactions


def txns(spark, d):
    e = read(spark, d, "events")
    each = e.groupBy((F.col("event_id") % 300).alias("txn_id")).agg(F.min("event_id").alias("commit_order"), F.max("event_id").alias("ended"))
    state = F.element_at(F.array(*map(F.lit, ("COMMITTED", "COMMITTING", "ABORTED", "OPEN"))), (F.col("txn_id") % 4 + 1).cast("int"))
    return each.withColumn("epoch", (F.col("txn_id") / 100).cast("int")).withColumn("status", state)


_TX = "tx as (select event_id % 300 txn_id, min(event_id) commit_order, max(event_id) ended, cast(trunc((event_id % 300) / 100) as integer) epoch, ['COMMITTED', 'COMMITTING', 'ABORTED', 'OPEN'][event_id % 300 % 4 + 1] status from events group by all)"


@query(f"with {_TX}, t as (select txn_id, min(commit_order) commit_order, epoch from tx where status = 'COMMITTING' group by all) select txn_id, epoch, commit_order from t where epoch = (select min(epoch) from t) order by commit_order limit 100")
def txn_commit_order(spark, d):
    return X.commit_batch(txns(spark, d)).select("txn_id", "epoch", "commit_order")


@query("with " + EVENTS + f", {_TX} select lg.event_id, segment_id from lg left join tx on tx.txn_id = lg.event_id % 300 and lg.event_id % 2 = 0 where lg.event_id % 2 = 1 or status = 'COMMITTED'")
def txn_visible_rows(spark, d):
    rows = events(spark, d).withColumn("txn_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 300))
    return X.visible(rows, txns(spark, d)).select("event_id", "segment_id")


@query("with " + CUTS + f", {_TX}, e as (select txn_id, segment_id, epoch, commit_order, sum(len) bytes from (select lg.*, event_id % 300 txn_id from lg) l join (select txn_id, epoch tepoch, commit_order from tx where status = 'COMMITTED') t using (txn_id) group by txn_id, segment_id, epoch, commit_order) select 1".replace("epoch, commit_order, sum", "tepoch epoch, commit_order, sum").replace("segment_id, epoch, commit_order) select 1", "segment_id, tepoch, commit_order)") + ' select txn_id, segment_id, cast(bytes_before + coalesce(size.bytes, 0) as bigint) start, cast(e2.bytes as bigint) bytes from (select *, coalesce(sum(bytes) over (partition by segment_id order by epoch, commit_order rows between unbounded preceding and 1 preceding), 0) bytes_before from e) e2 left join size using (segment_id)')
def txn_merge_offsets(spark, d):
    rows = events(spark, d).drop("epoch").withColumn("txn_id", F.col("event_id") % 300)
    return X.merge_offsets(rows, txns(spark, d), sizes(spark, d).select("segment_id", F.col("bytes").alias("tail")))


@query(f"with {_TX} select txn_id, status, ended from tx where status in ('COMMITTED', 'ABORTED') order by ended desc, txn_id limit 50")
def txn_completed(spark, d):
    return X.completed(txns(spark, d), 50).select("txn_id", "status", "ended")


@query("""with c as (select event_id % 100 txn_id, event_id seq, ['OPEN', 'COMMITTING', 'COMMITTED', 'ABORTING'][cast(trunc(event_id / 100) as integer) % 4 + 1] status from events)
select txn_id, arg_max(status, seq) status from c group by txn_id""")
def txn_status(spark, d):
    return X.status(_changes(spark, d))


def _changes(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("OPEN", "COMMITTING", "COMMITTED", "ABORTING"))), ((F.col("event_id") / 100).cast("int") % 4 + 1).cast("int"))
    return read(spark, d, "events").select((F.col("event_id") % 100).alias("txn_id"), F.col("event_id").alias("seq"), s.alias("status"))


@query("""with c as (select event_id % 100 txn_id, event_id seq, ['OPEN', 'COMMITTING', 'COMMITTED', 'ABORTING'][cast(trunc(event_id / 100) as integer) % 4 + 1] status from events),
l as (select *, lag(status) over (partition by txn_id order by seq) p from c)
select txn_id, seq, status from l where not (coalesce(p, '') || '>' || status in ('>OPEN', 'OPEN>COMMITTING', 'OPEN>ABORTING', 'COMMITTING>COMMITTED', 'ABORTING>ABORTED'))""")
def txn_illegal(spark, d):
    return X.illegal(_changes(spark, d))


@query("""with t as (select event_id txn_id, 'OPEN' status, (epoch_us(ts) // 1000) created, (epoch_us(ts) // 1000) + (event_id % 7) * 3600000 pinged, (event_id % 5 + 1) * 60000000 lease from events)
select txn_id from t where 1706745600000 > pinged + lease or 1706745600000 > created + least(1000 * lease, 86400000)""")
def txn_expired(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    t = read(spark, d, "events").select(F.col("event_id").alias("txn_id"), F.lit("OPEN").alias("status"), ms.alias("created"), (ms + F.col("event_id") % 7 * 3600000).alias("pinged"), ((F.col("event_id") % 5 + 1) * 60000000).alias("lease"))
    return X.expired(t, 1706745600000).select("txn_id")


@query("with " + EVENTS + """select epoch, segment_id, key_start, key_end from ep union all select 3, (3::bigint << 32) | (segment_id & 4294967295), key_start, key_end from ep where epoch = 1
union all select 4, (4::bigint << 32) | (segment_id & 4294967295), key_start, key_end from ep where epoch = 2""")
def txn_rolling(spark, d):
    return X.rolling(model.epochs(spark), 1)


# reader groups


@query("with " + CUTS + """, pair as (select 10 a), x as (select s.segment_id, coalesce(c."offset", 0) f, bytes t from seg s join size using (segment_id) left join cut c on c.cut_id = 14 and c.segment_id = s.segment_id
where not exists (select 1 from rc r where r.cut_id = 14 and s.key_start < r.key_end and s.key_end > r.key_start and s.segment_id < r.segment_id)) select cast(sum(t - f) as bigint) unread from x""")
def unread_bytes(spark, d):
    tail = spark.createDataFrame([(14, None)], "a long, b long")
    return C.distance(daily_cuts(spark, d), model.segments(spark), sizes(spark, d), tail).select(F.col("bytes").alias("unread"))


@query("""with a as (select i segment_id, case when i % 5 = 4 then null else 'r' || cast((i * i) % 3 as varchar) end reader from (select unnest(range(0, 20)) i)), r as (select 'r' || cast(i as varchar) reader from (select unnest(range(0, 4)) i)),
c as (select r.reader, count(a.segment_id) segments from r left join a using (reader) group by r.reader), s as (select count(*) n, min(segments) least from c), f as (select count(*) filter (reader is null) free, count(*) total from a)
select reader, segments, cast(case when free <= 0 then 0 else greatest(free // n, least(free, round(total / n) - segments), 1) end as bigint) acquire, segments > least + greatest(1, free) as "release" from c, s, f""".replace("min(segments) least", "min(segments) low").replace("segments > least +", "segments > low +"))
def reader_assignment(spark, d):
    owner = F.when(F.col("id") % 5 == 4, None).otherwise(F.concat(F.lit("r"), (F.col("id") * F.col("id") % 3).cast("string")))
    a = spark.range(20).select(F.col("id").alias("segment_id"), owner.alias("reader"))
    return G.plan(a, spark.range(4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("reader")))


@query("""with l as (select 'r' || cast(user_id % 6 as varchar) reader, count(distinct event_type) segments, max(event_id) % 97 lag from events group by 1)
select reader, segments * greatest(lag, 1) / (select greatest(max(lag), 1) from l) size, row_number() over (order by segments * greatest(lag, 1) / (select greatest(max(lag), 1) from l) desc, reader) as rank from l""")
def reader_rank(spark, d):
    l = read(spark, d, "events").groupBy(F.concat(F.lit("r"), (F.col("user_id") % 6).cast("string")).alias("reader")).agg(F.count_distinct("event_type").alias("segments"), (F.max("event_id") % 97).alias("lag"))  # noqa: E741
    return G.ranked(l)


@query("with " + EVENTS + """, p as (select cast(event_id // 250 as bigint) n, writer_id, segment_id, max("offset" + len) o from lg group by all), q as (select n, segment_id, case when n % 3 = 1 and writer_id = 2 then null else o end o from p)
select 'c' || cast(n as varchar) as name, segment_id, cast(max(o) as bigint) "offset", (select bool_and(o is not null) from q x where x.n = q.n) complete from q group by n, segment_id""")
def checkpoint_positions(spark, d):
    log = events_log(spark, d)
    p = log.groupBy(F.floor(F.col("event_id") / 250).alias("n"), "writer_id", "segment_id").agg(F.max(F.col("offset") + F.col("len")).alias("o"))
    late = (F.col("n") % 3 == 1) & (F.col("writer_id") == 2)
    return G.checkpoint(p.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("name"), F.col("writer_id").alias("reader"), "segment_id", F.when(~late, F.col("o")).alias("offset")))


@query("""with r as (select 'c' || cast(i as varchar) as name, i * 10 seq, i % 6 = 5 silent, i * 10 + 5 + (i * 37) % 80 done_seq from (select unnest(range(0, 60)) i))
select name, seq, silent or (select count(*) from r o where o.seq < r.seq and o.done_seq > r.seq and not o.silent) < 3 admitted from r""")
def checkpoint_admission(spark, d):
    i = F.col("id")
    r = spark.range(60).select(F.concat(F.lit("c"), i.cast("string")).alias("name"), (i * 10).alias("seq"), (i % 6 == 5).alias("silent"), (i * 10 + 5 + i * 37 % 80).alias("done_seq"))
    return G.admit(r)


@query("with " + CUTS + """, dn as (select segment_id, max(event_id) done_at from lg where segment_id <> 4294967299 group by segment_id) select successor, case when bool_and(done_at is not null) then max(done_at) end ready_at from link left join dn using (segment_id) group by successor""")
def successor_barrier(spark, d):
    done = events(spark, d).where("segment_id <> 4294967299").groupBy("segment_id").agg(F.max("event_id").alias("done_at"))
    return G.start_times(done, E.successors(model.epochs(spark)))


@query()
def state_fold(spark, d):
    """A counter kept by conditional updates, with an Init every 400 events: state from the last Init on."""
    from tideline.streaming.state import synchronized

    e = read(spark, d, "events")
    kind = F.when(F.col("event_id") % 400 == 0, "init").otherwise("update")
    return synchronized(e.select("user_id", F.col("event_id").alias("revision"), kind.alias("kind"), F.floor("value").cast("long").alias("value"), F.when(F.col("event_id") % 9 == 0, F.col("event_id") - 1).alias("expected")), ["user_id"])


@query("select tags, count(*) n from (select 't' || cast(unnest([user_id % 3, 3 + user_id % 2]) as varchar) tags from events group by user_id, 1) group by tags".replace(" group by user_id, 1)", ")").replace("from events)", "from (select distinct user_id from events))"))
def streams_by_tag(spark, d):
    from tideline.sources.catalog import by_tag, tagged

    s = read(spark, d, "events").select("user_id").distinct()
    tags = F.array(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("t"), (3 + F.col("user_id") % 2).cast("string")))
    streams = s.select(F.col("user_id").cast("string").alias("stream"), tags.alias("tags"))
    out = None
    for t in ("t0", "t1", "t2", "t3", "t4"):
        one = by_tag(tagged(streams), t).agg(F.lit(t).alias("tags"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("with " + EVENTS + """, p as (select segment_id, max("offset") - 200 o from lg group by segment_id) select event_id, lg.segment_id from lg join p using (segment_id) where "offset" >= o""")
def reset_to_cut(spark, d):
    log = events_log(spark, d)
    at = log.groupBy("segment_id").agg((F.max("offset") - 200).alias("offset"))
    return G.restart(log, at).select("event_id", "segment_id")


@query("""with a as (select 'r' || cast(user_id % 3 as varchar) reader, user_id segment_id, min(event_id) "offset" from events group by all), r as (select 'r' || cast(user_id % 3 as varchar) reader, user_id segment_id, max(event_id) o from events where user_id % 2 = 0 group by all)
select segment_id, coalesce(o, "offset") "offset" from a left join r using (reader, segment_id)""")
def reader_offline(spark, d):
    e = read(spark, d, "events").withColumn("reader", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    a = e.groupBy("reader", F.col("user_id").alias("segment_id")).agg(F.min("event_id").alias("offset"))
    r = e.where("user_id % 2 = 0").groupBy("reader", F.col("user_id").alias("segment_id")).agg(F.max("event_id").alias("offset"))
    return G.offline_positions(a, r)


@query()
def release_choice(spark, d):
    a = read(spark, d, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("reader"), F.col("user_id").alias("segment_id")).distinct()
    return G.segment_to_release(a)


@query()
def route_without_key(spark, d):
    """Every fifth event has no key: it gets a segment at random, the same one whenever it is computed."""
    from tideline.functions.hashing import key_fraction, route
    from tideline.sources.events import epoch_at

    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("user_id").cast("string")).alias("key"), epoch_at(F.col("ts")).alias("epoch"))
    return route(e.withColumn("frac", key_fraction("key", "event_id")), model.epochs(spark)).select("event_id", "key", "segment_id")


@query("with t as (select distinct user_id, user_id % 256 type from events) select user_id, type, type & 1 = 1 as \"table\", type & 5 = 5 fixed_key_table, type & 16 = 16 internal, type & 48 = 48 \"system\", type & 64 = 64 critical, type & 128 = 128 transient from t")
def segment_flags(spark, d):
    from tideline.sources.catalog import with_flags

    return with_flags(read(spark, d, "events").select("user_id", (F.col("user_id") % 256).alias("type")).distinct(), "type")


@query("select distinct cast(user_id as varchar) as name from events where cast(user_id as varchar) > '15' order by 1 limit 10")
def list_page(spark, d):
    from tideline.sources.catalog import page

    return page(read(spark, d, "events").select(F.col("user_id").cast("string").alias("name")).distinct(), "name", "15", 10)


@query("select user_id, event_type, max(value) as value from events where event_type >= 'error' and event_type < 'signup' group by all")
def attribute_range(spark, d):
    """Attributes with ids in a range."""
    top = A.replace_if_greater(read(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").drop("rejected")
    return top.where((F.col("event_type") >= "error") & (F.col("event_type") < "signup"))
