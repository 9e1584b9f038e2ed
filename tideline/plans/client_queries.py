"""Queries over what clients write and ask: batches, rates by kind, references, existence, payloads, generated state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import model
from tideline.functions import codecs, hashing
from tideline.operators import attributes as A
from tideline.operators import cuts as C
from tideline.operators import epochs as E
from tideline.operators import rates as R
from tideline.operators import retention as T
from tideline.operators import watermarks as W
from tideline.plans.sql import CUTS, EVENTS
from tideline.plans.stream_queries import daily_cuts
from tideline.sources import catalog, sinks
from tideline.sources.events import events, events_log, read
from tideline.streaming import state

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("with " + EVENTS + """, b as (select user_id, event_id // 100 batch, sum(len) n, max(len) top, max(epoch) e from ev group by all),
w as (select ev.event_id, b.batch, frac, e, case when top > 16 and b.batch % 2 = 0 then 'EventTooLarge' when n > 40 then 'BatchTooLarge' else 'Ok' end result from ev join b on ev.user_id = b.user_id and event_id // 100 = b.batch)
select event_id, batch, result, case when result = 'Ok' then segment_id end segment_id from w join ep on ep.epoch = e and frac <= key_end and (frac > key_start or key_start = 0)""")
def batch_write(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a user's events, written whole or not at all; limits are small, and that of events holds in even batches."""
    e = events(spark, d).withColumn("batch", F.floor(F.col("event_id") / 100)).drop("segment_id")
    size = F.col("batch") % 2 == 0
    got = sinks.batches(e.where(size), "user_id", "batch", "len", 16, 40).unionByName(sinks.batches(e.where(~size), "user_id", "batch", "len", 1 << 20, 40))
    return hashing.route(got, model.epochs(spark)).select("event_id", "batch", "result", F.when(F.col("result") == "Ok", F.col("segment_id")).alias("segment_id"))


@query("with " + EVENTS + """, c as (select segment_id, cast(floor(epoch(ts) / 300) as bigint) tick, len, case when user_id % 2 = 0 then 1 + event_id % 50 else 1 end n, case when user_id % 2 = 0 then event_id % 7 * 150000 else 0 end life from lg),
a as (select segment_id, tick, case when life < 300000 then n else n * 300000 // life end ev, case when life < 300000 then n * len else n * len * 300000 // life end sz from c),
tk as (select segment_id, 'events' kind, tick, sum(ev) n from a group by all having sum(ev) > 0 union all select segment_id, 'bytes', tick, sum(sz) from a group by all having sum(sz) > 0),
f as (select segment_id, kind, min(tick) f from tk group by all), g as (select max(tick) g from a)
select segment_id, kind, """ + ", ".join(f"round(sum(n / 5e0 * pow(exp(-5 / 60e0 / {m}), g - tick) * case when tick = f then 1 else 1 - exp(-5 / 60e0 / {m}) end) / case when kind = 'bytes' then 1024 else 1 end, 6) rate_{m}" for m in R.MINUTES) + " from tk join f using (segment_id, kind), g group by segment_id, kind")
def rate_kinds(spark, d):
    """Rates by events and by kilobytes; even users commit transactions of several events, open for up to 15 minutes.  A tick is five minutes."""
    txn = F.col("user_id") % 2 == 0
    n, life = F.when(txn, F.col("event_id") % 50 + 1).otherwise(1), F.when(txn, F.col("event_id") % 7 * 150000).otherwise(0)
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * R.TICK)).cast("long")
    sums = [F.sum(R.contribution(n, n * F.col("len"), life, kind, 60000 * R.TICK)).alias(kind) for kind in ("events", "bytes")]
    ticks = events(spark, d).groupBy("segment_id", at.alias("tick")).agg(*sums)
    last = ticks.agg(F.max("tick")).first()[0]
    each = ticks.unpivot(["segment_id", "tick"], ["events", "bytes"], "kind", "n").where("n > 0")
    rates = R.ewma(each, ["segment_id", "kind"], last)
    return rates.select("segment_id", "kind", *(F.round(R.in_unit(F.col(f"rate_{m}"), F.col("kind")), 6).alias(f"rate_{m}") for m in R.MINUTES))


@query("with " + EVENTS + 'select segment_id, writer_id, arg_max("offset", event_id) - 5 as value from lg group by all')
def attr_reference(spark, d):
    """The length that a segment had when a writer's last append came, less 5."""
    return A.referenced(events_log(spark, d), ["segment_id", "writer_id"], "offset", "event_id", -5)


@query("""with recursive a as (select event_type stream, cast(ts as date) dy, user_id % 2 controller, max(event_id) seq from events group by all),
s as (select stream, seq, case when controller = 1 then dayofyear(dy) + dayofyear(dy) // 4 end expected, row_number() over (partition by stream order by seq) rn from a),
r as (select distinct stream, -1::bigint seq, 0::bigint rn, false written, 0::bigint revision, 0::bigint mark from s
union all select s.stream, s.seq, s.rn, coalesce(expected = revision, true), case when coalesce(expected = revision, true) then revision + 1 else revision end, case when coalesce(expected = revision, true) then revision else mark end
  from r join s on s.stream = r.stream and s.rn = r.rn + 1)
select stream, seq, written, revision, mark from r where rn > 0""")
def wm_append(spark, d):
    """Two controllers append a watermark a day to each stream; one of them expects a revision that is often stale."""
    day = F.col("ts").cast("date")
    a = read(spark, d, "events").groupBy(F.col("event_type").alias("stream"), day.alias("day"), (F.col("user_id") % 2).alias("controller")).agg(F.max("event_id").alias("seq"))
    n = F.dayofyear("day").cast("long")
    return W.appended_marks(a.select("stream", "seq", F.when(F.col("controller") == 1, n + F.floor(n / 4)).alias("expected")))


@query("with " + CUTS + """, o as (select a.epoch, a.segment_id n, b.segment_id b from ep a join ep b on b.epoch = a.epoch - 1 and a.key_start < b.key_end and a.key_end > b.key_start)
select epoch, (select count(*) from (select 1 from o where o.epoch <= e.epoch group by o.epoch, b having count(*) > 1)) splits, (select count(*) from (select 1 from o where o.epoch <= e.epoch group by o.epoch, n having count(*) > 1)) merges
from (select distinct epoch from ep) e""")
def split_merge_counts(spark, d):
    return E.split_merge_counts(model.epochs(spark))


@query("with " + CUTS + """select 'created' place, segment_id, 0::bigint "offset" from ep where epoch = 0 union all select 'truncated', segment_id, "offset" from cut where cut_id = 14
union all select 'current', segment_id, null from ep where epoch = (select max(epoch) from ep)""")
def head_and_current(spark, d):
    """Where the stream begins before and after truncation at the cut of day 14, and its current segments."""
    ep, cut = model.epochs(spark), daily_cuts(spark, d).where("cut_id = 14")
    parts = {"created": E.at_head(ep), "truncated": E.at_head(ep, cut), "current": E.current(ep).select("segment_id", F.lit(None).cast("long").alias("offset"))}
    created, truncated, current = (p.select(F.lit(k).alias("place"), "segment_id", "offset") for k, p in parts.items())
    return created.unionByName(truncated).unionByName(current)


@query("with " + CUTS + """, b as (select segment_id, min("offset") "offset", any_value(key_start) s, any_value(key_end) e from rc where cut_id in (17, 21) group by segment_id)
select segment_id, "offset" from b where not exists (select 1 from b x where x.s < b.e and x.e > b.s and x.segment_id < b.segment_id)""")
def consumption_bound(spark, d):
    """What readers still need: a group that holds nothing back, one at its checkpoint (17) and one at its user's cut (21)."""
    groups = spark.createDataFrame([(1, "none", 3, 4), (2, "automatic", 17, 6), (3, "manual", 8, 21), (4, "manual", 9, None)], "group_id long, mode string, checkpoint long, user long")
    cuts = daily_cuts(spark, d)
    return C.lower_bound(T.consumed(groups, cuts, cuts), model.segments(spark))


@query("""with t as (select distinct 's' || (user_id % 4) as scope, 'u' || user_id as stream, user_id % 2 segment_id from events), a as (select 's' || (i % 6) as scope, 'u' || i as stream, i % 3 segment_id from (select unnest(range(0, 60)) i))
select a.*, scope in (select scope from t) scope_exists, (scope, stream) in (select (scope, stream) from t) stream_exists, (scope, stream, segment_id) in (select (scope, stream, segment_id) from t) segment_valid from a""")
def existence(spark, d):
    name = lambda c, by: (F.concat(F.lit("s"), (c % by).cast("string")).alias("scope"), F.concat(F.lit("u"), c.cast("string")).alias("stream"))
    user, i = F.col("user_id"), F.col("id")
    active = read(spark, d, "events").select(*name(user, 4), (user % 2).alias("segment_id")).distinct()
    return catalog.known(spark.range(60).select(*name(i, 6), (i % 3).alias("segment_id")), active, active, active)


@query()
def route_table_key(spark, d):
    """Table keys to four segments by the exact hash of their bytes, which SQL lacks; tested against the hash itself."""
    keys = read(spark, d, "events").select(F.col("user_id").cast("string").alias("pk")).distinct().withColumn("frac", hashing.exact_table_fraction(F.col("pk").cast("binary"))).withColumn("epoch", F.lit(0))
    return hashing.route(keys, E.create(spark, 4).withColumn("epoch", F.lit(0))).select("pk", "frac", "segment_id")


@query("select event_type, count(*) n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) total, count(json_extract(props, '$.none')) n_none, max(len(json_keys(props))) n_keys, cast(max(cast(json_extract(props, '$.k') as bigint)) as bigint) top from events group by event_type")
def json_payload(spark, d):
    """Fields of the JSON payload: a declared schema, a path, and the keys of the object."""
    p = F.from_json("props", "k long")
    keys = F.size(F.json_object_keys("props")).cast("long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(p["k"]).alias("total"), F.count(F.get_json_object("props", "$.none")).alias("n_none"), F.max(keys).alias("n_keys"), F.max(p["k"]).alias("top"))


@query("select event_id, user_id, event_type, value, props, event_id * 7 number from events")
def codec_round_trip(spark, d):
    """Values to bytes and back: a struct as JSON, text, and numbers by a codec in Python."""
    record = codecs.json("user_id long, event_type string, value double")
    number = codecs.custom(lambda x: int(x).to_bytes(8, "big", signed=True), lambda b: int.from_bytes(b, "big", signed=True), "long")
    e = read(spark, d, "events")
    wire = e.select("event_id", record.encode(F.struct("user_id", "event_type", "value")).alias("r"), codecs.TEXT.encode(F.col("props")).alias("t"), number.encode(F.col("event_id") * 7).alias("n"))
    back = wire.select("event_id", record.decode(F.col("r")).alias("r"), codecs.TEXT.decode(F.col("t")).alias("props"), number.decode(F.col("n")).alias("number"))
    return back.select("event_id", "r.*", "props", "number")


@query("""with recursive s as (select user_id, event_id, event_type = 'purchase' w, cast(floor(value) as bigint) v, row_number() over (partition by user_id order by event_id) rn from events),
r as (select distinct user_id, -1::bigint event_id, 0::bigint rn, 0::bigint updates, 0::bigint state, 0::bigint since from s
union all select user_id, event_id, rn, u, case when u = 0 then before when w then before - v else before + v + u - 1 end, case when so + u >= 8 then 0 else so + u end from (
  select s.*, r.state before, r.since so, case when w then case when r.state >= v then 1 else 0 end when v > 150 then 2 else 1 end u from r join s on s.user_id = r.user_id and s.rn = r.rn + 1))
select user_id, event_id, updates, state, since from r where rn > 0""")
def state_generator(spark, d):
    """Balances: a purchase needs cover or makes no update, a large deposit makes two, and every 8 updates the state is compacted."""

    def generate(balance, row):
        if row["event_type"] == "purchase":
            return [-row["v"]] if balance >= row["v"] else []
        return [row["v"], 1] if row["v"] > 150 else [row["v"]]

    requests = read(spark, d, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("v"))
    return state.generated(requests, ["user_id"], "event_id", 0, generate, lambda s, u: s + u, lambda s: s, 8, "long")


@query("""with k as (select user_id, event_id, cast(floor(value) as bigint) v, octet_length(encode(props)) b from events where event_id >= 200), l as (select user_id, max(event_id) filter (event_id % 10 = 0) as init from k group by user_id)
select user_id, init, cast(sum(v) filter (event_id >= init) as bigint) state, cast(sum(b) filter (event_id >= init) as bigint) bytes_since from k join l using (user_id) group by user_id, init""")
def state_restart(spark, d):
    """State read after truncation at revision 200, with an Init every ten events."""
    kind = F.when(F.col("event_id") % 10 == 0, "init").otherwise("update")
    log = read(spark, d, "events").select("user_id", F.col("event_id").alias("revision"), kind.alias("kind"), F.floor("value").cast("long").alias("value"), F.octet_length("props").cast("long").alias("bytes"))
    return state.restarted(log, ["user_id"], 200)
