"""Queries over the routed log: scans, cuts, epochs.  Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import model
from tideline.functions import hashing, names
from tideline.operators import cuts as C
from tideline.operators import epochs as E
from tideline.plans.sql import CUTS, EVENTS, PAIRS
from tideline.scratch import saved
from tideline.sources import batch
from tideline.sources.events import events, events_log

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("with " + EVENTS + "select event_id, routing_key, frac, epoch, segment_id from lg")
def route_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "routing_key", "frac", "epoch", "segment_id")


@query("with " + EVENTS + "select segment_id, count(*) n, cast(sum(len) as bigint) bytes from lg group by segment_id")
def segment_sizes(spark, d):
    return events(spark, d).groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@query("with " + EVENTS + 'select event_id, segment_id, "offset" from lg')
def event_offsets(spark, d):
    return events_log(spark, d).select("event_id", "segment_id", "offset")


FROM, TO = {0: 5000, 1: 20000}, {4294967298: 15000, 8589934596: 20000}


@query("with " + EVENTS + """
select segment_id, count(*) n_events, cast(sum(len) as bigint) bytes, min(event_id) first_event, max(event_id) last_event from lg
where (segment_id <> 0 or "offset" >= 5000) and (segment_id <> 1 or "offset" >= 20000) and (segment_id <> 4294967298 or "offset" < 15000) and (segment_id <> 8589934596 or "offset" < 20000)
group by segment_id""")
def batch_read_between_cuts(spark, d):
    log = events_log(spark, d)
    ranges = batch.segment_ranges(spark, FROM, TO)
    return batch.scan(log, ranges).groupBy("segment_id").agg(F.count("*").alias("n_events"), F.sum("len").alias("bytes"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("with " + EVENTS + 'select segment_id, "offset", event_id, props from lg')
def fetch_event(spark, d):
    log = events_log(spark, d)
    pointers = log.select("segment_id", "offset")
    return batch.fetch(log, pointers).select("segment_id", "offset", "event_id", "props")


@query("with " + EVENTS + 'select segment_id, event_id, "offset" - 100 + 0 skipped from lg where "offset" >= 100 and "offset" + len <= 1000')
def byte_range(spark, d):
    return batch.byte_range(events_log(spark, d), 100, 900).select("segment_id", "event_id", (F.col("offset") - 100).alias("skipped"))


@query("with " + EVENTS + 'select segment_id, min("offset") head, cast(max("offset" + len) as bigint) tail, max(last_epoch) < 2 sealed from lg join seg using (segment_id) group by segment_id')
def stream_info(spark, d):
    return batch.stream_info(events_log(spark, d), model.segments(spark))


@query("with " + EVENTS + """, r as (select *, row_number() over (partition by segment_id order by "offset") rn from lg)
select event_id, row_number() over (order by rn, segment_id) - 1 place from r""")
def round_robin_read(spark, d):
    return batch.round_robin(events_log(spark, d)).select("event_id", "place")


@query("with " + CUTS + """, pair as (select x.cut_id a, y.cut_id b from (select distinct cut_id from cut) x, (select distinct cut_id from cut) y where (x.cut_id + y.cut_id) % 3 = 0),
o as (select pair.a, pair.b, x.segment_id s, x."offset" xo, y.segment_id t, y."offset" yo from pair join rc x on x.cut_id = a join rc y on y.cut_id = b and x.key_start < y.key_end and x.key_end > y.key_start),
c as (select a, b, bool_or(case when s = t then xo > yo else s > t end) gt, bool_or(case when s = t then xo < yo else s < t end) lt from o group by a, b)
select a, b, case when not lt then 'EqualOrAfter' when not gt then 'Before' else 'Overlaps' end ordering from c""")
def cut_compare(spark, d):
    cuts = daily_cuts(spark, d)
    ids = spark.range(30).select(F.col("id").alias("a"))
    pairs = ids.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("b")).where("(a + b) % 3 = 0")
    return C.compare(cuts, model.segments(spark), pairs)


def daily_cuts(spark, d):
    return C.daily(events_log(spark, d), model.epochs(spark), "2024-01-01", 30)


def sizes(spark, d):
    return events_log(spark, d).groupBy("segment_id").agg(F.max(F.col("offset") + F.col("len")).alias("bytes"))


def week_pairs(spark):
    return spark.range(23).select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))


@query("with " + CUTS + PAIRS + "select a, b, segment_id from btw")
def segments_between(spark, d):
    return C.between(daily_cuts(spark, d), model.segments(spark), week_pairs(spark))


@query("with " + CUTS + PAIRS + "select a, b, segment_id, cast(f as bigint) from_offset, cast(t as bigint) to_offset from span")
def cut_spans(spark, d):
    return C.spans(daily_cuts(spark, d), model.segments(spark), sizes(spark, d), week_pairs(spark))


@query("with " + CUTS + PAIRS + "select a, b, count(*) n_segments, cast(sum(t - f) as bigint) bytes from span group by a, b")
def cut_distance(spark, d):
    return C.distance(daily_cuts(spark, d), model.segments(spark), sizes(spark, d), week_pairs(spark))


@query("with " + CUTS + """, top as (select cut_id, max(segment_id) m from cut group by cut_id),
k as (select rc.* from rc join top using (cut_id) where cut_id % 3 <> 1 or segment_id <> m), extra as (select * from k union all select cut_id, 0, 0, 0e0, 0.5e0 from k where cut_id % 5 = 2 and cut_id >= 10 group by cut_id),
l as (select *, coalesce(lag(key_end) over (partition by cut_id order by key_start, key_end), 0e0) p from extra)
select cut_id, cast(count(*) filter (key_start > p) + cast(max(key_end) < 1 as int) as bigint) gaps, count(*) filter (key_start < p) laps,
  count(*) filter (key_start > p) = 0 and max(key_end) >= 1 and count(*) filter (key_start < p) = 0 valid from l group by cut_id""")
def cut_validity(spark, d):
    cuts = daily_cuts(spark, d)
    top = F.max("segment_id").over(Window.partitionBy("cut_id"))
    broken = cuts.withColumn("m", top).where("cut_id % 3 <> 1 or segment_id <> m").drop("m")
    extra = broken.where("cut_id % 5 = 2 and cut_id >= 10").select("cut_id", F.lit(0).cast("long").alias("segment_id"), F.lit(0).cast("long").alias("offset")).distinct()
    return C.validity(broken.unionByName(extra), model.segments(spark))


@query("with " + CUTS + """, tg as (select cut_id, segment_id, "offset", coalesce(bytes, 0) bytes, "offset" + greatest(1, 1000 // count(*) over (partition by cut_id)) target from cut left join size using (segment_id)),
mv as (select tg.cut_id, tg.segment_id, tg."offset", tg.bytes, coalesce(min(lg."offset" + len), greatest(any_value(tg.bytes), any_value(tg."offset"))) t from tg left join lg on lg.segment_id = tg.segment_id and lg."offset" + len >= target group by all),
st as (select *, not bool_or(t > "offset") over (partition by cut_id) stuck from mv),
fr as (select distinct cut_id, segment_id, successor from st join link using (segment_id) where stuck and not exists
  (select 1 from link l join st y on y.segment_id = l.segment_id where l.successor = link.successor and y.cut_id = st.cut_id and y."offset" < y.bytes))
select cut_id, segment_id, cast(t as bigint) "offset" from st where not exists (select 1 from fr where fr.cut_id = st.cut_id and fr.segment_id = st.segment_id)
union all select distinct cut_id, successor, 0 from fr""")
def next_cut(spark, d):
    log = saved(events_log(spark, d).select("segment_id", "offset", "len", "ts"))
    cuts = saved(C.daily(log, model.epochs(spark), "2024-01-01", 30))
    size = log.groupBy("segment_id").agg(F.max(F.col("offset") + F.col("len")).alias("bytes"))
    return C.next_cut(cuts, log, size, E.successors(model.epochs(spark)), 1000)


@query()
def cut_fully_valid(spark, d):
    """The daily cuts as they are (0), without their newest segment (1), with it not yet reached (2), and with a future segment that isn't due (3)."""
    cuts = daily_cuts(spark, d)
    top = cuts.withColumn("top", F.col("segment_id") == F.max("segment_id").over(Window.partitionBy("cut_id")))
    four = top.withColumn("kind", F.explode(F.array(*map(F.lit, range(4))))).where("not (top and kind = 1)")
    four = four.select((F.col("cut_id") * 4 + F.col("kind")).alias("cut_id"), "segment_id", F.when(F.col("top") & (F.col("kind") == 2), -1).otherwise(F.col("offset")).cast("long").alias("offset"))
    undue = cuts.select((F.col("cut_id") * 4 + 3).alias("cut_id"), F.lit(4294967299).cast("long").alias("segment_id"), F.lit(-1).cast("long").alias("offset")).distinct()
    undue = undue.join(four.select("cut_id", "segment_id"), ["cut_id", "segment_id"], "left_anti")
    return C.fully_valid(four.unionByName(undue), model.HISTORY)


@query("with " + EVENTS + 'select segment_id, event_id, "offset" revision, "offset" + len next_revision from lg where "offset" >= 1000 and "offset" < 5000')
def revision_range(spark, d):
    """What each segment's log has from revision 1000 up to revision 5000."""
    return batch.read_revisions(events_log(spark, d), 1000, 5000).select("segment_id", "event_id", "revision", "next_revision")


@query("with " + EVENTS + """, t as (select segment_id, cast(max("offset" + len) as bigint) tail from lg group by segment_id)
select segment_id, event_id, "offset" revision, "offset" + len next_revision from lg join t using (segment_id) where "offset" >= tail // 2""")
def revision_tail(spark, d):
    """What each segment's log has from the middle of it on."""
    log = saved(events_log(spark, d).select("segment_id", "event_id", "offset", "len"))
    start = log.groupBy("segment_id").agg(F.floor(F.max(F.col("offset") + F.col("len")) / 2).alias("start"))
    return batch.read_revisions(log, start).select("segment_id", "event_id", "revision", "next_revision")


@query("with " + CUTS + """, e as (select cut_id, min(segment_id) >> 32 lo, max(segment_id) >> 32 hi from cut group by cut_id)
select cut_id, segment_id, max(epoch) epoch from cut join e using (cut_id) join ep using (segment_id) where epoch between lo and hi group by cut_id, segment_id""")
def cut_span_epochs(spark, d):
    return C.span_epochs(daily_cuts(spark, d), model.epochs(spark))


@query("with " + CUTS + 'select cut_id, \'s\' stream, segment_id, "offset" from cut')
def cut_text_round_trip(spark, d):
    return C.decode(C.encode(daily_cuts(spark, d), "s"))


@query("with " + CUTS + """, b as (select segment_id, max("offset") "offset", any_value(key_start) s, any_value(key_end) e from rc where cut_id in (5, 12, 17) group by segment_id)
select segment_id, "offset" from b where not exists (select 1 from b x where x.s < b.e and x.e > b.s and x.segment_id > b.segment_id)""")
def position_upper_bound(spark, d):
    return C.upper_bound(daily_cuts(spark, d).where("cut_id in (5, 12, 17)"), model.segments(spark))


@query("with " + CUTS + """, b as (select segment_id, min("offset") "offset", any_value(key_start) s, any_value(key_end) e from rc where cut_id in (12, 17, 25) group by segment_id)
select segment_id, "offset" from b where not exists (select 1 from b x where x.s < b.e and x.e > b.s and x.segment_id < b.segment_id)""")
def subscriber_lower_bound(spark, d):
    return C.lower_bound(daily_cuts(spark, d).where("cut_id in (12, 17, 25)"), model.segments(spark))


@query("with " + CUTS + "select segment_id, successor, (select list(l.segment_id order by l.segment_id) from link l where l.successor = link.successor) predecessors from link")
def epoch_successors(spark, d):
    return E.successors_with_predecessors(E.successors(model.epochs(spark)))


@query("""select i segment_id, i / 7e0 key_start, case when i = 6 then 1e0 else (i + 1) / 7e0 end key_end from (select unnest(range(0, 7)) i)""")
def create_ranges(spark, d):
    return E.create(spark, 7)


@query("with " + EVENTS + """, x as (select segment_id, key_start a, key_end b, cast(least(greatest(2, 3 + segment_id % 2), greatest(2, 4)) as integer) n from seg), y as (select *, unnest(range(0, n)) i from x)
select segment_id, cast(i as integer) part, a + (b - a) / n * i key_start, case when i = n - 1 then b else a + (b - a) / n * (i + 1) end key_end from y""")
def split_ranges(spark, d):
    return E.split(model.segments(spark), F.lit(3) + F.col("segment_id") % 2, F.lit(4))


_COLD = """c as (select 's' stream, i segment_id, i / 12e0 key_start, case when i = 11 then 1e0 else (i + 1) / 12e0 end key_end, i not in (3, 8) cold from (select unnest(range(0, 12)) i)),
r as (select *, sum(case when cold and coalesce(p, false) then 0 else 1 end) over (order by key_start) run from (select *, lag(cold) over (order by key_start) p from c)),
m as (select *, row_number() over (partition by run order by key_start) k, lead(segment_id) over (partition by run order by key_start) right_id, lead(key_end) over (partition by run order by key_start) re from r),
p as (select stream, segment_id left_id, right_id, key_start, re key_end from m where cold and k % 2 = 1 and right_id is not null)"""


@query(f"with {_COLD} select * exclude (k) from (select *, row_number() over (order by key_start) k from p) where 12 - k >= 9")
def merge_ranges(spark, d):
    cold = E.create(spark, 12).select(F.lit("s").alias("stream"), "*", (~F.col("segment_id").isin(3, 8)).alias("cold"))
    counts = cold.groupBy("stream").agg(F.count("*").alias("segments"), F.lit(9).alias("least"))
    return E.within_minimum(E.merge_candidates(cold), counts)


@query("select * from (values (1, true), (2, true), (3, false), (4, false), (5, false)) t(scale_id, valid)")
def validate_scale(spark, d):
    s = "scale_id int, key_start double, key_end double"
    sealed = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.0, 0.25), (2, 0.25, 0.5), (3, 0.0, 0.5), (4, 0.0, 0.5), (5, 0.0, 0.5)], s)
    new = spark.createDataFrame([(1, 0.0, 0.2), (1, 0.2, 0.5), (2, 0.0, 0.5), (3, 0.0, 0.4), (4, 0.0, 0.3), (4, 0.2, 0.5), (5, 0.0, 0.2), (5, 0.3, 0.5)], s)
    return E.validate(sealed, new)


@query("with " + EVENTS + """select epoch, segment_id, key_start, key_end from ep
union all select 3, segment_id, key_start, key_end from ep where epoch = 2 and segment_id <> 8589934596
union all select * from (values (3, 12884901893, 0.25e0, 0.6e0), (3, 12884901894, 0.6e0, 1e0))""")
def next_epoch(spark, d):
    return E.next_epoch(model.epochs(spark), [8589934596], [(0.25, 0.6), (0.6, 1.0)])


@query("with " + EVENTS + "select * from (values (1::bigint, 0.5e0, 1e0), (4294967298, 0e0, 0.25e0), (4294967299, 0.25e0, 0.5e0)) t(segment_id, key_start, key_end)")
def replace_range(spark, d):
    ep = model.epochs(spark)
    return E.replace_range(ep.where("epoch = 0"), 0, E.successors(ep), model.segments(spark))


@query("with " + EVENTS + "select event_id, epoch, count(*) over (partition by ev.epoch) n from ev")
def epoch_asof_event(spark, d):
    from tideline.sources.events import epoch_at, read

    at = read(spark, d, "events").select("event_id", epoch_at(F.col("ts")).alias("epoch"))
    return at.join(F.broadcast(at.groupBy("epoch").agg(F.count("*").alias("n"))), "epoch").select("event_id", "epoch", "n")


@query("with " + EVENTS + """, a as (select epoch, list(segment_id) s from ep group by epoch)
select b.epoch, cast(coalesce((select count(*) from ep x where x.epoch = b.epoch - 1 and not list_contains(b.s, x.segment_id)), 0) as bigint) sealed,
cast(case when b.epoch = 0 then 0 else (select count(*) from ep x where x.epoch = b.epoch and not list_contains((select s from a where a.epoch = b.epoch - 1), x.segment_id)) end as bigint) created from a b""")
def scale_history(spark, d):
    ep = model.epochs(spark)
    links = ep.select("epoch", "segment_id")
    before = links.select((F.col("epoch") + 1).alias("epoch"), "segment_id")
    sealed = before.join(links, ["epoch", "segment_id"], "left_anti").groupBy("epoch").agg(F.count("*").alias("sealed"))
    made = links.where("epoch > 0").join(before, ["epoch", "segment_id"], "left_anti").groupBy("epoch").agg(F.count("*").alias("created"))
    return links.select("epoch").distinct().join(sealed, "epoch", "left").join(made, "epoch", "left").na.fill(0)


@query("with " + EVENTS + "select segment_id, cast(segment_id >> 32 as integer) epoch, segment_id & 4294967295 number, 'sc/st/' || (segment_id & 4294967295) || '.#epoch.' || (segment_id >> 32) as name, segment_id parsed, 'sc' scope, 'st' stream from seg")
def segment_names(spark, d):
    s = model.segments(spark).select("segment_id")
    out = s.select("segment_id", model.segment_epoch(F.col("segment_id")).alias("epoch"), model.segment_number(F.col("segment_id")).alias("number"), names.segment_name(F.lit("sc"), F.lit("st"), F.col("segment_id")).alias("name"))
    n = F.col("name")
    return out.select("*", names.segment_of(n).alias("parsed"), names.scope_of(n).alias("scope"), names.stream_of(n).alias("stream"))


@query("with " + EVENTS + "select distinct routing_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid from (select routing_key, md5(routing_key) h from ev)")
def key_uuids(spark, d):
    return events(spark, d).select("routing_key", hashing.to_uuid("routing_key").alias("uuid")).distinct()


@query()
def route_exact(spark, d):
    """Routing by the reference-exact hash, which SQL lacks; tested on golden vectors."""
    raw = events(spark, d).drop("segment_id").withColumn("frac", hashing.exact_fraction("routing_key"))
    return hashing.route(raw, model.epochs(spark)).select("event_id", "routing_key", "frac", "segment_id", hashing.hash_to_bucket("routing_key", 16).alias("container"))


@query("with " + EVENTS + "select 'a' stream, event_id, user_id from ev where user_id % 2 = 0 union all select 'b', event_id, user_id from ev where user_id % 3 = 0")
def multi_stream_read(spark, d):
    e = events(spark, d)
    return batch.union_streams({"a": e.where("user_id % 2 = 0"), "b": e.where("user_id % 3 = 0")}).select("stream", "event_id", "user_id")


@query("with " + EVENTS + """, t as (select coalesce(max("offset" + len), 0) n from lg where segment_id = 0)
select event_id, "offset", segment_id source from lg where segment_id = 0 union all select event_id, "offset" + n, segment_id from lg, t where segment_id = 4294967298""")
def merge_segment(spark, d):
    log = events_log(spark, d)
    return batch.concat(log.where("segment_id = 0"), log.where("segment_id = 4294967298")).select("event_id", "offset", F.col("segment_id").alias("source"))


@query("with " + EVENTS + """select segment_id, t target, min("offset" + len) filter ("offset" + len >= t) at_or_after, max("offset" + len) filter ("offset" + len <= t) at_or_before from lg, (values (500), (5000)) v(t) group by segment_id, t""")
def offset_search(spark, d):
    targets = spark.createDataFrame([(500,), (5000,)], "target int")
    return batch.search(events_log(spark, d), targets)
