"""Common table expressions for the oracle SQL: the routed event log and the daily cuts."""

EVENTS = """
ep(epoch, segment_id, key_start, key_end) as (values
  (0, 0::bigint, 0e0, 0.5e0), (0, 1, 0.5e0, 1e0), (1, 4294967298, 0e0, 0.25e0), (1, 4294967299, 0.25e0, 0.5e0), (1, 1, 0.5e0, 1e0),
  (2, 4294967298, 0e0, 0.25e0), (2, 8589934596, 0.25e0, 1e0)),
seg as (select segment_id, min(key_start) key_start, max(key_end) key_end, min(epoch) first_epoch, max(epoch) last_epoch from ep group by segment_id),
ev as (select event_id, ts, user_id, event_type, value, props, cast(user_id as varchar) routing_key, cast(user_id % 4 as integer) writer_id,
  cast(octet_length(encode(props)) + 8 as bigint) len, cast('0x' || substr(md5(cast(user_id as varchar)), 1, 13) as bigint) / 4503599627370496e0 frac,
  case when ts < timestamp '2024-01-11' then 0 when ts < timestamp '2024-01-21' then 1 else 2 end epoch from events),
lg as (select ev.*, segment_id, cast(sum(len) over (partition by segment_id order by event_id) - len as bigint) "offset"
  from ev join ep on ev.epoch = ep.epoch and frac <= key_end and (frac > key_start or key_start = 0))
"""
CUTS = (
    EVENTS
    + """, size as (select segment_id, cast(max("offset" + len) as bigint) bytes from lg group by segment_id),
ca as (select cut_id, segment_id from (select unnest(range(0, 30)) cut_id) d join ep on ep.epoch = case when cut_id < 10 then 0 when cut_id < 20 then 1 else 2 end),
cut as (select cut_id, ca.segment_id, cast(coalesce(max("offset" + len), 0) as bigint) "offset"
  from ca left join lg on lg.segment_id = ca.segment_id and date_diff('day', date '2024-01-01', cast(ts as date)) <= cut_id group by cut_id, ca.segment_id),
rc as (select cut.*, key_start, key_end from cut join seg using (segment_id)),
link as (select a.segment_id, b.segment_id successor from ep a join ep b on b.epoch = a.epoch + 1 and a.key_start < b.key_end and a.key_end > b.key_start
  where not exists (select 1 from ep x where x.epoch = a.epoch + 1 and x.segment_id = a.segment_id)
    and not exists (select 1 from ep x where x.epoch = a.epoch and x.segment_id = b.segment_id))
"""
)
PAIRS = """, pair as (select cut_id a, cut_id + 7 b from (select unnest(range(0, 23)) cut_id)),
btw as (select a, b, s.segment_id from pair, seg s
  where not exists (select 1 from rc x where x.cut_id = a and s.key_start < x.key_end and s.key_end > x.key_start and s.segment_id < x.segment_id)
    and not exists (select 1 from rc x where x.cut_id = b and s.key_start < x.key_end and s.key_end > x.key_start and s.segment_id > x.segment_id)),
span as (select btw.*, coalesce(x."offset", 0) f, coalesce(y."offset", bytes, 0) t from btw
  left join cut x on x.cut_id = a and x.segment_id = btw.segment_id left join cut y on y.cut_id = b and y.segment_id = btw.segment_id left join size on size.segment_id = btw.segment_id)
"""
