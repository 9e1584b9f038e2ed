"""Streaming queries, each run over the event files as they are and compared with its batch form."""

from __future__ import annotations

from tideline.streaming import pipelines as P

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("with w as (select date_trunc('day', ts) start, count(*) n from events group by 1) select start, n from w where start + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def stream_window_counts(spark, d):
    return P.run(P.window_counts(P.source(spark, d)))


@query("""with s as (select event_type, ts, case when ts - lag(ts) over (partition by event_type order by ts) < interval 30 minute then 0 else 1 end f from events),
g as (select *, sum(f) over (partition by event_type order by ts rows unbounded preceding) g from s), x as (select event_type, min(ts) start, max(ts) + interval 30 minute as stop, count(*) n from g group by event_type, g)
select event_type, start, stop, n from x where stop <= (select max(ts) - interval 1 hour from events)""")
def stream_session_counts(spark, d):
    return P.run(P.session_counts(P.source(spark, d)))


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    """With one file there is one micro-batch, so a key is kept once."""
    return P.run(P.deduplicated(P.source(spark, d), ["user_id", "event_type"]))


@query("select user_id, count(*) n from events group by user_id")
def stream_state(spark, d):
    return P.run(P.counts_by_key(P.source(spark, d), "user_id"), "update")
