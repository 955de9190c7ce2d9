"""Queries that run a stream of several files to its end, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import sketches as K
from lodespark.session import scratch
from lodespark.session import table as t
from lodespark.streaming import streams as S

#: Files the events come in, one micro-batch each.
FILES = 4


def _events(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    path = S.in_order(e, "event_id", FILES)
    return S.file_stream(s, path, "*.parquet", e.schema).withColumn("at", F.col("ts").cast("timestamp"))


def stream_window_counts(s: SparkSession, d: str) -> DataFrame:
    """Events per day and type of the days that the watermark has closed."""
    return S.drain(S.window_counts(_events(s, d), "at", "event_type", "1 day"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Closed sessions per user, six hours' silence apart."""
    return S.drain(S.session_counts(_events(s, d), "at", "user_id", "6 hours"))


def stream_bloom(s: SparkSession, d: str) -> DataFrame:
    """Users the filter may know, per micro-batch and shard (ST01)."""
    return S.drain(S.bloom_stream(_events(s, d), "user_id", 4))


def stream_bloom_csv(s: SparkSession, d: str) -> DataFrame:
    """The same as a report in CSV, batches in order."""
    path = scratch(s, "report")
    b = stream_bloom(s, d).groupBy("seq").agg(F.sum("seen").alias("seen"), F.sum("maybe_known").alias("maybe_known")).orderBy("seq")
    b.coalesce(1).write.option("header", True).csv(path)
    return s.read.option("header", True).schema("seq int, seen bigint, maybe_known bigint").csv(path)


def stream_reservoir(s: SparkSession, d: str) -> DataFrame:
    """A reservoir of 100 events, filled in shards and merged (ST03)."""
    return S.merged_reservoir(S.drain(S.reservoir_stream(_events(s, d), "event_id")))


def stream_refresh(s: SparkSession, d: str) -> DataFrame:
    """Users taken over from each file unless the target has them (ST04)."""
    target = scratch(s, "target")
    S.refresh_once(_events(s, d).select("user_id"), target, "user_id")
    return s.read.parquet(target)


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("stream_")}

_ROWS = ", ".join(f"({a}, {b})" for a, b in K.BLOOM_HASHES)
_BLOOM = f"""with ends as (select min(event_id) as lo, max(event_id) as hi from events),
    c as (select range as k, lo + (hi + 1 - lo) * range // {FILES} as a, lo + (hi + 1 - lo) * (range + 1) // {FILES} as z from ends, range({FILES})),
    v as (select user_id as v, user_id % 4 as shard, k as b from events join c on event_id >= a and event_id < z where user_id is not null),
    q as (select shard, b, row_number() over (partition by shard order by b) - 1 as seq from (select distinct shard, b from v)), h(ha, hb) as (values {_ROWS}), f as (select v, shard, min(b) as first from v group by all),
    bits as (select v, shard, first, (v % {K.BLOOM_BITS} * ha + hb) % {K.BLOOM_BITS} as bit from f cross join h), st as (select shard, bit, min(first) as set_at from bits group by all),
    k as (select v, max(set_at) as all_set from bits join st using (shard, bit) group by v),
    r as (select v.shard::int as shard, q.seq::int as seq, count(*) as seen, count_if(all_set < v.b)::bigint as maybe_known from v join k using (v) join q on q.shard = v.shard and q.b = v.b group by all)"""
_CLOSED = "(select max(ts) - interval 1 hour from events)"
ORACLES = {
    "stream_window_counts": f"select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= {_CLOSED} group by 1, 2",
    "stream_sessions": f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
        k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sess from g)
        select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from k group by user_id, sess having max(ts) + interval 6 hours <= {_CLOSED}""",
    "stream_bloom": f"{_BLOOM} select * from r",
    "stream_bloom_csv": f"{_BLOOM} select seq, sum(seen)::bigint as seen, sum(maybe_known)::bigint as maybe_known from r group by seq",
    "stream_reservoir": "select event_id::varchar as value, md5('7/' || event_id) as draw from events order by draw, value limit 100",
    "stream_refresh": "select distinct user_id from events",
}
