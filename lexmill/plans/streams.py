"""Windowed queries on events; the same functions run on streams (tests hold both against each other)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.catalogue import Tables, query
from lexmill.streaming import flows


@query("""select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, sum(value::decimal(18,6))::double as total from events group by 1, 2""")
def st12_tumbling(t: Tables):
    d = flows.usage(t.events.withColumn("value", F.col("value").cast("decimal(18,6)")), "ts", "event_type", "value")
    return d.withColumn("total", F.col("total").cast("double"))


@query("""select s as start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) as s from events) group by 1, 2""")
def st16_sliding(t: Tables):
    return flows.usage(t.events, "ts", "event_type", "value", "24 hours", "12 hours").drop("total")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
  s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def st16_sessions(t: Tables):
    return flows.sessions(t.events, "ts", "user_id", "30 minutes")


@query("""select event_type, user_id, min(ts) as first, count(*) as n from events where ts >= timestamp '2024-01-20' - interval 24 hour and ts < '2024-01-20' group by 1, 2""")
def st13_last_day(t: Tables):
    d = t.events.where("ts >= timestamp '2024-01-20' - interval 24 hours and ts < '2024-01-20'")
    return d.groupBy("event_type", "user_id").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
