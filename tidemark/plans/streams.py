"""Streaming queries over the event stream, run with availableNow and equal to their batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.engine.session import ensure_checkpoint_dir, micros
from tidemark.plans.registry import collector
from tidemark.streaming import streams as X

QUERIES, query = collector()


def _events(spark, d):
    e = X.file_stream(spark, f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _base(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


@query("select user_id, arg_max(event_type, struct_pack(t := ts, e := event_type)) as event_type, epoch_us(max(ts)) as ts_us from events group by user_id")
def stream_latest_per_key(spark, d):
    out = X.run_once(X.latest_per_key(_events(spark, d), "user_id", "ts", ["event_type"]), _base(spark), "complete")
    return out.select("user_id", "event_type", micros("ts").alias("ts_us"))


@query("select epoch_us(time_bucket(interval 7 day, ts, timestamp '1970-01-01')) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, d):
    out = X.run_once(X.windowed(_events(spark, d), "ts", "7 days", None, "30 days", ["event_type"], "value"), _base(spark), "complete")
    return out.select(micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with w as (select *, unnest([time_bucket(interval 1 day, ts, timestamp '1970-01-01') - interval 1 day, time_bucket(interval 1 day, ts, timestamp '1970-01-01')]) s from events) select epoch_us(s) as start_us, count(*) as n from w group by s""")
def stream_sliding(spark, d):
    out = X.run_once(X.windowed(_events(spark, d), "ts", "2 days", "1 day", "30 days", [], "value"), _base(spark), "complete")
    return out.select(micros("start").alias("start_us"), "n")


@query("""with x as (select user_id, ts, event_id, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end c from events window w as (partition by user_id order by ts, event_id)), y as (select *, sum(c) over (partition by user_id order by ts, event_id) s from x)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from y group by user_id, s""")
def stream_sessions(spark, d):
    out = X.run_once(X.sessions(_events(spark, d), "ts", "30 minutes", "30 days", ["user_id"]), _base(spark), "complete")
    return out.select("user_id", micros("start").alias("start_us"), "n")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    e = X.dedup(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days")
    return X.run_once(e, _base(spark), "append").select("user_id", "event_type")


@query("""with c as (select user_id, event_id, ts, value v, row_number() over (partition by user_id order by event_id) r from events where value is not null)
select user_id, count(*) as n, round(sum(v * pow(0.5, m - r)), 6) as state from (select *, max(r) over (partition by user_id) m from c) group by user_id""")
def stream_keyed_fold(spark, d):
    """x' = x / 2 + value per user, kept as state."""
    e = _events(spark, d).filter("value is not null")
    f = X.keyed_fold(e, "user_id", "long", "event_id", "value", lambda x, v: x / 2 + v, 0.0)
    out = X.run_once(f, _base(spark), "update")
    last = out.groupBy("user_id").agg(F.max(F.struct("n", "state")).alias("s"))
    return last.select("user_id", "s.n", F.round("s.state", 6).alias("state"))


@query("select event_id, user_id from events")
def stream_idempotent_upsert(spark, d):
    """The same batch delivered twice is stored once (left anti join on the key in foreachBatch)."""
    base = _base(spark)
    each = X.incremental_upsert(f"{base}/data", ["event_id"])
    for i in range(2):
        X.run_batches(_events(spark, d).select("event_id", "user_id"), each, f"{base}/cp{i}")
    return spark.read.parquet(f"{base}/data")


