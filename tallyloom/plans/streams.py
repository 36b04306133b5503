"""Queries of the streaming operators: the events table read as a stream, all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.registry import Registry
from tallyloom.session import table, workdir
from tallyloom.streaming import ingest

R = Registry()
query = R.query


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return ingest.table_stream(spark, d, "events", schema, time_col="ts")


def _collected(spark, stream, name, mode="append"):
    """Runs a stream into a Parquet table and reads it back."""
    out, check = workdir(spark, name), workdir(spark, f"{name}-offsets")
    schema = stream.schema
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    else:
        sink = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("select event_type, count(*) n, count(distinct event_id) n_ids from events group by 1")
def stream_dedup(spark, d):
    """The stream read twice over: each event once within the watermark."""
    e = _events(spark, d)
    u = ingest.once(e.unionByName(_events(spark, d)).select("event_id", "ts", "event_type"), ["event_id"], "ts", "400 days")
    return _collected(spark, u, "dedup").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("select epoch(date_trunc('hour', ts))::bigint start_s, event_type, count(*) n from events group by 1, 2")
def stream_tumbling(spark, d):
    w = ingest.tumbling(_events(spark, d), "ts", "1 hour", ["event_type"], "400 days")
    out = _collected(spark, w.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n"), "tumbling", "complete")
    return out


@query("""
with s as (select floor(epoch(ts) / 1800)::bigint * 1800 b from events), w as (select b start_s from s union all select b - 1800 from s) select start_s, count(*) n from w group by 1""")
def stream_sliding(spark, d):
    w = ingest.sliding(_events(spark, d), "ts", "1 hour", "30 minutes", [], "400 days")
    return _collected(spark, w.select(F.unix_seconds("window.start").alias("start_s"), "n"), "sliding", "complete")


@query("""
with o as (select user_id, epoch_us(ts) t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end b from events), g as (select *, sum(b) over (partition by user_id order by t rows unbounded preceding) g from o)
select user_id, min(t)::bigint start_us, count(*) n from g group by user_id, g""")
def stream_sessions(spark, d):
    """Sessions of every user."""
    return _sessions(spark, _events(spark, d))


def _sessions(spark, events):
    w = ingest.sessions(events, "ts", "30 minutes", ["user_id"], "400 days")
    out = w.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")
    return _collected(spark, out, "sessions", "complete")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1")
def stream_upsert(spark, d):
    """Latest event of each user, kept by a sink that may see a batch again."""
    out = workdir(spark, "upsert")
    e = _events(spark, d).select("user_id", "event_id", "event_type")
    ingest.run_available(e, ingest.upserting(out, ["user_id"], "event_id"), workdir(spark, "upsert-offsets"))
    return spark.read.parquet(out).select("user_id", "event_id")


@query("select event_id, value from events where event_id % 4 <> 0 or value > 50 or value is null")
def changed_only(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    old = e.where("event_id % 4 = 0 and value <= 50")
    return ingest.changed_only(old, e, ["event_id"], ["value"])
