"""Queries that run a stream over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpline.plans.registry import R, Registry, rounded
from chirpline.session import staging_path, table
from chirpline.streaming import levels

q = Registry()
QUERIES, ORACLES = q.queries, q.sql


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return s.select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("x"))


@q(f"SELECT user_id AS rec_id, date_trunc('hour', ts) AS start, {R('10 * log10(avg(value * value))', 'leq')}, count(*) AS n FROM events GROUP BY 1, 2")
def stream_leq_tumbling(spark, d):
    out = levels.drain(levels.windowed_leq(_stream(spark, d)), "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@q(f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS edge FROM events WHERE value >= 50),
  s AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id AS rec_id, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS n, {R('max(value)', 'peak')} FROM s GROUP BY user_id, k""")
def stream_session_events(spark, d):
    out = levels.drain(levels.session_events(_stream(spark, d), 50.0, "12 hours"), "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))


@q(f"""WITH v AS (SELECT user_id AS rec_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  m AS (SELECT a.rec_id, a.event_id, any_value(a.x) AS x, sum(b.x * 0.025::DOUBLE * pow(0.975::DOUBLE, a.i - b.i)) AS m FROM v a JOIN v b ON a.rec_id = b.rec_id AND b.i <= a.i GROUP BY 1, 2)
  SELECT rec_id, event_id, {R('sqrt(x * pow(m + 1e-6::DOUBLE, -0.98::DOUBLE) + 2) - sqrt(2)', 'out')} FROM m""")
def stream_pcen_state(spark, d):
    return rounded(levels.drain(levels.pcen(_stream(spark, d)), "append").select("rec_id", "event_id", "out"))


@q(f"""WITH s AS (SELECT user_id AS rec_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, value AS x FROM events, (SELECT unnest(range(0, 3)) AS k))
  SELECT rec_id, start, {R('10 * log10(avg(x * x))', 'leq')}, count(*) AS n FROM s GROUP BY 1, 2""")
def stream_leq_sliding(spark, d):
    """Windows of three hours that begin every hour."""
    out = levels.drain(levels.windowed_leq(_stream(spark, d), "3 hours", "1 hour"), "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


# the second delivery repeats every tenth event of the first half of time: all lie behind the watermark by then
@q(f"""WITH m AS (SELECT max(ts) AS last, min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events)
  SELECT user_id AS rec_id, date_trunc('hour', ts) AS start, {R('10 * log10(avg(value * value))', 'leq')}, count(*) AS n FROM events, m GROUP BY 1, 2 HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= any_value(last) - INTERVAL 10 MINUTES""")
def stream_late_rows(spark, d):
    """Late rows are dropped: what arrives again long after its window has closed changes nothing, and open windows aren't given yet."""
    folder = staging_path(spark, "deliveries")
    events = table(spark, d, "events")
    middle = events.agg((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) / 2 + F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 2).alias("m")).first().m
    # files are taken in the order of their times, one a batch
    events.coalesce(1).write.mode("append").parquet(f"{folder}/a")
    # a batch drops what is late by the watermark that the batch before it began with
    events.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/between")
    late = events.where((F.unix_micros(F.col("ts").cast("timestamp")) < middle) & (F.col("event_id") % 10 == 0))
    late.coalesce(1).write.mode("append").parquet(f"{folder}/b")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    stream = stream.select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("x"))
    out = levels.drain(levels.windowed_leq(stream), "append")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))
