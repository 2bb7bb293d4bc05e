"""Streaming queries: the events table read as a stream of files, and their batch equals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.streaming import jobs as J

from .registry import Tables, query


def _events(t: Tables) -> DataFrame:
    stream = J.event_stream(t.spark, f"{t.sf_dir}/events.parquet", "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(t: Tables) -> DataFrame:
    """Complete results, whatever is left open by the watermark."""
    return _events(t)


@query("sm1_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def micro_batches(t: Tables) -> DataFrame:
    """Running counts, of which the last batch is kept."""
    counted = J.drain(_events(t).groupBy("event_type").agg(F.count("*").alias("n")), "complete")
    last = counted.agg(F.max("_batch")).scalar()
    return counted.filter(F.col("_batch") == last).select("event_type", "n")


@query("sm6_tumbling_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(t: Tables) -> DataFrame:
    out = J.drain(J.tumbling(_finished(t), "ts", "1 day", "7 days", "event_type"), "complete")
    last = out.agg(F.max("_batch")).scalar()
    return out.filter(F.col("_batch") == last).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("sm6_sliding_windows", "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS s FROM events, range(4) r(i)) SELECT epoch_us(s) AS start_us, count(*) AS n FROM w GROUP BY s")
def sliding_windows(t: Tables) -> DataFrame:
    out = J.drain(J.sliding(_finished(t), "ts", "1 day", "6 hours", "7 days"), "complete")
    last = out.agg(F.max("_batch")).scalar()
    return out.filter(F.col("_batch") == last).select(F.unix_micros("start").alias("start_us"), "n")


@query("sm7_session_windows", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(t: Tables) -> DataFrame:
    out = J.drain(J.sessions(_finished(t), "ts", "2 hours", "7 days", "user_id"), "complete")
    last = out.agg(F.max("_batch")).scalar()
    return out.filter(F.col("_batch") == last).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("sm2_change_feed", "SELECT DISTINCT user_id, event_type FROM events")
def change_feed(t: Tables) -> DataFrame:
    """Each (user, type) once, as it first comes."""
    return J.drain(J.deduplicated(_events(t).select("ts", "user_id", "event_type"), "ts", "60 days", "user_id", "event_type")).select("user_id", "event_type")


@query("sm12_decayed_state", "SELECT user_id, round(sum(pow(0.5::DOUBLE, (m - epoch_us(ts)) / 1000000.0::DOUBLE / 2592000.0::DOUBLE)), 6) AS weight FROM events JOIN (SELECT user_id, max(epoch_us(ts)) AS m FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id")
def decayed_state(t: Tables) -> DataFrame:
    out = J.drain(J.decayed_counters(_events(t), "user_id", "ts", 30 * 86400.0), "update")
    best = out.groupBy("user_id").agg(F.max_by("weight", "_batch").alias("weight"))
    return best.select("user_id", F.round("weight", 6).alias("weight"))


@query("sm8_delivered_ranges", """WITH r AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type AS q, event_id % 7 AS lo, event_id % 7 + event_id % 3 AS hi, event_id FROM events), c AS (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY user_id ORDER BY t) = q THEN 0 ELSE 1 END AS c FROM r),
n AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, EXISTS (SELECT 1 FROM n e WHERE e.user_id = n.user_id AND e.lo <= n.lo AND e.hi >= n.hi AND e.run < n.run AND n.t - e.t <= 86400) AS seen FROM n""")
def delivered_ranges(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = t.events.select("user_id", at.alias("at"), F.col("event_type").alias("q"), (F.col("event_id") % 7).alias("lo"), (F.col("event_id") % 7 + F.col("event_id") % 3).alias("hi"), "event_id")
    return J.delivered_ranges(r, "user_id", "at", "q", "lo", "hi", 86400.0).select("event_id", "seen")


@query("sm16_output_filter", "SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS h FROM events WHERE event_type != 'view') WHERE near = 1 OR h <= 3")
def output_filter(t: Tables) -> DataFrame:
    """Noise goes, failures stay with their context, and so does the head."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("event_id")
    kept = t.events.filter("event_type != 'view'")
    near = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(by.rowsBetween(-1, 1))
    return kept.withColumn("near", near).withColumn("h", F.row_number().over(by)).filter("near = 1 OR h <= 3").select("event_id")


@query("sm7_session_assembly", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS requests, count(*) FILTER (WHERE role = 'assistant') AS answers, count(DISTINCT text) AS texts, arg_min(md5(text), turn) AS first FROM conversations GROUP BY conv_id")
def session_assembly(t: Tables) -> DataFrame:
    """A conversation folded into counts and its first text."""
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("requests"), F.count_if(F.col("role") == "assistant").alias("answers"), F.countDistinct("text").alias("texts"), F.md5(F.min_by("text", "turn").cast("binary")).alias("first"))
