"""Batch forms of the streaming operators over the events, and time windows (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.registry import query
from lodestone.streaming import changes


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, sf_dir):
    out = changes.tumbling(b.table(spark, sf_dir, "events"), "6 hours")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, session")
def ext_session(spark, sf_dir):
    out = changes.sessions(b.table(spark, sf_dir, "events"), "2 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(json_extract_string(props, '$.k')::INTEGER) AS max_k FROM events GROUP BY 1")
def event_profile(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.max(k).alias("max_k"))
