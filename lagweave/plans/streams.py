"""Queries of event-time windows; their streaming forms are the same functions over a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.signals import table
from ..streaming import windows
from .registry import query


@query("SELECT date_trunc('day', ts) AS start, count(*) AS c, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1", "")
def sx_02_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH s AS (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events) SELECT unnest([b, b - INTERVAL 12 HOURS]) AS start, count(*) AS c FROM s GROUP BY 1", "")
def sx_03_sliding(spark, d):
    return windows.sliding(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS c FROM s GROUP BY user_id, k""", "")
def sx_04_sessions(spark, d):
    return windows.sessions(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
