"""Queries of the windows that streams use, over the tables as they are; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import views as v
from tidewater.plans.kit import r, registrar
from tidewater.streaming import streams

QUERIES, ORACLE, query = registrar()


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_weeks(spark, sf):
    return streams.windowed(v.table(spark, sf, "events"), "ts", ["event_type"], "value", "1 week").select("start", "event_type", "n", r("total", 4))


@query("""WITH g AS (SELECT e.*, unnest([0, 1]) AS k FROM events e) SELECT CAST(date_trunc('day', ts) - INTERVAL (k) DAY AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY 1, 2""")
def sliding_days(spark, sf):
    return streams.windowed(v.table(spark, sf, "events"), "ts", ["event_type"], "value", "2 days", "1 day").select("start", "event_type", "n", r("total", 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return streams.sessions(v.table(spark, sf, "events"), "ts", ["user_id"], "6 hours").select("user_id", "start", F.col("n"))
