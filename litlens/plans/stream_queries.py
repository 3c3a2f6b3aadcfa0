"""Registered queries of group L: streams whose results equal the batch ones."""

from __future__ import annotations

from litlens.plans.base import query
from litlens.streaming import windows as L


@query("l2_distinct_events", "SELECT count(DISTINCT user_id || '-' || event_type) AS n FROM events")
def l2(spark, sf):
    return L.run_append(L.distinct_events(L.events(spark, f"{sf}/events.parquet"), ["user_id", "event_type"])).selectExpr("count(*) AS n")


@query("l3_day_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l3(spark, sf):
    return L.run_merged(L.day_counts(L.events(spark, f"{sf}/events.parquet")), ["day", "event_type"])


@query("l4_activity", "SELECT w AS week, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP - unnest(range(0, 7)) * INTERVAL 1 DAY AS w FROM events) GROUP BY 1, 2")
def l4(spark, sf):
    return L.run_merged(L.activity(L.events(spark, f"{sf}/events.parquet")), ["week", "event_type"])


@query("l5_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k")
def l5(spark, sf):
    return L.run_merged(L.sessions(L.events(spark, f"{sf}/events.parquet")), ["user_id", "start"])
