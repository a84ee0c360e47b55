"""Registered access-scoped and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import access as A
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import VIEWS, sql


@register("sec_tenant", sql("""
SELECT * FROM tenant_requests WHERE tenant = 'NATION_7'""", "requests", "tenant_requests"))
def q_sec_tenant(spark, sf):
    return A.secured(Fixtures(spark, sf).tenant_requests(), "NATION_7")


@register("sec_recent", sql("""
SELECT * FROM requests WHERE start_time >= (SELECT max(start_time) FROM requests) - INTERVAL 9 DAY""", "requests"))
def q_sec_recent(spark, sf):
    return A.sec_recent(Fixtures(spark, sf).requests(), "start_time", 9)


@register("sec_roles", f"""
WITH RECURSIVE employees AS ({VIEWS['employees']}),
e AS (SELECT 'role_' || employee_id AS anc, 'role_' || manager_id AS nxt FROM employees WHERE manager_id IS NOT NULL),
roles AS (SELECT anc AS role FROM e UNION SELECT nxt FROM e),
c(role, anc) AS (SELECT role, role FROM roles UNION SELECT c.role, e.nxt FROM c JOIN e ON e.anc = c.anc),
g AS (SELECT 'role_' || employee_id AS role, 'SELECT' AS privilege, 'nation_' || nation_id AS object FROM employees)
SELECT DISTINCT c.role, g.privilege, g.object FROM c JOIN g ON g.role = c.anc""")
def q_sec_roles(spark, sf):
    f = Fixtures(spark, sf)
    return A.sec_roles(f.role_edges(), f.grants())


DAILY_SQL = """SELECT date_trunc('day', start_time) AS day, tenant, count(*) AS events,
       sum(CAST(round(duration * 10000) AS BIGINT)) / 10000.0 AS total,
       sum(CAST(round(duration * 10000) AS BIGINT)) / count(duration) / 10000.0 AS average
FROM tenant_requests GROUP BY 1, 2"""


@register("rep_daily", sql(DAILY_SQL, "requests", "tenant_requests"))
def q_rep_daily(spark, sf):
    return A.rep_daily(Fixtures(spark, sf).tenant_requests(), "start_time", "tenant", "duration", 10000)


@register("rep_daily_last30", sql(f"""
, d AS ({DAILY_SQL})
SELECT * FROM d WHERE day >= TIMESTAMP '2024-02-09' - INTERVAL 30 DAY""", "requests", "tenant_requests"))
def q_rep_daily_last30(spark, sf):
    d = A.rep_daily(Fixtures(spark, sf).tenant_requests(), "start_time", "tenant", "duration", 10000)
    return A.rep_daily_last(d, 30, asof=F.lit("2024-02-09").cast("timestamp_ntz"))


@register("rep_activity", """
SELECT conv_id, turn, role, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview
FROM conversations WHERE role IN ('user', 'system')""")
def q_rep_activity(spark, sf):
    c = Fixtures(spark, sf).conversations
    return A.rep_activity(c, "role", ["user", "system"], "text")


@register("rep_query_hourly", sql("""
SELECT "user", date_trunc('hour', start_time) AS hour, count(*) AS queries,
       sum(CAST(round(duration * 10000) AS BIGINT)) / count(duration) / 10000.0 AS avg_duration,
       count(CASE WHEN status_code = 200 THEN 1 END) AS active
FROM tenant_requests WHERE "user" LIKE 'BUILDING\\_%' ESCAPE '\\' OR "user" LIKE 'MACHINERY\\_%' ESCAPE '\\'
GROUP BY 1, 2""", "requests", "tenant_requests"))
def q_rep_query_hourly(spark, sf):
    r = Fixtures(spark, sf).tenant_requests()
    return A.rep_query_hourly(r, "user", "start_time", "duration", F.col("status_code") == 200,
                              ["BUILDING\\_%", "MACHINERY\\_%"], 10000)


@register("rep_dashboard_daily", """
SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS dau, count(*) AS events,
       coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END), 0) / 100.0 AS revenue,
       sum(CAST(round(value * 100) AS BIGINT)) / count(value) / 100.0 AS avg_session
FROM events WHERE ts >= TIMESTAMP '2024-04-10 12:00:00' - INTERVAL 90 DAY GROUP BY 1""")
def q_rep_dashboard_daily(spark, sf):
    return A.rep_dashboard_daily(Fixtures(spark, sf).events, 90, asof=F.lit("2024-04-10 12:00:00").cast("timestamp_ntz"))


@register("rep_week_cohorts", """
WITH f AS (SELECT user_id, date_trunc('week', min(ts)) AS cohort_week FROM events GROUP BY 1)
SELECT f.cohort_week, CAST(date_diff('day', f.cohort_week, date_trunc('week', e.ts)) / 7 AS INTEGER) AS weeks_since,
       count(DISTINCT e.user_id) AS users
FROM events e JOIN f USING (user_id) GROUP BY 1, 2""")
def q_rep_week_cohorts(spark, sf):
    return A.rep_week_cohorts(Fixtures(spark, sf).events)
