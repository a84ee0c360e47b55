"""Registered DataFrame / SQL pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import patterns as P
from lakeline.operators import quality as Q
from lakeline.plans.catalog import register
from lakeline.plans.fixtures import Fixtures
from lakeline.plans.oracle import VIEWS, sql
from lakeline.plans.q_lineage import jsonify


def cents(c):
    """Exact integer cents of a 2-decimal double (sums independent of order)."""
    return F.round(F.col(c) * 100).cast("long")


CENTS_SQL = "CAST(round({c} * 100) AS BIGINT)"


@register("rel_filter_agg_sort", """
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_price,
       round(avg(CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END), 6) AS avg_unit_price
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'
GROUP BY l_returnflag, l_linestatus ORDER BY sum_price DESC""")
def q_rel_filter_agg_sort(spark, sf):
    li = Fixtures(spark, sf).lineitem
    r = P.rel_filter_agg_sort(
        li, F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), ["l_returnflag", "l_linestatus"],
        {"sum_qty": F.col("l_quantity").cast("decimal(18,2)"),
         "sum_price": F.col("l_extendedprice").cast("decimal(18,2)")},
        ("avg_unit_price", P.safe_div(F.col("l_extendedprice"), F.col("l_quantity"))), "sum_price")
    return r.select("l_returnflag", "l_linestatus", F.col("sum_qty").cast("double").alias("sum_qty"),
                    F.col("sum_price").cast("double").alias("sum_price"),
                    F.round("avg_unit_price", 6).alias("avg_unit_price"))


@register("rel_project_expr", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price,
       l_extendedprice * 100 AS price_cents,
       l_extendedprice * (1 - l_discount) AS net_price
FROM lineitem""")
def q_rel_project_expr(spark, sf):
    li = Fixtures(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     P.safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
                     (F.col("l_extendedprice") * 100).alias("price_cents"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"))


@register("rel_drop_nulls", sql("""
SELECT * FROM runs WHERE run_id IS NOT NULL AND job_id IS NOT NULL AND state IS NOT NULL
  AND started_at IS NOT NULL AND ended_at IS NOT NULL""", "runs"))
def q_rel_drop_nulls(spark, sf):
    return P.rel_drop_nulls(Fixtures(spark, sf).runs())


@register("rel_null_inject", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def q_rel_null_inject(spark, sf):
    ev = Fixtures(spark, sf).events.select("event_id", "event_type", "value")
    return P.rel_null_inject(ev, "value", F.col("event_type") == "error")


@register("rel_concat", """
SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS kind
FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def q_rel_concat(spark, sf):
    f = Fixtures(spark, sf)
    c = f.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                          F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
                          F.lit("customer").alias("kind"))
    s = f.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
                          F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return P.rel_concat([c, s])


@register("rel_in_like", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE p_type IN ('PROMO', 'ECONOMY') AND (p_name LIKE '%red%' OR p_brand LIKE 'Brand#1%')""")
def q_rel_in_like(spark, sf):
    p = Fixtures(spark, sf).part
    return P.rel_in_like(p, "p_type", ["PROMO", "ECONOMY"], "p_name", ["%red%"]).select(
        "p_partkey", "p_name", "p_brand", "p_type").unionByName(
        P.rel_in_like(p.filter(~F.col("p_name").like("%red%")), "p_type", ["PROMO", "ECONOMY"], "p_brand",
                      ["Brand#1%"]).select("p_partkey", "p_name", "p_brand", "p_type"))


@register("rel_step_chain", """
SELECT year(o_orderdate) AS year, count(*) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""")
def q_rel_step_chain(spark, sf):
    return P.apply_steps(Fixtures(spark, sf).orders, [
        ("drop_open", lambda d: d.filter(F.col("o_orderstatus") != "O")),
        ("add_year", lambda d: d.withColumn("year", F.year("o_orderdate"))),
        ("yearly", lambda d: d.groupBy("year").agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))),
    ])


@register("join_inner_left", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, count(l.l_orderkey) AS n_items
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3""")
def q_join_inner_left(spark, sf):
    f = Fixtures(spark, sf)
    j = P.join_inner_left(f.orders, f.customer, "o_custkey", "c_custkey", f.lineitem, "o_orderkey", "l_orderkey",
                          "n_items")
    return j.select("o_orderkey", "o_custkey", "c_name", "n_items")


@register("join_asof", sql("""
SELECT t.trade_id, t.symbol, t.ts, p.price, p.ts AS ts_matched
FROM trades t ASOF JOIN prices p ON t.symbol = p.symbol AND t.ts >= p.ts""", "trades", "prices"))
def q_join_asof(spark, sf):
    f = Fixtures(spark, sf)
    return P.join_asof(f.trades(), f.prices(), ["symbol"], "ts", "ts", ["price"], "trade_id")


@register("join_existence", """
SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def q_join_existence(spark, sf):
    f = Fixtures(spark, sf)
    c = f.customer.select("c_custkey", "c_name")
    return P.join_existence(c, f.orders, "c_custkey", "o_custkey", "has_orders")


@register("win_running_sum", f"""
SELECT o_orderkey, o_custkey, o_orderdate,
       sum({CENTS_SQL.format(c='o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 100.0 AS running_total
FROM orders""")
def q_win_running_sum(spark, sf):
    o = Fixtures(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate",
                                          cents("o_totalprice").alias("c"))
    r = P.win_running_sum(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "c", "rc")
    return r.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("rc") / 100.0).alias("running_total"))


@register("win_dense_rank", """
SELECT c_custkey, c_nationkey, c_acctbal,
       dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS dense_rank
FROM customer""")
def q_win_dense_rank(spark, sf):
    c = Fixtures(spark, sf).customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return P.win_dense_rank(c, ["c_nationkey"], "c_acctbal")


@register("win_rolling_mean", f"""
SELECT event_id, user_id, ts, row_number() OVER w AS pos,
       CASE WHEN count(*) OVER w7 = 7 THEN sum({CENTS_SQL.format(c='value')}) OVER w7 / 700.0 END AS rolling_mean
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
       w7 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_win_rolling_mean(spark, sf):
    e = Fixtures(spark, sf).events.select("event_id", "user_id", "ts", cents("value").alias("vc"))
    r = P.win_rolling_mean(e, ["user_id"], ["ts", "event_id"], "vc", 7)
    return r.select("event_id", "user_id", "ts", "pos", "rolling_mean")


@register("win_lag_diff", """
SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff
FROM events""")
def q_win_lag_diff(spark, sf):
    e = Fixtures(spark, sf).events.select("event_id", "user_id", "ts", "value")
    return P.win_lag_diff(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "diff")


@register("win_first_value_ratio", """
, m AS (SELECT c.c_mktsegment AS segment, date_trunc('month', o.o_orderdate) AS month,
               count(DISTINCT o.o_custkey) AS active
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2)
SELECT segment, month, active,
       active / first_value(active) OVER (PARTITION BY segment ORDER BY month) AS ratio FROM m"""
          .replace("\n, m AS", "WITH m AS", 1))
def q_win_first_value_ratio(spark, sf):
    f = Fixtures(spark, sf)
    o = f.orders.join(f.customer, F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_mktsegment").alias("segment"),
                  F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.count_distinct("o_custkey").alias("active"))
    return P.win_first_value_ratio(m, ["segment"], "month", "active")


@register("cohort_retention", f"""
WITH f AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS cohort_month FROM orders GROUP BY 1),
o AS (SELECT o.*, f.cohort_month,
        (year(o.o_orderdate) - year(f.cohort_month)) * 12 + (month(o.o_orderdate) - month(f.cohort_month)) AS months_since
      FROM orders o JOIN f USING (o_custkey)),
g AS (SELECT cohort_month, months_since, count(DISTINCT o_custkey) AS users,
        sum({CENTS_SQL.format(c='o_totalprice')}) AS rev_cents FROM o GROUP BY 1, 2),
s AS (SELECT cohort_month, count(*) AS cohort_size FROM f GROUP BY 1)
SELECT g.cohort_month, months_since, users, rev_cents / 100.0 AS revenue,
       rev_cents / 100.0 / users AS revenue_per_user,
       sum(rev_cents) OVER (PARTITION BY g.cohort_month ORDER BY months_since
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 100.0 AS cumulative_revenue,
       lag(rev_cents) OVER (PARTITION BY g.cohort_month ORDER BY months_since) / 100.0 AS previous_revenue,
       users / cohort_size AS retention
FROM g JOIN s ON s.cohort_month = g.cohort_month""")
def q_cohort_retention(spark, sf):
    o = Fixtures(spark, sf).orders.withColumn("c", cents("o_totalprice"))
    return P.cohort_retention(o, "o_custkey", "o_orderdate", "c")


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium",
              "4-NOT SPECIFIED": "not_specified", "5-LOW": "low"}


@register("rs_pivot", "SELECT o_orderstatus, " + ", ".join(
    f"CAST(sum(CASE WHEN o_orderpriority = '{k}' THEN CAST(o_totalprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS {v}"
    for k, v in PRIORITIES.items()) + " FROM orders GROUP BY o_orderstatus")
def q_rs_pivot(spark, sf):
    o = Fixtures(spark, sf).orders
    p = P.rs_pivot(o, ["o_orderstatus"], "o_orderpriority", PRIORITIES,
                   F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    return p.select("o_orderstatus", *[F.col(v).cast("double").alias(v) for v in PRIORITIES.values()])


@register("rs_recursive", f"""
WITH RECURSIVE employees AS ({VIEWS['employees']}),
t(node, parent, level) AS (
  SELECT employee_id, manager_id, 0 FROM employees WHERE manager_id IS NULL
  UNION ALL SELECT e.employee_id, e.manager_id, t.level + 1 FROM employees e JOIN t ON e.manager_id = t.node)
SELECT node, parent, level FROM t""")
def q_rs_recursive(spark, sf):
    emp = Fixtures(spark, sf).employees()
    return P.rs_recursive(emp, "employee_id", "manager_id")


@register("rs_list_agg", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
             (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS page
           FROM orders)
SELECT o_custkey, page,
       to_json(list({'d': strftime(o_orderdate, '%Y-%m-%d'), 'k': o_orderkey, 'price': o_totalprice}
                    ORDER BY o_orderdate, o_orderkey)) AS orders,
       to_json(list(o_orderkey ORDER BY o_orderdate, o_orderkey)) AS order_keys
FROM p GROUP BY o_custkey, page""")
def q_rs_list_agg(spark, sf):
    o = Fixtures(spark, sf).orders
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderkey").alias("k"),
                    F.col("o_totalprice").alias("price"))
    p = P.rs_list_agg(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], item, "orders")
    return p.select("o_custkey", "page", jsonify("orders").alias("orders"),
                    F.to_json(F.transform("orders", lambda x: x["k"])).alias("order_keys"))


@register("agg_distinct", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS orders
FROM orders GROUP BY 1""")
def q_agg_distinct(spark, sf):
    return P.agg_distinct(Fixtures(spark, sf).orders, ["o_orderpriority"], "o_custkey", "customers") \
        .withColumnRenamed("rows", "orders")


@register("agg_conditional", """
SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted,
       max(CASE WHEN l_linestatus = 'O' THEN l_shipdate END) AS last_open_ship,
       CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large_lines
FROM lineitem GROUP BY 1""")
def q_agg_conditional(spark, sf):
    return P.agg_conditional(Fixtures(spark, sf).lineitem, ["l_returnflag"], {
        "discounted": F.count(F.when(F.col("l_discount") > 0.05, 1)),
        "last_open_ship": F.max(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))),
        "large_lines": F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).cast("long")})


@register("topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_topk(spark, sf):
    o = Fixtures(spark, sf).orders
    return P.topk(o, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@register("ts_ohlc", """
SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_start,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, count(*) AS ticks
FROM events GROUP BY 1, 2""")
def q_ts_ohlc(spark, sf):
    return P.ts_ohlc(Fixtures(spark, sf).events, "event_type", "ts", "value", "event_id", "hour")


@register("ts_continuity", """
WITH b AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_start,
             arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close
           FROM events GROUP BY 1, 2)
SELECT instrument, bar_start, open, lag(close) OVER (PARTITION BY instrument ORDER BY bar_start) AS prev_close,
       open = lag(close) OVER (PARTITION BY instrument ORDER BY bar_start) AS continuous FROM b""")
def q_ts_continuity(spark, sf):
    bars = P.ts_ohlc(Fixtures(spark, sf).events, "event_type", "ts", "value", "event_id", "hour")
    return P.ts_continuity(bars)


EXPECTED_LINEITEM = {"l_orderkey": "BIGINT", "l_quantity": "INTEGER", "l_shipdate": "TIMESTAMP",
                     "l_comment": "VARCHAR", "l_tax": "DOUBLE"}


@register("dq_schema", """
WITH expected(col, typ) AS (VALUES ('l_orderkey', 'BIGINT'), ('l_quantity', 'INTEGER'),
       ('l_shipdate', 'TIMESTAMP'), ('l_comment', 'VARCHAR'), ('l_tax', 'DOUBLE')),
actual AS (SELECT column_name AS col, data_type AS typ FROM information_schema.columns WHERE table_name = 'lineitem')
SELECT e.col AS "column", CASE WHEN a.col IS NULL THEN 'missing_column' ELSE 'type_mismatch' END AS problem,
       e.typ AS expected, a.typ AS actual
FROM expected e LEFT JOIN actual a ON a.col = e.col WHERE a.col IS NULL OR a.typ <> e.typ""")
def q_dq_schema(spark, sf):
    return Q.dq_schema(spark, Fixtures(spark, sf).lineitem, EXPECTED_LINEITEM)


DOC_RULES = {"text": ["non_empty"], "lang": ["not_null", "non_empty"], "n_chars": ["finite", "non_negative"],
             "source": ["non_empty"], "title": ["not_null"]}


@register("dq_rules", """
SELECT "column", rule, violations, (SELECT count(*) FROM documents) AS checked FROM (
  SELECT 'text' AS "column", 'non_empty' AS rule, count(*) FILTER (WHERE text IS NULL OR length(trim(text)) = 0) AS violations FROM documents
  UNION ALL SELECT 'lang', 'not_null', count(*) FILTER (WHERE lang IS NULL) FROM documents
  UNION ALL SELECT 'lang', 'non_empty', count(*) FILTER (WHERE lang IS NULL OR length(trim(lang)) = 0) FROM documents
  UNION ALL SELECT 'n_chars', 'finite', count(*) FILTER (WHERE n_chars IS NOT NULL AND (isnan(n_chars::DOUBLE) OR abs(n_chars::DOUBLE) = 'inf'::DOUBLE)) FROM documents
  UNION ALL SELECT 'n_chars', 'non_negative', count(*) FILTER (WHERE n_chars < 0) FROM documents
  UNION ALL SELECT 'source', 'non_empty', count(*) FILTER (WHERE source IS NULL OR length(trim(source)) = 0) FROM documents
  UNION ALL SELECT 'title', 'column_present', count(*) FROM documents) v""")
def q_dq_rules(spark, sf):
    return Q.dq_rules(Fixtures(spark, sf).documents, DOC_RULES)


@register("dq_col_bytes", """
SELECT "column", dtype, bytes FROM (
  SELECT 'l_orderkey' AS "column", 'BIGINT' AS dtype, count(*) * 8 AS bytes FROM lineitem
  UNION ALL SELECT 'l_partkey', 'BIGINT', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_suppkey', 'BIGINT', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_linenumber', 'INTEGER', count(*) * 4 FROM lineitem
  UNION ALL SELECT 'l_quantity', 'DOUBLE', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'DOUBLE', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_discount', 'DOUBLE', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_tax', 'DOUBLE', count(*) * 8 FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'VARCHAR', CAST(coalesce(sum(octet_length(encode(l_returnflag))), 0) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_linestatus', 'VARCHAR', CAST(coalesce(sum(octet_length(encode(l_linestatus))), 0) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'l_shipdate', 'TIMESTAMP', count(*) * 8 FROM lineitem) v""")
def q_dq_col_bytes(spark, sf):
    return Q.dq_col_bytes(Fixtures(spark, sf).lineitem)


@register("dq_agg_invariant", f"""
SELECT CAST((SELECT sum(s) FROM (SELECT sum({CENTS_SQL.format(c='o_totalprice')}) AS s FROM orders GROUP BY o_custkey)) AS BIGINT) AS sum_of_groups,
       CAST(sum({CENTS_SQL.format(c='o_totalprice')}) AS BIGINT) AS total,
       (SELECT sum(s) FROM (SELECT sum({CENTS_SQL.format(c='o_totalprice')}) AS s FROM orders GROUP BY o_custkey))
         = sum({CENTS_SQL.format(c='o_totalprice')}) AS consistent,
       count(*) FILTER (WHERE o_totalprice < 0) AS negatives
FROM orders""")
def q_dq_agg_invariant(spark, sf):
    return Q.dq_agg_invariant(Fixtures(spark, sf).orders, "o_custkey", cents("o_totalprice"))


@register("dq_describe", """
SELECT ordinal_position - 1 AS position, column_name AS "column", data_type,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS row_count,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') * 100 AS est_bytes
FROM information_schema.columns WHERE table_name = 'orders'""")
def q_dq_describe(spark, sf):
    o = Fixtures(spark, sf).orders.filter(F.col("o_orderstatus") != "O")
    return Q.dq_describe(o)
