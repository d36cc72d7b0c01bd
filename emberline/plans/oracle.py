"""DuckDB SQL for the registered queries, written on its own from the rules, not from the Spark code.

``_INPUTS`` holds the domain tables over the given ones; ``_SQL`` one statement per query. A
statement names the inputs it needs as ``in_…`` and ``oracle_sql`` puts them in front of it.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "DATE '2001-08-02'"


def r(x: str, places: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), {places}) AS DOUBLE)"


def m(x: str, kind: str = "DECIMAL(28,6)") -> str:
    return f"CAST(sum(CAST({x} AS {kind})) AS DOUBLE) / nullif(count({x}), 0)"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def i(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def even_cents(thousandfold: str, divisor: int | str) -> str:
    """Half-even division of a whole number; the result in cents as DECIMAL."""
    a = f"abs({thousandfold})"
    q = f"({a} // {divisor} + CASE WHEN {a} % {divisor} * 2 > {divisor} OR ({a} % {divisor} * 2 = {divisor} AND ({a} // {divisor}) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CAST(sign({thousandfold}) * {q} AS DECIMAL(28,2)) / 100"


def cents(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,8)), 2) AS DECIMAL(14,2))"


RANK = "CASE {0} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END"
TRIAGE = "CASE {0} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
SEVERITY_OF = "CASE {0} WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' END"


def hourly(source: str) -> str:
    return f"""
    SELECT g.device_id, g.metric_name, g.hour_start, {i('year(g.hour_start)')} AS hour_year, {i('month(g.hour_start)')} AS hour_month,
           g.sample_count, g.min_value, g.max_value, g.avg_value, q.metric_value AS p95_value, g.stddev_value
    FROM (SELECT device_id, metric_name, reading_bucket_hour AS hour_start, count(*) AS sample_count,
                 min(metric_value) AS min_value, max(metric_value) AS max_value,
                 {r(m('metric_value'))} AS avg_value, {r("stddev_pop(CAST(metric_value AS DOUBLE))")} AS stddev_value
          FROM {source} GROUP BY ALL) g
    JOIN (SELECT device_id, metric_name, reading_bucket_hour AS hour_start, metric_value,
                 row_number() OVER (PARTITION BY device_id, metric_name, reading_bucket_hour ORDER BY metric_value) AS place,
                 count(*) OVER (PARTITION BY device_id, metric_name, reading_bucket_hour) AS n
          FROM {source}) q
      ON q.device_id = g.device_id AND q.metric_name = g.metric_name AND q.hour_start = g.hour_start
     AND q.place = greatest(q.n * 95 // 100, 1)"""


def sessionized(gap: str) -> str:
    return f"""
    SELECT customer_id, {i('n')} AS session_number, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count,
           count(*) FILTER (event_type = 'view') AS page_views, count(*) FILTER (event_type = 'click') AS cart_additions
    FROM (SELECT *, sum(opens) OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS n
          FROM (SELECT CAST(user_id AS VARCHAR) AS customer_id, ts, event_id, event_type,
                       CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {gap} THEN 0 ELSE 1 END AS opens
                FROM events))
    GROUP BY customer_id, n"""


_INPUTS: dict[str, str] = {
    "in_readings": """
        SELECT CAST(user_id AS VARCHAR) AS device_id, date_trunc('hour', ts) AS reading_bucket_hour, ts AS reading_timestamp,
               event_type AS metric_name, CAST(value AS DECIMAL(18,4)) AS metric_value, 'u' AS unit,
               CASE event_id % 10 WHEN 0 THEN 'bad' WHEN 1 THEN 'suspect' ELSE 'good' END AS quality_code FROM events""",
    "in_dense": """
        SELECT CAST(user_id % 4 AS VARCHAR) AS device_id, date_trunc('hour', ts) AS reading_bucket_hour, 'value' AS metric_name,
               CAST(value AS DECIMAL(18,4)) AS metric_value FROM events""",
    "in_old": f"SELECT * FROM in_readings WHERE reading_timestamp < {NOW} - INTERVAL 24 HOUR",
    "in_hot": f"SELECT * FROM in_readings WHERE reading_timestamp >= {NOW} - INTERVAL 24 HOUR AND reading_timestamp < {NOW}",
    "in_hourly": hourly("in_old"),
    "in_devices": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS device_id, 'sensor' AS device_type, c_mktsegment AS device_class,
               'M' || (c_custkey % 3) AS model, '1.' || (c_custkey % 5) AS firmware_version,
               CASE c_custkey % 7 WHEN 4 THEN 'offline' WHEN 5 THEN 'degraded' WHEN 6 THEN 'maintenance' ELSE 'online' END AS status,
               CASE WHEN c_custkey % 11 <> 0 THEN seen END AS last_heartbeat, CAST(c_acctbal AS DECIMAL(18,4)) AS last_reading_value,
               {i('5 + c_custkey % 95')} AS battery_percent, {i('-30 - c_custkey % 70')} AS signal_strength_dbm,
               'SITE-' || c_nationkey AS site_id, 'Z' || (c_custkey % 10) AS zone,
               TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INTEGER)) AS installed_at,
               CASE WHEN c_custkey % 11 <> 0 THEN seen END AS updated_at
        FROM customer JOIN (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) ON user_id = c_custkey""",
    "in_alerts_all": """
        SELECT CAST(user_id AS VARCHAR) AS device_id, CAST(event_id AS VARCHAR) AS alert_id, ts AS raised_at,
               CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
               CASE event_id % 5 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'offline' WHEN 2 THEN 'battery_low' ELSE 'threshold' END AS alert_type,
               event_type AS metric_name, CAST(value AS DECIMAL(18,4)) AS metric_value, CAST(50 AS DECIMAL(18,4)) AS threshold_value,
               'SITE-' || c_nationkey AS site_id, event_id % 10 = 0 AS acknowledged
        FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error'""",
    "in_alerts": f"SELECT * FROM in_alerts_all WHERE raised_at >= {NOW} - INTERVAL 24 HOUR",
    "in_alerts_month": f"SELECT * FROM in_alerts_all WHERE raised_at >= {NOW} - INTERVAL 720 HOUR",
    "in_baseline": f"""
        SELECT device_id, metric_name, {m('avg_value')} AS baseline_avg, {d('max(p95_value)')} AS baseline_p95,
               {d('min(min_value)')} AS baseline_min, {d('max(max_value)')} AS baseline_max, {m('stddev_value')} AS baseline_stddev,
               {i('sum(sample_count)')} AS sample_count, count(*) AS baseline_hours
        FROM in_hourly WHERE hour_start >= {NOW} - INTERVAL 7 DAY GROUP BY device_id, metric_name""",
    "in_health": """
        SELECT s.device_id, s.metric_name,
               CASE WHEN b.baseline_hours IS NULL OR u.metric_value IS NULL THEN 'unknown'
                    WHEN u.metric_value > b.baseline_p95 THEN 'anomalous'
                    WHEN abs(u.metric_value - b.baseline_avg) > greatest(2 * b.baseline_stddev, 0.1 * b.baseline_avg) THEN 'anomalous'
                    ELSE 'normal' END AS anomaly_status,
               CASE WHEN b.baseline_hours IS NULL THEN 'no_baseline' WHEN u.metric_value IS NULL THEN 'no_usable_reading'
                    WHEN u.metric_value > b.baseline_p95 THEN 'above_p95'
                    WHEN abs(u.metric_value - b.baseline_avg) > greatest(2 * b.baseline_stddev, 0.1 * b.baseline_avg) THEN 'deviation' END AS reason_code,
               CASE WHEN b.baseline_hours IS NOT NULL AND u.metric_value IS NOT NULL THEN u.metric_value ELSE a.metric_value END AS metric_value,
               CASE WHEN b.baseline_hours IS NOT NULL AND u.metric_value IS NOT NULL THEN u.quality_code ELSE a.quality_code END AS quality_code,
               CASE WHEN b.baseline_hours IS NOT NULL AND u.metric_value IS NOT NULL THEN u.reading_timestamp ELSE a.reading_timestamp END AS reading_timestamp,
               s.recent_count, b.baseline_avg, b.baseline_p95, b.baseline_min, b.baseline_max, b.baseline_stddev, b.sample_count, b.baseline_hours
        FROM (SELECT device_id, metric_name, count(*) AS recent_count FROM in_hot GROUP BY ALL) s
        JOIN (SELECT DISTINCT ON (device_id, metric_name) device_id, metric_name, reading_timestamp, CAST(metric_value AS DOUBLE) AS metric_value, quality_code
              FROM in_hot ORDER BY device_id, metric_name, reading_timestamp DESC) a USING (device_id, metric_name)
        LEFT JOIN (SELECT DISTINCT ON (device_id, metric_name) device_id, metric_name, reading_timestamp, CAST(metric_value AS DOUBLE) AS metric_value, quality_code
              FROM in_hot WHERE quality_code IS DISTINCT FROM 'bad' ORDER BY device_id, metric_name, reading_timestamp DESC) u USING (device_id, metric_name)
        LEFT JOIN in_baseline b USING (device_id, metric_name)""",
    "in_alert_sum": f"""
        SELECT device_id, count(*) AS open_alert_count, {SEVERITY_OF.format('min(' + RANK.format('severity') + ')')} AS highest_alert_severity,
               bool_or(severity = 'critical') AS critical, bool_or(alert_type = 'anomaly') AS anomaly FROM in_alerts GROUP BY 1""",
    "in_metric_sum": """
        SELECT device_id, count(*) FILTER (anomaly_status = 'anomalous') AS anomaly_metric_count, sum(recent_count) AS seen FROM in_health GROUP BY 1""",
    "in_fleet": """
        SELECT v.*, CASE WHEN h.device_id IS NULL AND b.device_id IS NULL THEN 'unknown'
                         WHEN coalesce(h.anomaly_metric_count, 0) > 0 OR coalesce(a.anomaly, false) THEN 'anomalous' ELSE 'normal' END AS anomaly_status,
               coalesce(h.anomaly_metric_count, 0) AS anomaly_metric_count, a.highest_alert_severity, coalesce(a.open_alert_count, 0) AS open_alert_count
        FROM in_devices v LEFT JOIN in_alert_sum a USING (device_id) LEFT JOIN in_metric_sum h USING (device_id)
        LEFT JOIN (SELECT DISTINCT device_id FROM in_baseline) b USING (device_id)""",
    "in_weather": f"""
        SELECT 'SITE-' || c_nationkey AS site_id, date_trunc('hour', ts) AS observation_time,
               {r('(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*)) % 40', 2)} AS temperature_c,
               {d('count(*) % 100')} AS humidity_pct,
               CASE hour(date_trunc('hour', ts)) % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'cloudy' ELSE 'rain' END AS conditions
        FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""",
    "in_site_days": """
        SELECT 'SITE-' || c_nationkey AS site_id, CAST(ts AS DATE) AS summary_date, count(*) AS readings_received,
               count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) AS alerts_critical,
               count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*) AS uptime_pct,
               CAST(sum(5 + user_id % 95) AS DOUBLE) / count(*) AS avg_battery_pct
        FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""",
    "in_failures": """
        SELECT CAST(event_id AS VARCHAR) AS failure_id, CAST(user_id AS VARCHAR) AS device_id, ts AS failure_timestamp,
               '1.' || (user_id % 5) AS firmware_version FROM events WHERE event_type = 'error' AND event_id % 20 = 0""",
    "in_windows": """
        SELECT CAST(event_id AS VARCHAR) AS window_id, 'SITE-' || c_nationkey AS site_id, ts AS window_start,
               ts + to_minutes(CAST(event_id % 600 AS INTEGER)) AS window_end
        FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'signup' AND event_id % 10 = 0""",
    "in_merged": """
        SELECT site_id, min(window_start) AS window_start, max(window_end) AS window_end, count(*) AS windows_merged
        FROM (SELECT *, sum(opens) OVER (PARTITION BY site_id ORDER BY window_start) AS island
              FROM (SELECT *, CASE WHEN window_start <= max(window_end) OVER (PARTITION BY site_id ORDER BY window_start
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM in_windows))
        GROUP BY site_id, island""",
    "in_customers": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, lower(c_name) || '@example.com' AS email, c_mktsegment AS first_name, c_name AS last_name,
               CAST(DATE '1995-01-01' + to_months(CAST(c_custkey % 24 AS INTEGER)) AS DATE) AS created_at,
               CASE c_custkey % 4 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'platinum' END AS loyalty_tier,
               CAST(c_acctbal AS DECIMAL(14,2)) AS lifetime_value, {i('c_custkey % 5')} AS total_orders, c_custkey % 2 = 0 AS marketing_opt_in
        FROM customer""",
    "in_products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'SKU-' || p_partkey AS sku, p_name AS name, p_type AS category,
               'size-' || (p_size % 5) AS subcategory, p_brand AS brand, CAST(p_retailprice AS DECIMAL(14,2)) AS price,
               CAST(round(CAST(p_retailprice AS DECIMAL(14,2)) * CAST(0.6 AS DECIMAL(3,1)), 2) AS DECIMAL(14,2)) AS cost,
               CAST(p_size AS BIGINT) AS stock_quantity, p_partkey % 20 <> 0 AS is_active, DATE '1995-01-01' AS created_at FROM part""",
    "in_orders_all": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS TIMESTAMP) AS order_timestamp,
               CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 14 = 0 THEN 'returned' WHEN o_orderkey % 20 = 1 THEN 'cancelled' ELSE 'delivered' END
                    WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'shipped' END AS order_status,
               o_orderpriority AS payment_method, CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount,
               'C' || (o_custkey % 5) AS shipping_country, 'S' || (o_custkey % 25) AS shipping_state, o_orderstatus, o_orderkey FROM orders""",
    "in_archive": "SELECT * FROM in_orders_all WHERE o_orderstatus = 'F'",
    "in_inflight": "SELECT * FROM in_orders_all WHERE o_orderstatus <> 'F'",
    "in_lines": """
        SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) = 1""",
    "in_items": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS item_sequence, CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name,
               'SKU-' || l_partkey AS product_sku, p_type AS product_category, p_brand AS product_brand, CAST(l_quantity AS BIGINT) AS quantity,
               {cents('l_extendedprice / l_quantity')} AS unit_price,
               {cents('CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))')} AS discount_amount,
               {cents('CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))')} AS tax_amount,
               {cents('CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))')} AS line_total,
               CAST(l_shipdate AS DATE) AS ship_date, l_suppkey AS supplier_id, l_orderkey
        FROM in_lines JOIN part ON p_partkey = l_partkey""",
    "in_quotes": f"""
        SELECT product_id AS our_product_id, CAST(date_trunc('week', ship_date) AS DATE) AS week_start_date, supplier_id,
               CAST({r('CAST(sum(unit_price) AS DOUBLE) / count(*) * 0.95::DOUBLE', 2)} AS DECIMAL(14,2)) AS competitor_price
        FROM in_items GROUP BY 1, 2, 3""",
    "in_delivered_months": """
        SELECT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS month_start, count(*) AS orders_this_month,
               sum(total_amount) AS spend_this_month, max(order_date) AS last_order
        FROM in_archive WHERE order_status = 'delivered' GROUP BY 1, 2""",
    "in_ltv": f"""
        SELECT c.customer_id, {i('year(mo)')} AS snapshot_year, {i('month(mo)')} AS snapshot_month, last_day(mo) AS snapshot_date,
               sum(coalesce(spend_this_month, 0)) OVER (PARTITION BY c.customer_id ORDER BY mo) AS ltv,
               {i('sum(coalesce(orders_this_month, 0)) OVER (PARTITION BY c.customer_id ORDER BY mo)')} AS cumulative_orders,
               coalesce(orders_this_month, 0) AS orders_this_month, coalesce(spend_this_month, 0) AS spend_this_month, loyalty_tier,
               exists(SELECT 1 FROM in_archive o WHERE o.customer_id = c.customer_id AND o.order_status = 'delivered'
                      AND date_diff('day', o.order_date, last_day(mo)) <= 90) AS is_active,
               exists(SELECT 1 FROM in_archive o WHERE o.customer_id = c.customer_id AND o.order_status = 'delivered' AND o.order_date <= last_day(mo)
                      AND date_diff('day', o.order_date, last_day(mo)) <= 90) AS was_active
        FROM in_customers c
        CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2000-08-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS mo) months
        LEFT JOIN in_delivered_months x ON x.customer_id = c.customer_id AND x.month_start = mo""",
    "in_cohorts": f"""
        SELECT s.cs AS cohort_start, o.k AS months_since_acquisition, s.cohort_size, coalesce(a.active_customers, 0) AS active_customers,
               {r('coalesce(a.active_customers, 0)::DOUBLE / s.cohort_size')} AS retention_rate, coalesce(a.revenue, 0) AS revenue
        FROM (SELECT CAST(date_trunc('month', created_at) AS DATE) AS cs, count(*) AS cohort_size FROM in_customers GROUP BY 1) s
        CROSS JOIN (SELECT unnest(range(12)) AS k) o
        LEFT JOIN (SELECT CAST(date_trunc('month', created_at) AS DATE) AS cs, month_start, count(*) AS active_customers, sum(spend_this_month) AS revenue
                   FROM in_delivered_months JOIN in_customers USING (customer_id) GROUP BY 1, 2) a
          ON a.cs = s.cs AND a.month_start = CAST(s.cs + to_months(CAST(o.k AS INTEGER)) AS DATE)
        WHERE CAST(s.cs + to_months(CAST(o.k AS INTEGER)) AS DATE) <= DATE '2001-08-01'""",
    "in_sessions": sessionized("2 DAY"),
    "in_fin_customers": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS first_name, c_name AS last_name,
               CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'restricted' END AS risk_tier,
               CASE c_custkey % 3 WHEN 0 THEN 'business' ELSE 'individual' END AS customer_type,
               CAST(c_acctbal AS DECIMAL(14,2)) * 20 AS total_balance,
               CAST(DATE '1995-01-01' + to_months(CAST(c_custkey % 24 AS INTEGER)) AS DATE) AS created_at,
               DATE '2001-01-01' + CAST(c_custkey % 200 AS INTEGER) AS last_login, {i('c_custkey % 3 + 1')} AS total_accounts FROM customer""",
    "in_accounts": """
        SELECT 'A-' || c_custkey AS account_id, CAST(c_custkey AS VARCHAR) AS customer_id,
               CASE c_custkey % 4 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 2 THEN 'credit' ELSE 'investment' END AS account_type,
               CASE WHEN c_custkey % 20 = 0 THEN 'frozen' ELSE 'active' END AS status, CAST(c_acctbal AS DECIMAL(14,2)) AS current_balance,
               DATE '1994-01-01' + CAST(c_custkey % 700 AS INTEGER) AS opened_date FROM customer""",
    "in_txns": """
        SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, 'A-' || o_custkey AS account_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               CAST(o_orderdate AS DATE) AS txn_date, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS txn_timestamp,
               CASE o_orderkey % 4 WHEN 0 THEN 'purchase' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'payment' ELSE 'deposit' END AS transaction_type,
               CAST(o_totalprice AS DECIMAL(14,2)) AS amount, 'merchant-' || (o_orderkey % 50) AS merchant_name, o_orderpriority AS merchant_category,
               CASE WHEN o_orderkey % 3 = 0 THEN 'CAN' ELSE 'USA' END AS merchant_country,
               CASE o_orderkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'online' WHEN 2 THEN 'atm' ELSE 'mobile' END AS channel,
               CASE o_orderstatus WHEN 'F' THEN 'posted' ELSE 'reversed' END AS status, (o_orderkey % 100)::DOUBLE / 100.0::DOUBLE AS fraud_score,
               o_orderstatus, o_orderkey FROM orders""",
    "in_txn_archive": "SELECT * FROM in_txns WHERE o_orderstatus IN ('F', 'P')",
    "in_authorizing": f"""
        SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'requesting' ELSE 'approved' END AS auth_status
        FROM in_txns WHERE o_orderstatus = 'O' AND txn_date >= {TODAY} - 30""",
    "in_risk": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, dt AS snapshot_date, ((c_custkey * 37 + q * 13) % 100)::DOUBLE AS risk_score,
               CASE WHEN (c_custkey * 37 + q * 13) % 100 < 40 THEN 'low' WHEN (c_custkey * 37 + q * 13) % 100 < 70 THEN 'medium'
                    WHEN (c_custkey * 37 + q * 13) % 100 < 88 THEN 'high' ELSE 'restricted' END AS risk_tier
        FROM customer CROSS JOIN (VALUES (0, DATE '2000-09-30'), (1, DATE '2000-12-31'), (2, DATE '2001-03-31'), (3, DATE '2001-06-30')) q(q, dt)""",
    "in_bars": """
        SELECT product_brand AS ticker, ship_date AS quote_date, arg_min(unit_price, l_orderkey * 100 + item_sequence) AS open_price,
               max(unit_price) AS high_price, min(unit_price) AS low_price, arg_max(unit_price, l_orderkey * 100 + item_sequence) AS close_price,
               CAST(sum(quantity) AS BIGINT) AS volume FROM in_items GROUP BY 1, 2""",
    "in_portfolio": """
        SELECT 'A-' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS metric_date, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS portfolio_value,
               (min(o_orderkey) % 200 - 100)::DOUBLE / 50.0::DOUBLE AS daily_return_pct, (o_custkey % 35)::DOUBLE / 10.0::DOUBLE AS volatility_30d
        FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "in_wide": """
        SELECT CAST(event_id AS VARCHAR) AS reading_id, CAST(user_id AS VARCHAR) AS device_id, ts AS reading_timestamp,
               CASE WHEN event_type = 'view' THEN value END AS temperature, CASE WHEN event_type = 'click' THEN value END AS humidity,
               CASE WHEN event_type = 'error' THEN value END AS pressure, CASE WHEN event_type = 'purchase' THEN value END AS energy_kwh,
               event_type = 'signup' AS motion_detected, CASE WHEN event_type = 'view' THEN value END AS co2_ppm,
               CASE WHEN event_type = 'click' THEN value END AS pm25_ugm3, CASE WHEN event_type = 'error' THEN value END AS voc_ppb,
               CASE WHEN event_type = 'purchase' THEN value END AS water_flow_lpm, value AS signal_strength, (event_id % 100)::DOUBLE AS battery_level
        FROM events""",
    "in_stock": """
        SELECT product_id, ship_date AS transaction_date, order_id || '/' || item_sequence AS transaction_id,
               CASE l_orderkey % 4 WHEN 3 THEN quantity * 2 WHEN 2 THEN quantity ELSE -quantity END AS quantity_change FROM in_items""",
    "in_market": """
        SELECT quote_date, avg((CAST(close_price AS DOUBLE) - CAST(open_price AS DOUBLE)) / nullif(CAST(open_price AS DOUBLE), 0) * 100) AS market_return
        FROM in_bars GROUP BY 1""",
    "in_conversions": """
        SELECT order_id, customer_id, order_timestamp AS conversion_timestamp,
               CASE o_orderkey % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'social' WHEN 2 THEN 'email' ELSE 'affiliate' END AS channel,
               o_orderkey % 5 + 1 AS touch_count, total_amount AS conversion_value, o_orderkey % 60 + 40 AS pct
        FROM in_archive WHERE order_status = 'delivered'""",
}

_SQL: dict[str, str] = {}

BASE = ", ".join(f"{r(c)} AS {c}" for c in ("baseline_avg", "baseline_p95", "baseline_min", "baseline_max", "baseline_stddev")) + ", sample_count, baseline_hours"
DEVICE_COLS = (
    "device_id, device_type, device_class, model, firmware_version, status, last_heartbeat, CAST(last_reading_value AS DOUBLE) AS last_reading_value, "
    "battery_percent, signal_strength_dbm, site_id, zone, installed_at, updated_at"
)
FLEET_COLS = DEVICE_COLS + ", anomaly_status, anomaly_metric_count, highest_alert_severity, open_alert_count"
BY_HEARTBEAT = "last_heartbeat DESC NULLS LAST, device_id"
LISO = "%Y-%m-%dT%H:%M:%S.%gZ"

_SQL["device_baseline"] = f"SELECT device_id, metric_name, {BASE} FROM in_baseline"
_SQL["recent_readings"] = f"""
    SELECT device_id, reading_bucket_hour, reading_timestamp, metric_name, {d('metric_value')} AS metric_value, unit, quality_code
    FROM in_readings WHERE reading_timestamp >= {NOW} - INTERVAL 60 MINUTE"""
ALERT_COLS = f"device_id, alert_id, raised_at, severity, alert_type, metric_name, {d('metric_value')} AS metric_value, {d('threshold_value')} AS threshold_value, site_id, acknowledged"
_SQL["open_alerts"] = f"SELECT {ALERT_COLS} FROM in_alerts WHERE device_id IN (SELECT device_id FROM in_devices)"
_SQL["metric_health"] = f"""
    SELECT device_id, metric_name, anomaly_status, reason_code, metric_value, 'u' AS unit, quality_code, reading_timestamp, recent_count, {BASE} FROM in_health"""
SUMMARY = """
    SELECT v.device_id, v.site_id, v.status, v.battery_percent,
           CASE WHEN coalesce(h.anomaly_metric_count, 0) > 0 OR coalesce(a.anomaly, false) THEN 'anomalous' ELSE 'normal' END AS device_anomaly_status,
           coalesce(h.anomaly_metric_count, 0) AS anomaly_metric_count,
           CASE WHEN a.critical THEN 'critical' WHEN h.anomaly_metric_count > 0 THEN 'high' WHEN v.status = 'degraded' THEN 'medium'
                WHEN v.battery_percent < 20 THEN 'low' ELSE 'normal' END AS severity,
           CASE WHEN h.seen > 0 THEN 'fresh' ELSE 'stale' END AS data_freshness, a.highest_alert_severity, coalesce(a.open_alert_count, 0) AS open_alert_count
    FROM in_devices v LEFT JOIN in_alert_sum a USING (device_id) LEFT JOIN in_metric_sum h USING (device_id)"""
_SQL["device_summary"] = SUMMARY
_SQL["device_documents"] = f"""
    SELECT s.* EXCLUDE (site_id), coalesce(n.metric_health, '') AS metric_health, coalesce(n.metric_count, 0) AS metric_count
    FROM ({SUMMARY}) s LEFT JOIN (SELECT device_id, string_agg(metric_name || ':' || anomaly_status, ',' ORDER BY metric_name) AS metric_health,
         count(*) AS metric_count FROM in_health GROUP BY 1) n USING (device_id)"""
_SQL["device_document_rows"] = f"""
    SELECT x.*, v.status AS device_status, v.battery_percent FROM (
      SELECT device_id, 'reading' AS section, reading_timestamp AS at, metric_name, {d('metric_value')} AS value, NULL::DOUBLE AS baseline_p95, quality_code AS label FROM in_hot
      UNION ALL SELECT device_id, 'hourly', hour_start, metric_name, avg_value, {d('p95_value')}, NULL FROM in_hourly
      UNION ALL SELECT device_id, 'alert', raised_at, metric_name, {d('metric_value')}, NULL, severity FROM in_alerts) x
    JOIN in_devices v USING (device_id)"""
_SQL["fleet_health"] = f"SELECT {FLEET_COLS} FROM in_fleet"
_SQL["fleet_health_without_alerts"] = f"""
    SELECT {DEVICE_COLS}, CASE WHEN h.device_id IS NULL AND b.device_id IS NULL THEN 'unknown' WHEN coalesce(h.anomaly_metric_count, 0) > 0 THEN 'anomalous'
           ELSE 'normal' END AS anomaly_status, coalesce(h.anomaly_metric_count, 0) AS anomaly_metric_count, NULL::VARCHAR AS highest_alert_severity, 0::BIGINT AS open_alert_count
    FROM in_devices v LEFT JOIN in_metric_sum h USING (device_id) LEFT JOIN (SELECT DISTINCT device_id FROM in_baseline) b USING (device_id)"""
_SQL["device_page"] = f"SELECT {FLEET_COLS} FROM in_fleet ORDER BY {BY_HEARTBEAT} LIMIT 25 OFFSET 25"
_SQL["device_page_totals"] = f"SELECT count(*) AS total_items, {i('ceil(count(*) / 25.0)')} AS total_pages FROM in_devices WHERE status = 'online'"
_SQL["device_page_by_alerts"] = f"SELECT {FLEET_COLS} FROM in_fleet ORDER BY open_alert_count DESC, device_id LIMIT 25"
_SQL["device_page_by_battery"] = f"""
    SELECT {DEVICE_COLS}, 'unknown' AS anomaly_status, 0::BIGINT AS anomaly_metric_count, NULL::VARCHAR AS highest_alert_severity, 0::BIGINT AS open_alert_count
    FROM in_devices ORDER BY battery_percent, device_id LIMIT 100"""
_SQL["devices_after_a_battery_level"] = f"""
    SELECT {DEVICE_COLS} FROM in_devices WHERE battery_percent > 40 OR battery_percent IS NULL OR (battery_percent = 40 AND device_id > '42')
    ORDER BY battery_percent NULLS LAST, device_id LIMIT 100"""
_SQL["devices_after_an_anomaly_status"] = f"""
    SELECT {FLEET_COLS} FROM in_fleet WHERE anomaly_status <> 'anomalous' OR device_id > '42'
    ORDER BY CASE anomaly_status WHEN 'anomalous' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, device_id LIMIT 25"""
_SQL["anomalous_devices"] = f"SELECT {FLEET_COLS} FROM in_fleet WHERE anomaly_status = 'anomalous' ORDER BY {BY_HEARTBEAT} LIMIT 100"
_SQL["anomalous_on_page"] = f"""
    SELECT * FROM (SELECT {FLEET_COLS} FROM in_fleet WHERE status = 'online' ORDER BY {BY_HEARTBEAT} LIMIT 25) WHERE anomaly_status = 'anomalous'"""
_SQL["one_device"] = f"SELECT {DEVICE_COLS} FROM in_devices WHERE device_id = '42'"
_SQL["devices_of_site_by_status"] = f"SELECT {DEVICE_COLS} FROM in_devices WHERE site_id = 'SITE-3' AND status = 'online'"
_SQL["alerts_of_devices"] = f"SELECT {ALERT_COLS} FROM in_alerts_month WHERE device_id IN ('7', '42', '99')"
def scaled(expr: str, places: int) -> str:
    """A DOUBLE's shortest decimal form, rounded half up to so many places, as text."""
    return f"CAST(CAST(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(18,{places})) AS VARCHAR)"


_SQL["baseline_rows_outward"] = f"""
    SELECT device_id AS "deviceId", metric_name AS "metricName", {scaled('baseline_avg', 4)} AS "baselineAvg", {scaled('baseline_p95', 4)} AS "baselineP95",
           {scaled('baseline_min', 4)} AS "baselineMin", {scaled('baseline_max', 4)} AS "baselineMax", {scaled('baseline_stddev', 4)} AS "baselineStddev",
           sample_count AS "sampleCount", baseline_hours AS "baselineWindowHoursCovered" FROM in_baseline"""
_VALUE = "metric_value::DOUBLE"
_SQL["anomaly_reasons"] = f"""
    SELECT device_id, metric_name, reason_code,
           CASE reason_code WHEN 'no_baseline' THEN 'There is no baseline to compare with' WHEN 'no_usable_reading' THEN 'There is no reading of usable quality'
                WHEN 'above_p95' THEN {scaled(_VALUE, 2)} || ' is above the baseline p95 of ' || {scaled('baseline_p95', 2)}
                WHEN 'deviation' THEN {scaled(_VALUE, 2)} || ' is ' || {scaled(f'abs({_VALUE} - baseline_avg)', 2)} || ' away from the baseline mean of '
                    || {scaled('baseline_avg', 2)} || '; ' || {scaled('greatest(2 * baseline_stddev, 0.1::DOUBLE * baseline_avg)', 2)} || ' is allowed' END AS reason
    FROM in_health"""
_SQL["health_entries"] = _SQL["metric_health"] + " WHERE device_id IN (SELECT device_id FROM in_devices)"
_SQL["site_list_in_order"] = "SELECT site_id, row_number() OVER (ORDER BY site_id) AS place FROM (SELECT DISTINCT site_id FROM in_devices WHERE site_id <> '')"
_SQL["newest_readings_in_order"] = """
    SELECT row_number() OVER (ORDER BY reading_timestamp DESC, device_id, metric_name) AS place, device_id, metric_name, reading_timestamp FROM in_readings
    WHERE device_id IN ('7', '42', '99', '100') AND reading_timestamp BETWEEN TIMESTAMP '2024-01-15 11:10:00' AND TIMESTAMP '2024-01-15 12:10:00'"""
_SQL["device_page_by_signal"] = f"SELECT {FLEET_COLS} FROM in_fleet ORDER BY signal_strength_dbm NULLS LAST, device_id LIMIT 25"
_SQL["device_page_by_status"] = f"SELECT {FLEET_COLS} FROM in_fleet ORDER BY status NULLS LAST, device_id LIMIT 25"
_SQL["device_page_by_anomaly"] = f"""
    SELECT {FLEET_COLS} FROM in_fleet ORDER BY CASE anomaly_status WHEN 'anomalous' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, device_id LIMIT 25"""
_SQL["site_list"] = "SELECT DISTINCT site_id FROM in_devices WHERE site_id <> ''"
_SQL["fleet_tiles"] = """
    SELECT count(*) AS total, count(*) FILTER (status = 'online') AS online_count, count(*) FILTER (status = 'warning') AS warning_count,
           count(*) FILTER (status = 'offline') AS offline_count, count(*) FILTER (anomaly_status = 'anomalous') AS anomalous_count,
           count(*) FILTER (open_alert_count > 0) AS devices_with_alerts FROM in_fleet"""
_SQL["device_rows_outward"] = f"""
    SELECT device_id AS "deviceId", device_type AS "deviceType", device_class AS "deviceClass", model, firmware_version AS "firmwareVersion", status,
           strftime(last_heartbeat, '{LISO}') AS "lastHeartbeat", CAST(last_reading_value AS VARCHAR) AS "lastReadingValue",
           battery_percent AS "batteryPercent", signal_strength_dbm AS "signalStrengthDbm", site_id AS "siteId", zone,
           strftime(installed_at, '{LISO}') AS "installedAt", strftime(updated_at, '{LISO}') AS "updatedAt" FROM in_devices"""
_SQL["reading_rows_outward"] = f"""
    SELECT device_id AS "deviceId", strftime(reading_timestamp, '{LISO}') AS "timestamp", metric_name AS "metricName",
           CAST(metric_value AS VARCHAR) AS "metricValue", unit, quality_code AS "qualityCode" FROM in_hot"""
_SQL["alert_rows_outward"] = f"""
    SELECT device_id AS "deviceId", alert_id AS "alertId", strftime(raised_at, '{LISO}') AS "raisedAt", severity, alert_type AS "alertType",
           metric_name AS "metricName", CAST(metric_value AS VARCHAR) AS "metricValue", CAST(threshold_value AS VARCHAR) AS "thresholdValue",
           site_id AS "siteId", acknowledged FROM in_alerts"""
_SQL["usable_readings"] = """
    SELECT nullif(quality_code, 'suspect') AS quality_code, count(*) AS readings FROM in_readings
    WHERE nullif(quality_code, 'suspect') IS DISTINCT FROM 'bad' GROUP BY 1"""


def triage(alerts: str, weather: str = "latest") -> str:
    if weather == "latest":
        sky = "LEFT JOIN (SELECT DISTINCT ON (site_id) * FROM in_weather ORDER BY site_id, observation_time DESC) w ON w.site_id = a.site_id"
    else:
        sky = "ASOF LEFT JOIN in_weather w ON w.site_id = a.site_id AND w.observation_time <= a.raised_at"
    return f"""
    SELECT a.alert_id, a.severity, a.alert_type, v.device_class, v.model, a.site_id, v.zone, a.metric_name, {d('a.metric_value')} AS alert_value,
           {r('b.p95', 2)} AS baseline_p95, {r('b.mean', 2)} AS baseline_avg, {r('(CAST(a.metric_value AS DOUBLE) - b.p95) / nullif(b.p95, 0)', 3)} AS pct_over_baseline,
           w.temperature_c AS site_temp_c, w.humidity_pct AS site_humidity, w.conditions AS site_weather
    FROM {alerts} a JOIN in_devices v ON v.device_id = a.device_id
    LEFT JOIN (SELECT device_id, metric_name, CAST(max(p95_value) AS DOUBLE) AS p95, {m('avg_value')} AS mean FROM in_hourly
               WHERE hour_start >= {NOW} - INTERVAL 14 DAY GROUP BY 1, 2) b ON b.device_id = a.device_id AND b.metric_name = a.metric_name
    {sky} WHERE NOT a.acknowledged"""


_SQL["alert_triage"] = triage("in_alerts") + f" ORDER BY {TRIAGE.format('a.severity')}, pct_over_baseline DESC NULLS LAST, a.alert_id LIMIT 25"
_SQL["alert_triage_full"] = triage("in_alerts_month")
_SQL["alert_triage_weather_then"] = triage("in_alerts_month", "then")
_SQL["alert_triage_short"] = f"""
    SELECT alert_id, severity, alert_type, metric_name, alert_value, baseline_p95, pct_over_baseline, site_temp_c, site_weather
    FROM ({triage('in_alerts')}) ORDER BY pct_over_baseline DESC NULLS LAST, alert_id LIMIT 25"""
_SQL["deteriorating_devices"] = f"""
    SELECT v.device_id, v.site_id, v.zone, v.device_class, v.status, v.battery_percent, s.metric_name,
           {r('s.a', 2)} AS avg_3d, {r('l.a', 2)} AS avg_14d, {r('(s.a - l.a) / nullif(l.a, 0)', 3)} AS delta_pct
    FROM in_devices v
    JOIN (SELECT device_id, metric_name, {m('avg_value')} AS a FROM in_hourly WHERE hour_start >= {NOW} - INTERVAL 3 DAY GROUP BY 1, 2) s ON s.device_id = v.device_id
    JOIN (SELECT device_id, metric_name, {m('avg_value')} AS a FROM in_hourly WHERE hour_start >= {NOW} - INTERVAL 14 DAY GROUP BY 1, 2) l
      ON l.device_id = s.device_id AND l.metric_name = s.metric_name
    WHERE v.status IN ('degraded', 'maintenance') AND abs((s.a - l.a) / nullif(l.a, 0)) > 0.10
    ORDER BY abs(delta_pct) DESC, v.device_id, s.metric_name LIMIT 30"""
_SQL["site_health"] = f"""
    SELECT l.site_id, n AS live_device_count, up AS online_count, bad AS degraded_count, off AS offline_count, {r('100.0::DOUBLE * up / n', 2)} AS current_online_pct,
           {r('u', 2)} AS historical_uptime_30d, {r('b', 2)} AS historical_battery_30d, c AS critical_alerts_30d
    FROM (SELECT site_id, count(*) AS n, count(*) FILTER (status = 'online') AS up, count(*) FILTER (status = 'degraded') AS bad,
                 count(*) FILTER (status = 'offline') AS off FROM in_devices GROUP BY 1) l
    LEFT JOIN (SELECT site_id, {m('uptime_pct')} AS u, {m('avg_battery_pct')} AS b, {i('sum(alerts_critical)')} AS c
               FROM in_site_days WHERE summary_date >= CAST({NOW} AS DATE) - 30 GROUP BY 1) h USING (site_id)
    ORDER BY {r('u - 100.0::DOUBLE * up / n', 6)} DESC NULLS LAST, l.site_id LIMIT 20"""
_SQL["site_health_by_day"] = f"""
    SELECT h.site_id, h.summary_date, n AS live_device_count, up AS online_count, {r('100.0::DOUBLE * up / n', 2)} AS current_online_pct, {r('h.uptime_pct', 2)} AS uptime_pct
    FROM in_site_days h JOIN (SELECT site_id, count(*) AS n, count(*) FILTER (status = 'online') AS up FROM in_devices GROUP BY 1) l USING (site_id)"""
_SQL["site_status_sql"] = """
    SELECT site_id, status, devices, poor_days FROM (SELECT site_id, status, count(*) AS devices FROM in_devices GROUP BY 1, 2)
    JOIN (SELECT site_id, count(*) FILTER (uptime_pct < 75) AS poor_days FROM in_site_days WHERE summary_date >= DATE '2024-01-10' GROUP BY 1) USING (site_id)"""
_SQL["cart_personalization"] = f"""
    SELECT c.customer_id, c.n AS items_in_cart, {d('c.v')} AS cart_value, {d('l.ltv')} AS historical_ltv, l.loyalty_tier, l.cumulative_orders, t.product_category AS top_preferred_category
    FROM (SELECT customer_id, count(*) AS n, sum(quantity * unit_price) AS v FROM in_items JOIN in_inflight USING (order_id)
          WHERE order_status = 'pending' AND order_date >= {TODAY} - 30 GROUP BY 1) c
    JOIN in_customers USING (customer_id)
    LEFT JOIN (SELECT * FROM in_ltv WHERE snapshot_date = DATE '2001-07-31') l ON l.customer_id = c.customer_id
    LEFT JOIN (SELECT DISTINCT ON (customer_id) customer_id, product_category FROM (
        SELECT order_id, customer_id, product_category, sum(line_total) AS s FROM in_items JOIN in_archive USING (order_id) GROUP BY 1, 2, 3)
        ORDER BY customer_id, s DESC, order_id DESC, product_category DESC) t ON t.customer_id = c.customer_id
    ORDER BY c.v DESC, c.customer_id LIMIT 25"""
_SQL["preferred_categories"] = """
    SELECT DISTINCT ON (customer_id) customer_id, product_category AS top_preferred_category FROM (
        SELECT customer_id, product_category, sum(line_total) AS s FROM in_items JOIN in_archive USING (order_id) GROUP BY 1, 2)
    ORDER BY customer_id, s DESC, product_category DESC"""
_SQL["price_audit"] = f"""
    SELECT p.product_id, p.name AS product, p.category, p.brand, {d('p.price')} AS our_price, {r('q.a')} AS avg_competitor_price,
           {r('100 * (CAST(p.price AS DOUBLE) - q.a) / q.a', 2)} AS pct_above_market, q.n AS competitor_quotes, p.stock_quantity
    FROM in_products p JOIN (SELECT our_product_id, {m('competitor_price')} AS a, count(*) AS n FROM in_quotes
        WHERE week_start_date = (SELECT max(week_start_date) FROM in_quotes WHERE week_start_date < {TODAY}) GROUP BY 1) q ON q.our_product_id = p.product_id
    WHERE p.is_active AND CAST(p.price AS DOUBLE) > q.a * 1.10::DOUBLE ORDER BY pct_above_market DESC, p.product_id LIMIT 30"""
RISK = f"""
    SELECT i.order_id, i.customer_id, i.order_date, i.order_status, {d('i.total_amount')} AS total_amount, c.n AS lifetime_orders, c.k AS lifetime_returns,
           {r('c.rate', 3)} AS return_rate, CASE WHEN c.rate >= 0.15 THEN 'HIGH' WHEN c.rate >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS risk_flag
    FROM in_inflight i LEFT JOIN (SELECT customer_id, count(*) AS n, count(*) FILTER (order_status = 'returned') AS k,
        CAST(count(*) FILTER (order_status = 'returned') AS DOUBLE) / count(*) AS rate FROM in_archive GROUP BY 1) c ON c.customer_id = i.customer_id
    WHERE i.order_status IN ('processing', 'shipped')"""
_SQL["order_risk"] = RISK + " ORDER BY c.rate DESC NULLS LAST, i.total_amount DESC, i.order_id LIMIT 30"
_SQL["order_risk_full"] = RISK
_SQL["session_potential"] = f"""
    SELECT s.customer_id, s.session_number, s.session_start, s.page_views, s.cart_additions, {i('year(c.created_at)')} AS cohort_year,
           {i('month(c.created_at)')} AS cohort_month, k.rate AS cohort_retention
    FROM in_sessions s JOIN in_customers c USING (customer_id)
    JOIN (SELECT cohort_start, arg_max(retention_rate, months_since_acquisition) AS rate FROM in_cohorts GROUP BY 1) k ON k.cohort_start = date_trunc('month', c.created_at)
    WHERE k.rate > 0.02 AND s.page_views > 5 ORDER BY k.rate DESC, s.page_views DESC, s.customer_id, s.session_number LIMIT 25"""
_SQL["authorization_context"] = f"""
    SELECT t.account_id, t.transaction_id, t.txn_timestamp AS initiated_at, {d('t.amount')} AS authorizing_amount, t.merchant_name, t.merchant_category,
           t.merchant_country, t.channel, {r('b.a', 2)} AS baseline_avg_amount, {r('b.x', 2)} AS baseline_max_amount, b.n AS baseline_n,
           {r('t.amount::DOUBLE / nullif(b.a, 0)', 2)} AS ratio_vs_avg, k.risk_score, k.risk_tier,
           CASE WHEN k.risk_tier IN ('high', 'restricted') THEN 'REVIEW' WHEN t.amount::DOUBLE > b.a * 5 AND b.n > 3 THEN 'REVIEW'
                WHEN t.amount::DOUBLE > b.x THEN 'WATCH' ELSE 'OK' END AS auth_recommendation
    FROM in_authorizing t JOIN in_accounts c ON c.account_id = t.account_id
    LEFT JOIN (SELECT customer_id, merchant_category, {m('amount')} AS a, max(amount)::DOUBLE AS x, count(*) AS n FROM in_txn_archive
               WHERE status = 'posted' AND txn_date >= {TODAY} - 2400 GROUP BY 1, 2) b ON b.customer_id = c.customer_id AND b.merchant_category = t.merchant_category
    LEFT JOIN in_risk k ON k.customer_id = c.customer_id AND k.snapshot_date = DATE '2001-06-30'
    WHERE t.auth_status = 'requesting' ORDER BY t.txn_timestamp DESC, t.transaction_id LIMIT 30"""
_SQL["fraud_triage"] = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS alert_id,
           CASE (o_orderkey // 40) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
           CASE o_orderkey % 3 WHEN 0 THEN 'velocity' WHEN 1 THEN 'geo_anomaly' ELSE 'amount_anomaly' END AS alert_type, CAST(o_orderdate AS TIMESTAMP) AS raised_at,
           'open' AS case_status, 'analyst-' || (o_orderkey % 3) AS assigned_to, (o_orderkey % 100)::DOUBLE AS alert_risk_score,
           c.first_name || ' ' || c.last_name AS customer_name, c.risk_tier AS current_risk_tier, f.n AS lifetime_fraud_count,
           {r('f.l', 2)} AS lifetime_loss, {r('f.k', 2)} AS lifetime_recovered
    FROM orders JOIN in_fin_customers c ON c.customer_id = CAST(o_custkey AS VARCHAR)
    LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, count(*) AS n,
                      sum(round(CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.5 AS DECIMAL(2,1)), 2)) AS l,
                      sum(round(CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.1 AS DECIMAL(2,1)), 2)) AS k
               FROM orders WHERE o_orderkey % 120 = 0 GROUP BY 1) f ON f.customer_id = c.customer_id
    WHERE o_orderkey % 40 = 0 AND o_orderdate >= CAST({TODAY} AS TIMESTAMP) - INTERVAL 90 DAY
    ORDER BY (o_orderkey // 40) % 4, f.n DESC NULLS LAST, alert_id LIMIT 25"""
_SQL["portfolio_exposure"] = f"""
    SELECT a.customer_id, a.account_id, {d('a.current_balance')} AS live_balance, {r('p.last', 2)} AS last_closing_value, {r('p.ret')} AS portfolio_avg_daily_return,
           {r('p.vol')} AS portfolio_volatility, {r('b.ret')} AS benchmark_avg_daily_return, {r('p.ret - b.ret')} AS alpha_30d
    FROM in_accounts a JOIN (SELECT account_id, {m('daily_return_pct')} AS ret, {m('volatility_30d')} AS vol, arg_max(portfolio_value, metric_date) AS last
        FROM in_portfolio WHERE metric_date BETWEEN {TODAY} - 30 AND {TODAY} GROUP BY 1) p USING (account_id)
    CROSS JOIN (SELECT {m('(close_price::DOUBLE - open_price::DOUBLE) / nullif(open_price::DOUBLE, 0) * 100', 'DECIMAL(28,12)')} AS ret
        FROM in_bars WHERE ticker = 'Brand#1' AND quote_date BETWEEN {TODAY} - 30 AND {TODAY}) b
    WHERE a.account_type = 'investment' AND a.status = 'active' ORDER BY alpha_30d, a.account_id LIMIT 25"""


def watchlist(reason: str) -> str:
    return f"""
    SELECT c.customer_id, c.first_name || ' ' || c.last_name AS customer_name, c.risk_tier, CAST(o.o_orderkey AS VARCHAR) AS transfer_id, o.o_totalprice AS amount,
           CASE o.o_orderkey % 3 WHEN 0 THEN 'wire' WHEN 1 THEN 'ach' ELSE 'internal' END AS transfer_type, 'bank-' || (o.o_orderkey % 7) AS destination_bank,
           CASE o.o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' ELSE 'flagged' END AS status,
           s.n AS sar_count_12mo, s.at AS last_filing_at, s.why AS last_trigger
    FROM orders o JOIN in_accounts a ON a.account_id = 'A-' || o.o_custkey JOIN in_fin_customers c ON c.customer_id = a.customer_id
    LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, count(*) AS n, CAST(max(o_orderdate) AS TIMESTAMP) AS at, {reason} AS why FROM orders
               WHERE o_orderkey % 50 = 0 AND (o_orderkey // 50) % 5 = 0 AND o_orderdate >= CAST({TODAY} AS TIMESTAMP) - INTERVAL 365 DAY GROUP BY 1) s
      ON s.customer_id = c.customer_id
    WHERE o.o_orderstatus = 'P' AND o.o_totalprice >= 10000 AND o.o_orderkey % 4 <> 3"""


_SQL["compliance_watchlist"] = watchlist("max(o_orderpriority)") + " ORDER BY CASE WHEN s.n > 0 THEN 0 ELSE 1 END, o.o_totalprice DESC, transfer_id LIMIT 25"
_SQL["compliance_full"] = watchlist("arg_max(o_orderpriority, o_orderdate)")
_SQL["device_page_counts"] = f"""
    SELECT v.device_id, v.status, v.battery_percent, v.site_id, coalesce(x.n, 0) AS metric_count, coalesce(a.n, 0) AS alert_count, a.s AS highest_severity
    FROM (SELECT * FROM in_devices ORDER BY {BY_HEARTBEAT} LIMIT 25) v
    LEFT JOIN (SELECT device_id, count(DISTINCT metric_name) AS n FROM in_readings GROUP BY 1) x USING (device_id)
    LEFT JOIN (SELECT device_id, count(DISTINCT alert_id) AS n, max(severity) AS s FROM in_alerts_month GROUP BY 1) a USING (device_id)"""
_SQL["fleet_counts"] = f"""
    SELECT v.device_id, v.status, v.battery_percent, v.site_id, coalesce(x.n, 0) AS metric_count, coalesce(a.n, 0) AS alert_count, a.s AS highest_severity
    FROM in_devices v
    LEFT JOIN (SELECT device_id, count(DISTINCT metric_name) AS n FROM in_readings GROUP BY 1) x USING (device_id)
    LEFT JOIN (SELECT device_id, count(DISTINCT alert_id) AS n, max(severity) AS s FROM in_alerts_month GROUP BY 1) a USING (device_id)"""
_SQL["device_reading_counts"] = """
    SELECT v.device_id, v.status, v.last_heartbeat, count(e.metric_value) AS historical_reading_count
    FROM in_devices v LEFT JOIN in_readings e USING (device_id) GROUP BY 1, 2, 3"""
_SQL["customer_order_counts"] = """
    SELECT c.customer_id, c.email, c.first_name, count(o.order_id) AS order_count FROM in_customers c LEFT JOIN in_archive o USING (customer_id) GROUP BY 1, 2, 3"""
_SQL["purchase_lines"] = f"""
    SELECT t.order_id, {i('t.item_sequence')} AS item_sequence, c.first_name, c.last_name, p.name AS product_name, {d('p.price')} AS price
    FROM in_items t JOIN in_archive o USING (order_id) JOIN in_customers c ON c.customer_id = o.customer_id JOIN in_products p ON p.product_id = t.product_id"""
_SQL["orders_board"] = f"""
    SELECT n AS orders_today, v AS revenue_today, {r('u', 2)} AS avg_daily_revenue, {r('v / u')} AS ratio_to_usual
    FROM (SELECT count(*) AS n, coalesce(sum(total_amount), 0)::DOUBLE AS v FROM in_inflight WHERE order_date = DATE '2001-08-01')
    CROSS JOIN (SELECT {m('s', 'DECIMAL(30,2)')} AS u FROM (SELECT order_date, sum(line_total) AS s FROM in_items JOIN in_archive USING (order_id)
        WHERE order_date >= DATE '2001-08-01' - 30 AND order_date < DATE '2001-08-01' GROUP BY 1))"""
_SQL["spend_monitor"] = f"""
    SELECT n.customer_id, n.k AS recent_transactions, n.s::DOUBLE AS recent_spend, {r('p.s::DOUBLE / 365')} AS usual_daily_spend,
           {r('(n.s::DOUBLE / 7) / (p.s::DOUBLE / 365)')} AS spend_ratio
    FROM (SELECT customer_id, count(*) AS k, sum(amount) AS s FROM in_txns WHERE txn_date >= {TODAY} - 7 GROUP BY 1) n
    LEFT JOIN (SELECT customer_id, sum(amount) AS s FROM in_txn_archive WHERE txn_date >= {TODAY} - 372 AND txn_date < {TODAY} - 7 GROUP BY 1) p USING (customer_id)"""

PAST, PAST_DAY = "TIMESTAMP '2024-01-15 12:10:00'", "DATE '1998-06-01'"
_SQL["recent_readings_past"] = _SQL["recent_readings"].replace(
    f"reading_timestamp >= {NOW} - INTERVAL 60 MINUTE", f"reading_timestamp BETWEEN {PAST} - INTERVAL 60 MINUTE AND {PAST}"
)
_SQL["site_health_past"] = _SQL["site_health"].replace(
    f"summary_date >= CAST({NOW} AS DATE) - 30", f"summary_date BETWEEN CAST({PAST} AS DATE) - 30 AND CAST({PAST} AS DATE)"
)
_SQL["cart_personalization_past"] = _SQL["cart_personalization"].replace("DATE '2001-07-31'", "DATE '2001-04-30'")
_SQL["portfolio_exposure_past"] = _SQL["portfolio_exposure"].replace(TODAY, PAST_DAY)

HOURLY_COLS = f"device_id, metric_name, hour_start, hour_year, hour_month, sample_count, {d('min_value')} AS min_value, {d('max_value')} AS max_value, avg_value, {d('p95_value')} AS p95_value, stddev_value"
_SQL["hourly_rollup"] = f"SELECT {HOURLY_COLS} FROM ({hourly('in_dense')})"
_SQL["hourly_rollup_by_metric"] = f"SELECT {HOURLY_COLS} FROM ({hourly('in_readings')})"
_SQL["exact_p95_by_quality"] = """
    SELECT quality_code, CAST(metric_value AS DOUBLE) AS p95 FROM (SELECT quality_code, metric_value, row_number() OVER (PARTITION BY quality_code ORDER BY metric_value) AS place,
        count(*) OVER (PARTITION BY quality_code) AS n FROM in_readings) WHERE place = greatest(n * 95 // 100, 1)"""
_SQL["daily_sales"] = f"""
    SELECT order_date AS summary_date, {i('year(order_date)')} AS summary_year, {i('month(order_date)')} AS summary_month, product_category, shipping_country, shipping_state,
           count(DISTINCT order_id) AS order_count, {i('sum(quantity)')} AS unit_count, {d('sum(unit_price * quantity)')} AS gross_revenue,
           {d('sum(discount_amount)')} AS discount_total, {d('sum(line_total)')} AS net_revenue, count(*) FILTER (order_status = 'returned') AS return_count,
           {d("coalesce(sum(line_total) FILTER (order_status = 'returned'), 0)")} AS return_amount, count(DISTINCT customer_id) AS unique_customers
    FROM in_items JOIN in_archive USING (order_id) GROUP BY order_date, product_category, shipping_country, shipping_state"""
BUYERS = "FROM in_items JOIN in_archive USING (order_id) JOIN in_customers USING (customer_id)"
_SQL["buyers_by_period"] = " UNION ALL ".join(
    f"SELECT '{p}' AS period, CAST(date_trunc('{p}', order_date) AS DATE) AS period_start, product_category, count(DISTINCT customer_id) AS unique_customers {BUYERS} GROUP BY 1, 2, 3"
    for p in ("day", "week", "month"))
_SQL["buyers_of_all_categories"] = " UNION ALL ".join(
    f"SELECT '{p}' AS period, CAST(date_trunc('{p}', order_date) AS DATE) AS period_start, count(DISTINCT customer_id) AS unique_customers {BUYERS} GROUP BY 1, 2"
    for p in ("week", "quarter", "year"))
_SQL["weekly_products"] = f"""
    SELECT product_id, product_category, week_start_date, {i('year(week_start_date)')} AS week_year, {i('weekofyear(week_start_date)')} AS week_of_year, units_sold,
           {d('gross')} AS gross_revenue, {d(even_cents('CAST(gross * 100 AS HUGEINT)', 'units_sold'))} AS average_selling_price,
           {r('back::DOUBLE / units_sold')} AS return_rate,
           row_number() OVER (PARTITION BY product_category, week_start_date ORDER BY units_sold DESC, product_id DESC) AS velocity_rank
    FROM (SELECT product_id, product_category, CAST(date_trunc('week', order_date) AS DATE) AS week_start_date, {i('sum(quantity)')} AS units_sold,
                 sum(unit_price * quantity) AS gross, {i("coalesce(sum(quantity) FILTER (order_status = 'returned'), 0)")} AS back
          FROM in_items JOIN in_archive USING (order_id) GROUP BY 1, 2, 3)"""
LTV = f"customer_id, snapshot_year, snapshot_month, snapshot_date, {d('ltv')} AS ltv, cumulative_orders, orders_this_month, {d('spend_this_month')} AS spend_this_month, loyalty_tier"
_SQL["monthly_ltv"] = f"SELECT {LTV}, is_active FROM in_ltv"
_SQL["monthly_ltv_no_lookahead"] = f"SELECT {LTV}, was_active AS is_active FROM in_ltv"
_SQL["cohort_retention"] = f"""
    SELECT {i('year(cohort_start)')} AS cohort_year, {i('month(cohort_start)')} AS cohort_month, months_since_acquisition, cohort_size, active_customers, retention_rate,
           {d('revenue')} AS revenue_in_period,
           CASE WHEN active_customers = 0 THEN 0.0::DOUBLE ELSE
             CAST(CAST(revenue * 100 AS HUGEINT) // active_customers + CASE WHEN CAST(revenue * 100 AS HUGEINT) % active_customers * 2 > active_customers
               OR (CAST(revenue * 100 AS HUGEINT) % active_customers * 2 = active_customers AND (CAST(revenue * 100 AS HUGEINT) // active_customers) % 2 = 1)
               THEN 1 ELSE 0 END AS DOUBLE) / 100 END AS avg_revenue_per_active
    FROM in_cohorts"""
_SQL["current_ltv"] = f"""
    SELECT c.customer_id, c.loyalty_tier, count(o.order_id) AS total_orders, {d('coalesce(sum(o.total_amount), 0)')} AS current_ltv
    FROM in_customers c LEFT JOIN in_archive o ON o.customer_id = c.customer_id AND o.order_status = 'delivered' GROUP BY 1, 2"""
_SQL["enriched_orders"] = f"""
    SELECT o.order_id, o.customer_id, o.order_date, o.order_timestamp, o.order_status, o.payment_method, {d('o.total_amount')} AS total_amount, o.shipping_country,
           o.shipping_state, coalesce(t.n, 0) AS item_count, {i('year(o.order_date)')} AS order_year, {i('month(o.order_date)')} AS order_month,
           CASE o.order_status WHEN 'returned' THEN 'refunded' WHEN 'cancelled' THEN 'failed' WHEN 'pending' THEN 'authorized' ELSE 'captured' END AS payment_status
    FROM in_orders_all o LEFT JOIN (SELECT order_id, count(*) AS n FROM in_items GROUP BY 1) t USING (order_id)"""
_SQL["flat_items"] = f"SELECT order_id, {i('item_sequence')} AS item_sequence, quantity, product_id, product_name, product_category FROM in_items"
TAXED = f"""
    SELECT order_id, item_sequence, unit_price, quantity, discount_amount, {even_cents('CAST((unit_price * quantity - discount_amount) * 100 AS HUGEINT) * 8', 100)} AS tax_amount,
           {even_cents('CAST((unit_price * quantity - discount_amount) * 100 AS HUGEINT) * 108', 100)} AS line_total FROM in_items"""
_SQL["line_amounts"] = f"""
    SELECT order_id, {i('item_sequence')} AS item_sequence, {d('unit_price')} AS unit_price, quantity, {d('discount_amount')} AS discount_amount,
           {d('tax_amount')} AS tax_amount, {d('line_total')} AS line_total FROM ({TAXED})"""
_SQL["order_totals"] = f"""
    SELECT order_id, {r('s', 2)} AS subtotal, {r('t', 2)} AS tax_amount, {r('x', 2)} AS discount_amount, (o_orderkey % 25)::DOUBLE AS shipping_cost,
           {r('s - x + t + o_orderkey % 25', 2)} AS total_amount
    FROM (SELECT order_id, sum(unit_price * quantity) AS s, sum(tax_amount) AS t, sum(discount_amount) AS x FROM ({TAXED}) GROUP BY 1) JOIN in_orders_all USING (order_id)"""
_SQL["attribution"] = f"""
    SELECT order_id, customer_id, conversion_timestamp, channel, touch_count, {d('conversion_value')} AS conversion_value, pct::DOUBLE / 100.0::DOUBLE AS attributed_share,
           channel || '_' || year(conversion_timestamp) || 'Q' || quarter(conversion_timestamp) AS campaign_name, {i('year(conversion_timestamp)')} AS conversion_year,
           {i('month(conversion_timestamp)')} AS conversion_month,
           {d('CASE WHEN touch_count > 1 THEN ' + even_cents('CAST(conversion_value * 100 AS HUGEINT) * pct', 100) + ' ELSE conversion_value END')} AS attributed_revenue
    FROM in_conversions"""
_SQL["monthly_statements"] = f"""
    SELECT account_id, customer_id, {i('year(mo)')} AS statement_year, {i('month(mo)')} AS statement_month, mo AS period_start, last_day(mo) AS period_end,
           opening / 100.0::DOUBLE AS opening_balance, closing / 100.0::DOUBLE AS closing_balance, credits / 100.0::DOUBLE AS total_credits, debits / 100.0::DOUBLE AS total_debits,
           n AS transaction_count, fees / 100.0::DOUBLE AS fees_charged, interest / 100.0::DOUBLE AS interest_earned
    FROM in_statements"""


def half_even_whole(x: str, divisor: int) -> str:
    a = f"abs({x})"
    return f"(sign({x}) * ({a} // {divisor} + CASE WHEN {a} % {divisor} * 2 > {divisor} OR ({a} % {divisor} * 2 = {divisor} AND ({a} // {divisor}) % 2 = 1) THEN 1 ELSE 0 END))"


_FEES = half_even_whole("coalesce(x.debits, 0) * 5", 1000)
_INTEREST = "CASE WHEN account_type = 'savings' THEN " + half_even_whole("{0} * 15", 10000) + " ELSE 0 END"


def _statement_step(opening: str, month: str, source: str) -> str:
    return f"""
        SELECT account_id, customer_id, account_type, {month} AS mo, {opening} AS opening, coalesce(x.credits, 0) AS credits, coalesce(x.debits, 0) AS debits,
               coalesce(x.n, 0) AS n, {_FEES} AS fees, {_INTEREST.format(opening)} AS interest,
               CAST({opening} + coalesce(x.credits, 0) - coalesce(x.debits, 0) - {_FEES} + {_INTEREST.format(opening)} AS HUGEINT) AS closing
        FROM {source} LEFT JOIN in_account_months x USING (account_id, mo)"""


_INPUTS["in_account_months"] = """
    SELECT account_id, CAST(date_trunc('month', txn_date) AS DATE) AS mo, count(*) AS n,
           CAST(coalesce(sum(amount) FILTER (transaction_type IN ('purchase', 'withdrawal', 'payment')), 0) * 100 AS HUGEINT) AS debits,
           CAST(coalesce(sum(amount) FILTER (transaction_type = 'deposit'), 0) * 100 AS HUGEINT) AS credits FROM in_txn_archive GROUP BY 1, 2"""
_INPUTS["in_statement_1"] = _statement_step(
    "start", "mo", "(SELECT *, CAST(current_balance * 100 AS HUGEINT) AS start, DATE '2001-02-01' AS mo FROM in_accounts) s"
)
for _k in range(2, 7):
    _INPUTS[f"in_statement_{_k}"] = _statement_step(
        "start", "mo", f"(SELECT account_id, customer_id, account_type, closing AS start, DATE '2001-{_k + 1:02d}-01' AS mo FROM in_statement_{_k - 1}) s"
    )
_INPUTS["in_statements"] = " UNION ALL ".join(f"SELECT * FROM in_statement_{k}" for k in range(1, 7))

_SQL["portfolio_daily"] = f"""
    SELECT account_id, metric_date, {d('portfolio_value')} AS portfolio_value, {r('coalesce(v - p, 0)')} AS daily_pnl, {r('coalesce((v - p) / p, 0) * 100')} AS daily_return_pct,
           {r('(v / f - 1) * 100')} AS cumulative_return_pct
    FROM (SELECT *, portfolio_value::DOUBLE AS v, lag(portfolio_value::DOUBLE) OVER w AS p, first_value(portfolio_value::DOUBLE) OVER w AS f
          FROM in_portfolio WINDOW w AS (PARTITION BY account_id ORDER BY metric_date))"""
_SQL["compounded_returns"] = f"""
    SELECT account_id, metric_date, daily_return_pct, {r('(exp(sum(ln(1 + daily_return_pct / 100)) OVER (PARTITION BY account_id ORDER BY metric_date)) - 1) * 100')} AS cumulative_return_pct
    FROM in_portfolio"""
_SQL["risk_tiers"] = "SELECT customer_id, snapshot_date, risk_score, risk_tier FROM in_risk"
_SQL["device_age"] = f"SELECT device_id, installed_at, date_diff('day', CAST(installed_at AS DATE), CAST({NOW} AS DATE)) AS days_since_install FROM in_devices"
_SQL["window_minutes"] = "SELECT *, date_sub('minute', window_start, window_end) AS downtime_minutes FROM in_windows"
_SQL["available_balances"] = f"""
    SELECT a.account_id, {d('a.current_balance')} AS current_balance, {d('h.held')} AS held, {d('a.current_balance - coalesce(h.held, 0)')} AS available_balance
    FROM in_accounts a LEFT JOIN (SELECT account_id, sum(amount) AS held FROM in_authorizing WHERE auth_status = 'approved' GROUP BY 1) h USING (account_id)"""

SEGMENT = "CASE WHEN {0} > 5000 THEN 'high_value' WHEN {0} > 1000 THEN 'regular' {1} ELSE 'low_value' END"
BALANCE = "CASE WHEN total_balance > 100000 THEN 'high_value' WHEN total_balance > 10000 THEN 'medium_value' ELSE 'standard' END"
VERSION = "CAST({0} AS DATE) AS effective_date, DATE '9999-12-31' AS end_date, true AS is_current"


def nulls(names: str, kind: str = "VARCHAR") -> str:
    return ", ".join(f"NULL::{kind} AS {n}" for n in names.split())


_SQL["sales_fact"] = f"""
    SELECT sha256(t.order_id || '/' || t.item_sequence) AS sale_id, t.order_id, {i('t.item_sequence')} AS item_sequence, t.product_id, t.product_sku, t.product_name, t.quantity,
           {d('t.unit_price')} AS unit_price, {d('t.discount_amount')} AS discount_amount, {d('t.tax_amount')} AS tax_amount, {d('t.line_total')} AS line_total,
           o.order_date, o.order_timestamp, {i('year(o.order_date)')} AS order_year, {i('month(o.order_date)')} AS order_month, {i('day(o.order_date)')} AS order_day,
           {i('isodow(o.order_date)')} AS order_day_of_week, {i('quarter(o.order_date)')} AS order_quarter, o.customer_id, {d('o.total_amount')} AS order_total, o.order_status,
           o.payment_method, NULL::VARCHAR AS payment_status, o.shipping_country, o.shipping_state, NULL::VARCHAR AS shipping_city, NULL::DOUBLE AS order_shipping,
           {nulls('created_at updated_at', 'TIMESTAMP')}, {d('q.subtotal')} AS order_subtotal, {d('q.tax')} AS order_tax, {d('q.off')} AS order_discount, c.email AS customer_email,
           c.first_name || ' ' || c.last_name AS customer_name, c.loyalty_tier AS customer_loyalty_tier, {SEGMENT.format('c.lifetime_value', '')} AS customer_segment,
           c.total_orders = 1 AS is_first_purchase, p.category AS product_category, p.subcategory AS product_subcategory, p.brand AS product_brand,
           o.order_status = 'returned' AS is_returned, t.discount_amount > 0 AS is_discounted
    FROM in_items t JOIN in_archive o USING (order_id) JOIN in_customers c ON c.customer_id = o.customer_id JOIN in_products p ON p.product_id = t.product_id
    JOIN (SELECT order_id, sum(unit_price * quantity) AS subtotal, sum(tax_amount) AS tax, sum(discount_amount) AS off FROM in_items GROUP BY 1) q ON q.order_id = t.order_id
    WHERE o.order_status IN ('delivered', 'returned')"""
_SQL["commerce_customer_dim"] = f"""
    SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, email, first_name, last_name, first_name || ' ' || last_name AS full_name,
           {nulls('phone age_group gender shipping_street shipping_city shipping_state shipping_zip shipping_country preferred_payment_method rfm_score preferred_category')},
           {nulls('days_since_first_order days_since_last_order', 'BIGINT')}, created_at, {nulls('updated_at', 'TIMESTAMP')}, total_orders, total_orders * 3 AS total_items_purchased,
           {d('lifetime_value')} AS lifetime_value, {r('CASE WHEN total_orders > 0 THEN lifetime_value::DOUBLE / total_orders ELSE 0 END')} AS average_order_value, loyalty_tier,
           {SEGMENT.format('lifetime_value', "WHEN total_orders = 0 THEN 'new'")} AS customer_segment, marketing_opt_in, {VERSION.format('created_at')} FROM in_customers"""
_SQL["product_dim"] = f"""
    SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, sku, name, NULL::VARCHAR AS description, category, subcategory, brand, {d('price')} AS current_price,
           {d('cost')} AS cost, {r('CASE WHEN cost > 0 THEN (price::DOUBLE - cost::DOUBLE) / price::DOUBLE * 100 ELSE 0 END')} AS margin_percent,
           0::BIGINT AS total_units_sold, 0::BIGINT AS total_revenue, 0::BIGINT AS return_rate, 0::BIGINT AS days_out_of_stock, NULL::DOUBLE AS average_rating, NULL::BIGINT AS review_count,
           NULL::DOUBLE AS weight_kg, {nulls('dimensions_cm')}, NULL::DATE AS discontinuation_date, created_at, {nulls('updated_at', 'TIMESTAMP')},
           stock_quantity AS current_stock, 10::BIGINT AS reorder_level, is_active, {VERSION.format('created_at')} FROM in_products"""
_SQL["metrics_fact"] = f"""
    SELECT w.reading_id, w.device_id, w.reading_timestamp, CAST(w.reading_timestamp AS DATE) AS reading_date, {i('year(w.reading_timestamp)')} AS reading_year,
           {i('month(w.reading_timestamp)')} AS reading_month, {i('day(w.reading_timestamp)')} AS reading_day, {i('hour(w.reading_timestamp)')} AS reading_hour,
           {i('minute(w.reading_timestamp)')} AS reading_minute, {i('isodow(w.reading_timestamp)')} AS day_of_week, {nulls('device_name manufacturer location_name location_building location_floor location_room data_quality')},
           {nulls('latitude longitude gps_latitude gps_longitude gps_altitude gps_speed', 'DOUBLE')}, NULL::BIGINT AS sequence_number, w.reading_timestamp AS created_at, v.device_type, v.model, v.site_id, v.zone, w.temperature, w.humidity, w.pressure, w.energy_kwh, w.co2_ppm, w.pm25_ugm3, w.voc_ppb, w.water_flow_lpm,
           NULL::DOUBLE AS vibration_hz, NULL::DOUBLE AS light_lux, w.signal_strength, w.battery_level, w.motion_detected, w.temperature AS temperature_celsius,
           {r('w.temperature * 9.0::DOUBLE / 5.0::DOUBLE + 32')} AS temperature_fahrenheit, false AS is_anomaly, 0.0::DOUBLE AS anomaly_score
    FROM in_wide w JOIN in_devices v USING (device_id) WHERE CAST(w.reading_timestamp AS DATE) < DATE '2024-01-30'"""
_SQL["device_dim"] = f"""
    SELECT row_number() OVER (ORDER BY device_id) AS device_key, device_id, {nulls('device_name manufacturer location_name location_building location_floor location_room')}, device_type, device_class, model, firmware_version, site_id, zone,
           {nulls('latitude longitude avg_uptime_percentage', 'DOUBLE')}, NULL::DATE AS warranty_expiry_date, NULL::BIGINT AS total_readings, signal_strength_dbm AS avg_signal_strength,
           installed_at AS created_at, updated_at, installed_at AS installation_date, battery_percent AS avg_battery_level, 0::BIGINT AS total_downtime_hours, 0::BIGINT AS error_count, 0::BIGINT AS warning_count, 0::BIGINT AS alert_count,
           0::BIGINT AS maintenance_count, 85.0::DOUBLE AS data_quality_score, 0.02::DOUBLE AS anomaly_rate, status AS current_status, last_heartbeat AS last_seen,
           date_diff('day', DATE '2023-06-01' + CAST(CAST(device_id AS BIGINT) % 200 AS INTEGER), CAST({NOW} AS DATE)) AS days_since_last_maintenance, {VERSION.format('installed_at')}
    FROM in_devices"""


def _stat(fn: str, c: str, name: str) -> str:
    return f"{r(f'{fn}({c})')} AS {name}"


_SQL["wide_hourly"] = f"""
    SELECT h.*, {nulls('location_building location_floor')}, v.device_type, {i('year(aggregate_timestamp)')} AS aggregate_year, {i('month(aggregate_timestamp)')} AS aggregate_month,
           {i('day(aggregate_timestamp)')} AS aggregate_day, {i('hour(aggregate_timestamp)')} AS aggregate_hour, 4::BIGINT AS expected_reading_count,
           greatest(0, 4 - reading_count) AS missing_reading_count, 0::BIGINT AS anomaly_count, 0.0::DOUBLE AS anomaly_rate
    FROM (SELECT device_id, date_trunc('hour', reading_timestamp) AS aggregate_timestamp, count(*) AS reading_count,
             {', '.join(_stat(f, c, f'{f}_{c}') for c in ('temperature', 'humidity', 'pressure') for f in ('avg', 'min', 'max'))},
             {_stat('stddev_samp', 'temperature', 'stddev_temperature')}, {_stat('sum', 'energy_kwh', 'total_energy_kwh')}, {_stat('avg', 'energy_kwh', 'avg_power_kw')},
             {_stat('max', 'energy_kwh', 'peak_power_kw')}, {_stat('avg', 'co2_ppm', 'avg_co2_ppm')}, {_stat('max', 'co2_ppm', 'max_co2_ppm')},
             {_stat('avg', 'pm25_ugm3', 'avg_pm25_ugm3')}, {_stat('max', 'pm25_ugm3', 'max_pm25_ugm3')}, {_stat('avg', 'voc_ppb', 'avg_voc_ppb')},
             count(*) FILTER (motion_detected) AS motion_events, count(*) FILTER (motion_detected) * 15 AS motion_duration_minutes,
             {_stat('sum', 'water_flow_lpm * 15', 'total_water_flow_liters')}, {_stat('avg', 'water_flow_lpm', 'avg_flow_rate_lpm')},
             {_stat('avg', 'signal_strength', 'avg_signal_strength')}, {_stat('min', 'signal_strength', 'min_signal_strength')},
             {_stat('avg', 'battery_level', 'avg_battery_level')}, {_stat('min', 'battery_level', 'min_battery_level')}, max(reading_timestamp) AS created_at
          FROM in_wide WHERE CAST(reading_timestamp AS DATE) < DATE '2024-01-30' GROUP BY 1, 2) h JOIN in_devices v USING (device_id)"""
_SQL["transaction_fact"] = f"""
    SELECT t.transaction_id, t.account_id, a.customer_id, t.txn_timestamp AS transaction_timestamp, t.txn_date AS transaction_date, {i('year(t.txn_date)')} AS transaction_year,
           {i('month(t.txn_date)')} AS transaction_month, {i('day(t.txn_date)')} AS transaction_day, {i('hour(t.txn_timestamp)')} AS transaction_hour,
           {i('isodow(t.txn_date)')} AS day_of_week, {i('day(t.txn_date)')} AS day_of_month, {i('weekofyear(t.txn_date)')} AS week_of_year, {i('quarter(t.txn_date)')} AS quarter,
           t.transaction_type, {d('t.amount')} AS amount, NULL::DOUBLE AS balance_change, {nulls('balance_before balance_after latitude longitude', 'DOUBLE')}, NULL::BOOLEAN AS is_flagged,
           {nulls('transaction_category currency from_account_id to_account_id merchant_category_code location_city location_state device_id')}, {nulls('created_at', 'TIMESTAMP')}, a.account_type, NULL::VARCHAR AS account_subtype, c.customer_type,
           c.risk_tier AS customer_risk_rating, {BALANCE} AS customer_segment, t.merchant_name, t.merchant_category, t.merchant_country AS location_country, t.channel,
           CASE WHEN t.channel IN ('mobile', 'online') THEN 'digital' ELSE 'physical' END AS device_type, t.status, t.status = 'completed' AS is_completed, t.fraud_score,
           t.fraud_score > 0.7::DOUBLE AS is_fraud, CASE WHEN t.fraud_score > 0.8::DOUBLE THEN 'high_risk' WHEN t.fraud_score > 0.5::DOUBLE THEN 'medium_risk' ELSE 'low_risk' END AS fraud_type,
           t.amount > 10000 AS is_large_cash, t.fraud_score > 0.8::DOUBLE AS requires_sar, isodow(t.txn_date) IN (6, 7) AS is_weekend,
           hour(t.txn_timestamp) BETWEEN 9 AND 17 AS is_business_hours, t.merchant_country <> 'USA' AS is_cross_border, false AS is_reversed, false AS is_structured, false AS is_high_risk_merchant
    FROM in_txn_archive t JOIN in_accounts a ON a.account_id = t.account_id JOIN in_fin_customers c ON c.customer_id = a.customer_id WHERE t.txn_date < {TODAY}"""
_SQL["account_dim"] = f"""
    SELECT row_number() OVER (ORDER BY account_id) AS account_key, account_id, customer_id, {nulls('account_number account_subtype currency')}, account_type, {nulls('available_balance credit_limit', 'DOUBLE')}, NULL::DATE AS closed_date,
           0::BIGINT AS total_deposits, 0::BIGINT AS total_withdrawals, 0::BIGINT AS total_fees_paid, 0::BIGINT AS total_interest_earned, 0::BIGINT AS avg_transaction_amount,
           0::BIGINT AS nsf_count, 0::BIGINT AS lifetime_fees, 0::BIGINT AS lifetime_interest, 0::BIGINT AS estimated_profitability, opened_date AS created_at, {nulls('updated_at', 'TIMESTAMP')},
           {d('current_balance')} AS current_balance, {d('current_balance')} AS monthly_avg_balance, date_diff('day', opened_date, {TODAY}) AS days_since_opened,
           date_diff('day', last, {TODAY}) AS days_since_last_transaction, 0::BIGINT AS transaction_count, 0.0::DOUBLE AS balance_volatility, 0::BIGINT AS overdraft_count,
           0::BIGINT AS fraud_alert_count, 0.1::DOUBLE AS risk_score, status, opened_date, status = 'active' AS is_active, {VERSION.format('opened_date')}
    FROM in_accounts LEFT JOIN (SELECT account_id, max(txn_date) AS last FROM in_txn_archive GROUP BY 1) USING (account_id)"""
_SQL["financial_customer_dim"] = f"""
    SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, customer_type, first_name, last_name, {nulls('business_name age_group city state country kyc_status preferred_channel preferred_transaction_type')},
           NULL::BIGINT AS credit_score, NULL::DOUBLE AS aml_risk_score, NULL::BOOLEAN AS pep_status, {nulls('kyc_verified_date sanctions_check_date', 'DATE')}, created_at, {nulls('updated_at', 'TIMESTAMP')},
           total_accounts, total_accounts AS active_accounts, total_accounts AS products_held, {d('total_balance')} AS total_balance,
           date_diff('day', created_at, {TODAY}) AS relationship_length_days, risk_tier AS risk_rating, risk_tier = 'high' AS requires_enhanced_dd, 0::BIGINT AS total_transactions,
           0::BIGINT AS avg_transaction_amount, 0.5::DOUBLE AS cross_sell_score, 0::BIGINT AS fraud_incidents, {d('total_balance')} AS lifetime_value,
           {r('total_balance::DOUBLE * 0.02::DOUBLE')} AS estimated_annual_revenue, {BALANCE} AS customer_segment, 'active' AS status, created_at AS customer_since,
           last_login AS last_contact_date, {VERSION.format('created_at')} FROM in_fin_customers"""

_SQL["alerts_with_weather"] = f"""
    SELECT a.* EXCLUDE (metric_value, threshold_value), {d('a.metric_value')} AS metric_value, {d('a.threshold_value')} AS threshold_value,
           w.observation_time, w.temperature_c, w.humidity_pct, w.conditions
    FROM in_alerts_month a ASOF LEFT JOIN in_weather w ON w.site_id = a.site_id AND w.observation_time <= a.raised_at"""
_SQL["firmware_in_force"] = """
    SELECT a.device_id, a.alert_id, a.raised_at, f.firmware_version, f.deployed_at FROM in_alerts_month a
    LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS device_id, '1.' || ((c_custkey + k) % 5) AS firmware_version,
                      TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k * 15 AS INTEGER)) AS deployed_at,
                      CASE WHEN k = 0 THEN TIMESTAMP '2024-01-16 00:00:00' END AS retired_at FROM customer CROSS JOIN (VALUES (0), (1)) w(k)) f
      ON f.device_id = a.device_id AND a.raised_at >= f.deployed_at AND (a.raised_at < f.retired_at OR f.retired_at IS NULL)"""
_SQL["before_failures"] = f"""
    SELECT f.failure_id, f.device_id, f.failure_timestamp, f.firmware_version, count(e.metric_value) AS readings_72h, {r(m('e.metric_value'))} AS mean_72h,
           count(e.metric_value) FILTER (e.reading_timestamp >= f.failure_timestamp - INTERVAL 12 HOUR) AS readings_12h,
           {r("CAST(sum(e.metric_value) FILTER (e.reading_timestamp >= f.failure_timestamp - INTERVAL 12 HOUR) AS DOUBLE) / nullif(count(e.metric_value) FILTER (e.reading_timestamp >= f.failure_timestamp - INTERVAL 12 HOUR), 0)")} AS mean_12h,
           {r('any_value(o.a)')} AS device_mean,
           {r("(CAST(sum(e.metric_value) FILTER (e.reading_timestamp >= f.failure_timestamp - INTERVAL 12 HOUR) AS DOUBLE) / nullif(count(e.metric_value) FILTER (e.reading_timestamp >= f.failure_timestamp - INTERVAL 12 HOUR), 0) - any_value(o.a)) / any_value(o.a)")} AS drift_12h
    FROM in_failures f LEFT JOIN in_readings e ON e.device_id = f.device_id AND e.reading_timestamp >= f.failure_timestamp - INTERVAL 72 HOUR AND e.reading_timestamp < f.failure_timestamp
    LEFT JOIN (SELECT device_id, {m('metric_value')} AS a FROM in_readings GROUP BY 1) o ON o.device_id = f.device_id
    GROUP BY 1, 2, 3, 4"""
_SQL["failure_rate_by_firmware"] = f"""
    SELECT firmware_version, n AS devices, coalesce(k, 0) AS failures, {r('coalesce(k, 0)::DOUBLE / n')} AS failure_rate,
           {r('(coalesce(k, 0)::DOUBLE / n) / (sum(coalesce(k, 0)) OVER ()::DOUBLE / sum(n) OVER ())')} AS ratio_to_fleet
    FROM (SELECT firmware_version, count(*) AS n FROM in_devices GROUP BY 1) LEFT JOIN (SELECT firmware_version, count(*) AS k FROM in_failures GROUP BY 1) USING (firmware_version)"""
_SQL["site_daily"] = f"""
    SELECT h.*, coalesce(a.n, 0) AS alerts_raised, coalesce(a.c, 0) AS alerts_critical FROM (
      SELECT site_id, dt AS summary_date, count(*) AS device_count, {i('sum(n)')} AS readings_received, {r('sum(n - bad) * 100::DOUBLE / sum(n)')} AS uptime_pct,
             {r('sum(battery_percent)::DOUBLE / count(*)')} AS avg_battery_pct
      FROM (SELECT device_id, CAST(reading_timestamp AS DATE) AS dt, count(*) AS n, count(*) FILTER (quality_code = 'bad') AS bad FROM in_readings GROUP BY 1, 2)
      JOIN in_devices USING (device_id) GROUP BY 1, 2) h
    LEFT JOIN (SELECT site_id, CAST(raised_at AS DATE) AS summary_date, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM in_alerts_month GROUP BY 1, 2) a
      USING (site_id, summary_date)"""
_SQL["merged_windows"] = "SELECT * FROM in_merged"
_SQL["site_downtime"] = """
    SELECT site_id, count(*) AS outages, CAST(sum(windows_merged) AS BIGINT) AS windows, CAST(sum(date_sub('second', window_start, window_end)) AS BIGINT) AS downtime_seconds,
           max(date_sub('second', window_start, window_end)) AS longest_seconds FROM in_merged GROUP BY 1"""
_SQL["click_sessions"] = "SELECT * FROM in_sessions"
_SQL["daily_bars"] = f"""
    SELECT ticker, quote_date, {d('open_price')} AS open_price, {d('high_price')} AS high_price, {d('low_price')} AS low_price, {d('close_price')} AS close_price, volume FROM in_bars"""
_SQL["running_stock"] = f"""
    SELECT product_id, transaction_date, transaction_id, quantity_change,
           {i('lvl - least(0, min(lvl) OVER (PARTITION BY product_id ORDER BY transaction_date, transaction_id))')} AS quantity_after
    FROM (SELECT s.*, p.stock_quantity + sum(quantity_change) OVER (PARTITION BY product_id ORDER BY transaction_date, transaction_id) AS lvl
          FROM in_stock s JOIN in_products p USING (product_id))"""
_SQL["demand_index"] = f"""
    SELECT product_category, week_start_date, {i('wk')} AS week_of_year, units, {r('units::DOUBLE / nullif(avg(units) OVER past, 0)')} AS trend_ratio,
           {r('(count(*) OVER past * sum(t * units) OVER past - sum(t) OVER past * sum(units) OVER past) / nullif(count(*) OVER past * sum(t * t) OVER past - (sum(t) OVER past) * (sum(t) OVER past), 0)')} AS trend_slope,
           {r('avg(units) OVER (PARTITION BY product_category, wk) / avg(units) OVER (PARTITION BY product_category)')} AS season_index,
           CASE WHEN wk IN (47, 48, 51) THEN {r('units::DOUBLE / (avg(CASE WHEN wk NOT IN (47, 48, 51) THEN units END) OVER (PARTITION BY product_category))')} END AS promo_lift
    FROM (SELECT product_category, CAST(date_trunc('week', order_date) AS DATE) AS week_start_date, weekofyear(date_trunc('week', order_date)) AS wk, {i('sum(quantity)')} AS units,
                 date_diff('day', DATE '1990-01-01', CAST(date_trunc('week', order_date) AS DATE))::DOUBLE / 7 AS t
          FROM in_items JOIN in_archive USING (order_id) GROUP BY ALL)
    WINDOW past AS (PARTITION BY product_category ORDER BY week_start_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""
_SQL["market_regimes"] = f"""
    SELECT CASE WHEN quote_date >= DATE '2000-07-01' THEN 3 WHEN quote_date >= DATE '1999-01-01' THEN 2 WHEN quote_date >= DATE '1997-01-01' THEN 1 ELSE 0 END::BIGINT AS regime,
           count(*) AS days, {r('avg(market_return)')} AS mean_return, {r('stddev_samp(market_return)')} AS return_stddev FROM in_market GROUP BY 1"""
_SQL["account_beta"] = f"""
    SELECT account_id, count(*) AS days, {r('covar_samp(daily_return_pct, market_return) / nullif(var_samp(market_return), 0)')} AS beta
    FROM in_portfolio JOIN in_market ON metric_date = quote_date GROUP BY 1"""
_SQL["spend_seasonality"] = f"""
    SELECT calendar_month, count(*) AS months, {r('CAST(sum(s) AS DOUBLE) / count(*)')} AS mean_spend,
           {r('(CAST(sum(s) AS DOUBLE) / count(*)) / any_value(whole)')} AS season_index
    FROM (SELECT *, CAST(sum(s) OVER () AS DOUBLE) / count(*) OVER () AS whole FROM (
        SELECT year(txn_date) AS y, {i('month(txn_date)')} AS calendar_month, sum(amount) AS s FROM in_txn_archive GROUP BY 1, 2)) GROUP BY 1"""
_SQL["order_numbers"] = "SELECT order_id, row_number() OVER (ORDER BY order_id) AS order_number FROM in_archive"
_SQL["running_customer_value"] = f"""
    SELECT customer_id, order_id, order_date, {d('total_amount')} AS total_amount, {d('sum(total_amount) OVER w')} AS value_so_far, {d('max(total_amount) OVER w')} AS largest_so_far,
           lag(order_date) OVER w AS previous_date, row_number() OVER w AS order_number
    FROM in_archive WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)"""
_SQL["running_customer_value_in_buckets"] = _SQL["running_customer_value"]
_SQL["newest_order"] = f"""
    SELECT DISTINCT ON (customer_id) customer_id, order_date, order_id, order_status, {d('total_amount')} AS total_amount FROM in_archive ORDER BY customer_id, order_date DESC, order_id DESC"""
_SQL["order_calendar"] = f"""
    SELECT DISTINCT order_date, {i('year(order_date)')} AS year, {i('month(order_date)')} AS month, {i('day(order_date)')} AS day, {i('quarter(order_date)')} AS quarter,
           {i('isodow(order_date)')} AS weekday, {i('weekofyear(order_date)')} AS week, CAST(date_trunc('week', order_date) AS DATE) AS monday,
           CAST(date_trunc('month', order_date) AS DATE) AS month_start, last_day(order_date) AS month_end, date_diff('day', order_date, {TODAY}) AS days_ago FROM in_archive"""
_SQL["typed_csv_rows"] = "SELECT event_id, ts, CASE WHEN event_id % 89 <> 0 THEN user_id END AS user_id, event_type, value FROM events WHERE event_id % 97 <> 0"
_SQL["typed_csv_rejects"] = "SELECT CAST(event_id AS VARCHAR) AS event_id, 'n/a' AS value, 'value' AS faulty_columns FROM events WHERE event_id % 97 = 0"
_SQL["load_reconciliation"] = """
    SELECT 'events' AS table_name, count(*) AS source_rows, count(*) FILTER (event_id % 97 <> 0) AS target_rows, count(*) FILTER (event_id % 97 = 0) AS rejected_rows, true AS balanced FROM events"""
_SQL["guessed_csv_rows"] = """
    SELECT event_id, ts, CASE WHEN event_id % 89 <> 0 THEN CAST(user_id AS DOUBLE) END AS user_id, CASE WHEN event_id % 97 <> 0 THEN value END AS value,
           'double' AS user_type, 'string' AS value_type FROM events"""
_SQL["batched_csv_rows"] = "SELECT event_id, user_id, event_type, 'events' AS table_name FROM events"
_SQL["blank_cells_as_null"] = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE event_type END AS label, value FROM events"
_SQL["json_cells"] = """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2::BIGINT AS n_ids, event_id AS first_id, user_id AS second_id FROM events WHERE event_id % 31 <> 0"""
_SQL["uuid_forms"] = """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN h WHEN event_id % 5 = 0 THEN upper(u) WHEN event_id % 7 = 0 THEN left(u, 35) ELSE u END AS id,
           event_id % 3 <> 0 AND (event_id % 5 = 0 OR event_id % 7 <> 0) AS is_uuid
    FROM (SELECT event_id, h, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS u FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events))"""
_SQL["clamped_values"] = "SELECT event_id, least(greatest(value, 10), 50) AS value FROM events"
_SQL["conformed_archive"] = f"""
    SELECT device_id, reading_timestamp, metric_name, {d('metric_value')} AS metric_value, quality_code, {i('year(reading_timestamp)')} AS reading_year,
           {i('month(reading_timestamp)')} AS reading_month FROM in_readings"""
_SQL["tiered_readings"] = f"""
    SELECT CASE WHEN reading_timestamp < {NOW} - INTERVAL 24 HOUR THEN 'cold' ELSE 'hot' END AS tier, device_id, count(*) AS readings,
           min(reading_timestamp) AS first, max(reading_timestamp) AS last FROM in_readings GROUP BY 1, 2"""
_SQL["archived_readings"] = f"""
    SELECT device_id, reading_timestamp, metric_name, {d('metric_value')} AS metric_value,
           CASE WHEN reading_timestamp < {NOW} - INTERVAL 24 HOUR THEN 'cold' ELSE 'hot' END AS tier FROM in_readings"""
_SQL["upserted_lines"] = f"""
    SELECT l_orderkey, l_partkey, l_suppkey, {i('l_linenumber')} AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
           CAST(l_shipdate AS TIMESTAMP) AS l_shipdate FROM in_lines"""
_SQL["upserted_readings"] = """
    SELECT CAST(user_id AS VARCHAR) AS device_id, ts AS reading_timestamp, event_type AS metric_name, CAST(CAST(value AS DECIMAL(18,4)) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS metric_value,
           CASE event_id % 10 WHEN 0 THEN 'bad' WHEN 1 THEN 'suspect' ELSE 'good' END AS quality_code, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS seq FROM events"""
_SQL["table_profile"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, {n}::BIGINT AS column_count"
    for t, n in dict(region=2, nation=3, customer=5, supplier=4, part=6, orders=6, lineitem=11, events=6, documents=5, embeddings=3, pages=3, benchmark=2, labels=3, conversations=4).items()
)
_SQL["stream_hourly_rollup"] = f"""
    SELECT device_id, metric_name, date_trunc('hour', reading_timestamp) AS hour_start, count(*) AS sample_count, {d('min(metric_value)')} AS min_value,
           {d('max(metric_value)')} AS max_value, {r(m('metric_value'))} AS avg_value, {d('quantile_disc(metric_value, 0.95)')} AS p95_value,
           {r('stddev_pop(metric_value::DOUBLE)')} AS stddev_value
    FROM in_readings GROUP BY 1, 2, 3
    HAVING date_trunc('hour', reading_timestamp) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
_SQL["stream_replayed_events"] = "SELECT event_id, ts, user_id, event_type, value FROM events"
_SQL["stream_newest_state"] = """
    SELECT DISTINCT ON (user_id, event_type) user_id, event_type, ts, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC"""
_SQL["stream_anomaly_flags"] = f"""
    SELECT e.device_id, e.metric_name, e.reading_timestamp, {d('e.metric_value')} AS metric_value,
           CASE WHEN b.baseline_hours IS NULL THEN 'unknown' WHEN e.metric_value > b.baseline_p95 THEN 'anomalous'
                WHEN abs(e.metric_value - b.baseline_avg) > greatest(2 * b.baseline_stddev, 0.1 * b.baseline_avg) THEN 'anomalous' ELSE 'normal' END AS anomaly_status,
           CASE WHEN b.baseline_hours IS NULL THEN 'no_baseline' WHEN e.metric_value > b.baseline_p95 THEN 'above_p95'
                WHEN abs(e.metric_value - b.baseline_avg) > greatest(2 * b.baseline_stddev, 0.1 * b.baseline_avg) THEN 'deviation' END AS reason_code
    FROM in_readings e LEFT JOIN in_baseline b USING (device_id, metric_name) WHERE e.quality_code <> 'bad'"""
_SQL["stream_sessions"] = """
    SELECT customer_id, session_start, session_end, event_count, page_views, cart_additions FROM in_sessions
    WHERE session_end + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in re.findall(r"\bin_[a-z_0-9]+\b", sql):
        if name in _INPUTS and name not in seen:
            _needed(_INPUTS[name], seen)
            seen[name] = None


def with_inputs(sql: str) -> str:
    seen: dict[str, None] = {}
    _needed(sql, seen)
    if not seen:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({_INPUTS[n].strip()})" for n in seen) + "\n" + sql.strip()


def oracle_sql() -> dict[str, str]:
    return {name: with_inputs(sql) for name, sql in _SQL.items()}
