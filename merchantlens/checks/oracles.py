"""The expected results as DuckDB SQL over the test tables, written row by row and unoptimized."""

from __future__ import annotations

# The bronze mapping of FIXTURES.md and the models, each using only those before it.
RELATIONS = {
    "b_sellers": """
        SELECT c_custkey AS seller_id, n_name AS seller_city, r_name AS seller_state
        FROM customer, nation, region
        WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "b_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate + to_hours(o_orderkey % 24) AS purchased,
               purchased + to_hours(1 + o_orderkey % 8) AS approved,
               approved + to_days((1 + o_orderkey % 3)::INT) AS handed_over,
               CASE WHEN NOT (o_orderstatus = 'O' AND o_orderkey % 4 = 0)
                    THEN o_orderdate + to_days((3 + o_orderkey % 23)::INT) + to_hours((o_orderkey * 7) % 24)
               END AS delivered,
               o_orderdate + to_days((10 + o_custkey % 14)::INT) AS estimated
        FROM orders""",
    "b_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               o_custkey + l_linenumber % 2 AS seller_id,
               round(l_extendedprice * 100) * 100 AS price,
               round(l_extendedprice * 100) * round(l_discount * 100) AS freight
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE (o_custkey + l_linenumber % 2) % 50 <> 0""",
    "b_reviews": """
        SELECT o_orderkey AS order_id, 1 + o_orderkey % 5 AS score FROM orders WHERE o_orderkey % 6 <> 0
        UNION ALL
        SELECT o_orderkey, 1 + (o_orderkey + 2) % 5 FROM orders WHERE o_orderkey % 7 = 0""",
    "m_orders": """
        SELECT *, delivered::DATE - purchased::DATE AS actual_days,
               estimated::DATE - purchased::DATE AS promised_days
        FROM b_orders""",
    "m_item_orders": """
        SELECT i.order_id, i.order_item_id, i.seller_id, o.actual_days AS days,
               coalesce(o.delivered > o.estimated, false)::INT AS late
        FROM b_items i, m_orders o WHERE i.order_id = o.order_id""",
    "m_scores": """
        SELECT i.seller_id, avg(v.score) AS score
        FROM b_items i, b_reviews v WHERE i.order_id = v.order_id
        GROUP BY ALL""",
    "m_sellers": """
        SELECT s.seller_id, s.seller_city, s.seller_state, coalesce(d.n, 0) AS n_orders,
               d.late_rate, d.mean_days, m_scores.score
        FROM b_sellers s
        LEFT JOIN (SELECT seller_id, count(DISTINCT order_id) AS n, avg(late) AS late_rate,
                          avg(days) AS mean_days
                   FROM m_item_orders GROUP BY ALL) d USING (seller_id)
        LEFT JOIN m_scores USING (seller_id)""",
    "m_performance": """
        WITH row_by_row AS (
            SELECT i.*, o.actual_days, v.score
            FROM b_items i
            JOIN m_orders o ON o.order_id = i.order_id
            LEFT JOIN b_reviews v ON v.order_id = i.order_id),
        summed AS (
            SELECT seller_id, count(DISTINCT order_id) AS n_orders, count(DISTINCT product_id) AS n_products,
                   avg(actual_days) AS mean_days, avg(score) AS mean_score,
                   sum(price) AS revenue, sum(freight) AS freight
            FROM row_by_row GROUP BY seller_id)
        SELECT s.seller_id, s.seller_city, s.seller_state, n_orders AS total_orders,
               n_products AS unique_products, round(mean_days, 2) AS avg_delivery_days,
               round(mean_score, 2) AS avg_review_score, revenue AS total_revenue,
               freight AS total_freight_cost,
               CASE WHEN revenue <> 0 THEN round(freight / revenue * 100, 2) END AS freight_pct_of_revenue
        FROM b_sellers s JOIN summed USING (seller_id)""",
    "m_risk": """
        SELECT seller_id, seller_city, seller_state, n_orders AS total_orders,
               round(late_rate, 4) AS late_delivery_rate, round(score, 4) AS avg_review_score,
               round(mean_days, 2) AS avg_delivery_days,
               if(late_rate > 0.3, 'HIGH', if(late_rate > 0.15, 'MEDIUM', 'LOW')) AS risk_tier
        FROM m_sellers WHERE n_orders > 0""",
    "m_states": """
        SELECT seller_state, count(DISTINCT seller_id) AS total_sellers,
               sum(n_orders)::BIGINT AS total_orders,
               sum(n_orders) / (SELECT sum(n_orders) FROM m_sellers) AS share
        FROM m_sellers WHERE n_orders > 0 GROUP BY seller_state""",
    "m_concentration": """
        SELECT seller_state, total_sellers, total_orders, round(share, 4) AS pct_of_total_orders,
               if(share > 0.2, 'HIGH', 'NORMAL') AS concentration_flag
        FROM m_states""",
    "m_summary": """
        SELECT sum(n_orders)::BIGINT AS total_orders, count(DISTINCT seller_id) AS total_sellers,
               round(sum(n_orders * late_rate) / sum(n_orders), 4) AS overall_late_rate,
               round(count(DISTINCT seller_id) FILTER (late_rate > 0.3) / count(DISTINCT seller_id), 4)
                   AS pct_high_risk_sellers,
               round(avg(score), 4) AS avg_review_score
        FROM m_sellers WHERE n_orders > 0""",
    "m_risk_view": """
        SELECT seller_id, seller_state, risk_tier, total_orders,
               round(late_delivery_rate * 100, 1) AS late_rate_pct,
               round(avg_review_score, 2) AS review_score, round(avg_delivery_days, 1) AS delivery_days
        FROM m_risk""",
    "b_observations": """
        SELECT 'N' || c_custkey AS country_code, n_name AS country_name, code AS indicator_code,
               'Logistics ' || code AS indicator_name, y::VARCHAR AS "year",
               CASE WHEN c_custkey % 11 <> 0 THEN 1 + (c_custkey * 3 + pos) % 40 / 10 END AS "value"
        FROM customer JOIN nation ON c_nationkey = n_nationkey,
             (VALUES (0, 'LP.LPI.OVRL.XQ'), (1, 'LP.LPI.CUST.XQ'), (2, 'LP.LPI.INFR.XQ'),
                     (3, 'LP.LPI.ITRN.XQ'), (4, 'LP.LPI.LOGS.XQ'), (5, 'LP.LPI.TRAC.XQ'),
                     (6, 'LP.LPI.TIME.XQ')) AS codes(pos, code),
             range(2018, 2024) AS years(y)""",
    "b_trade": """
        SELECT n_nationkey::VARCHAR AS "reporterCode", if(o_orderkey % 3 = 0, '36', '0') AS "partnerCode",
               if(o_orderkey % 5 = 0, '85', 'TOTAL') AS "cmdCode",
               year(o_orderdate)::VARCHAR AS period, if(o_orderkey % 2 = 0, 'M', 'X') AS "flowCode",
               if(o_orderkey % 7 = 0, '36', '0') AS "partner2Code", if(o_orderkey % 11 = 0, 'S', 'C') AS "typeCode",
               if(o_orderkey % 13 = 0, 'M', 'A') AS "freqCode", if(o_orderkey % 17 = 0, 'S4', 'HS') AS "clCode",
               c_mktsegment AS "customsCode", sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS "primaryValue"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL""",
    "b_answers": r"""
        SELECT conv_id, turn,
               if(turn % 2 = 1, 'ACTION: ', '') || text ||
               if(conv_id % 3 = 0, chr(10) || '  action: follow up ' || chr(10) || '• ACTION: bulleted', '')
                   AS answer
        FROM conversations""",
    "b_replies": """
        SELECT conv_id, turn, role, text,
               CASE conv_id % 4 WHEN 0 THEN [role, text]
                    ELSE ['Review findings and prioritize remediation steps.'] END AS from_reply,
               list_transform(
                   list_filter(string_split(if(turn % 5 = 4, 'Action: ' || role, text), chr(10)),
                               lambda line: starts_with(upper(trim(line)), 'ACTION:')),
                   lambda line: trim(substr(trim(line), 8))) AS from_answer
        FROM conversations""",
}

_LATE_CLASS = "if(overall_late_rate > 0.1, 'warn', '')"
_RISK_CLASS = "if(pct_high_risk_sellers > 0.1, 'danger', if(pct_high_risk_sellers > 0.05, 'warn', ''))"
_REVIEW_CLASS = "if(avg_review_score < 3.5, 'danger', if(avg_review_score < 4.0, 'warn', ''))"

FINAL = {
    "silver_orders": """
        SELECT order_id, customer_id, order_status, purchased AS purchased_at, approved AS approved_at,
               handed_over AS carrier_pickup_at, delivered AS delivered_at,
               estimated AS estimated_delivery_at, actual_days AS actual_delivery_days,
               promised_days AS promised_delivery_days
        FROM m_orders""",
    "silver_sellers": """
        SELECT seller_id, seller_city, seller_state, n_orders AS total_orders,
               late_rate AS late_delivery_rate, mean_days AS avg_delivery_days, score AS avg_review_score
        FROM m_sellers""",
    "join_items_orders": """
        SELECT order_id, order_item_id, seller_id, days AS delivery_days, late AS is_late
        FROM m_item_orders""",
    "join_repeated_hot_orders": """
        WITH ids AS (
            SELECT if(order_id % 1500 = 0, 3, order_id) AS order_id, actual_days AS days,
                   coalesce(delivered > estimated, false)::INT AS late FROM m_orders
            UNION ALL
            SELECT order_id, actual_days, coalesce(delivered > estimated, false)::INT FROM m_orders WHERE order_id % 7 = 0)
        SELECT seller_id, count(*) AS n_rows, sum(days)::BIGINT AS days, sum(late)::BIGINT AS late
        FROM b_items i JOIN ids ON if(i.order_id % 3 = 0, 3, i.order_id) = ids.order_id
        GROUP BY seller_id""",
    "seller_reviews": "SELECT seller_id, score AS avg_review_score FROM m_scores",
    "gold_supplier_performance": "SELECT * FROM m_performance",
    "gold_supplier_risk": "SELECT * FROM m_risk",
    "gold_concentration_risk": "SELECT * FROM m_concentration",
    "gold_executive_summary": "SELECT * FROM m_summary",
    "top_suppliers": """
        SELECT * FROM m_performance ORDER BY avg_review_score DESC NULLS LAST, seller_id LIMIT 50""",
    "supplier_lookup": "SELECT * FROM m_performance WHERE seller_id = 101",
    "risk_view": "SELECT * FROM m_risk_view",
    "risk_view_by_tier": "SELECT * FROM m_risk_view WHERE risk_tier = 'MEDIUM'",
    "tier_counts": """
        SELECT tier AS risk_tier, count(seller_id) AS n_sellers
        FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) AS tiers(tier) LEFT JOIN m_risk ON risk_tier = tier
        GROUP BY tier""",
    "concentration_view": """
        SELECT seller_state, total_sellers, total_orders, round(pct_of_total_orders * 100, 2) AS pct,
               concentration_flag
        FROM m_concentration""",
    "concentration_alert": """
        SELECT string_agg(seller_state, ', ' ORDER BY round(pct_of_total_orders * 100, 2) DESC, seller_state)
               || if(count(*) = 1, ' accounts', ' account') || ' for >20% of all orders.' AS alert
        FROM m_concentration WHERE concentration_flag = 'HIGH' HAVING count(*) > 0""",
    "kpi_severity": f"""
        SELECT {_LATE_CLASS} AS late_rate_class, {_RISK_CLASS} AS high_risk_class,
               {_REVIEW_CLASS} AS review_class
        FROM m_summary""",
    "kpi_report": """
        SELECT 'Total orders: ' || format('{:,}', total_orders) || chr(10)
               || 'Total sellers: ' || format('{:,}', total_sellers) || chr(10)
               || 'Overall late delivery rate: ' || format('{:.1f}%', overall_late_rate * 100) || chr(10)
               || '% high-risk sellers: ' || format('{:.1f}%', pct_high_risk_sellers * 100) || chr(10)
               || 'Average review score: ' || format('{:.2f}', avg_review_score) || ' / 5.00' AS report
        FROM m_summary""",
    "read_only_sql": """
        SELECT seller_id, seller_state, late_delivery_rate FROM m_risk
        ORDER BY late_delivery_rate DESC, seller_id""",
    "action_items": r"""
        WITH found AS (
            SELECT conv_id, turn, list_transform(
                list_filter(string_split(answer, chr(10)),
                            lambda line: starts_with(upper(trim(line)), 'ACTION:')),
                lambda line: trim(substr(trim(line), 8)))[1:4] AS found
            FROM b_answers)
        SELECT conv_id, turn, array_to_string(found, ' / ') AS items, len(found) AS n_items FROM found""",
    "action_items_json": """
        SELECT conv_id, turn, array_to_string(chosen, ' / ') AS items, len(chosen) AS n_items
        FROM (SELECT *, if(len(from_answer) > 0, from_answer[1:4], from_reply) AS chosen FROM b_replies)""",
    "csv_ingest": """
        SELECT conv_id || '-' || turn AS review_id, conv_id::VARCHAR AS order_id,
               (1 + turn % 5)::INT AS review_score,
               'said "' || role || '", then' AS review_comment_title, text AS review_comment_message,
               make_timestamp(2018, 3, 1 + conv_id % 28, 10, 30, 0) AS review_creation_date
        FROM conversations WHERE conv_id % 9 <> 0""",
    "bronze_manifest_counts": """
        SELECT 'sellers' AS table_name, count(*) AS n_rows FROM b_sellers
        UNION ALL SELECT 'orders', count(*) FROM b_orders
        UNION ALL SELECT 'order_items', count(*) FROM b_items
        UNION ALL SELECT 'order_reviews', count(*) FROM b_reviews
        UNION ALL SELECT 'customers', count(*) FROM customer
        UNION ALL SELECT 'geolocation', count(*) FROM supplier
        UNION ALL SELECT 'order_payments', count(*) FROM orders
        UNION ALL SELECT 'products', count(*) FROM part
        UNION ALL SELECT 'product_category_name_translation', count(*) FROM nation""",
    "bronze_lineage": """
        SELECT table_name, source_file, true AS has_load_time, n_rows FROM (
            SELECT 'sellers' AS table_name, 'olist_sellers_dataset.csv' AS source_file, count(*) AS n_rows FROM b_sellers
            UNION ALL SELECT 'orders', 'olist_orders_dataset.csv', count(*) FROM b_orders
            UNION ALL SELECT 'order_items', 'olist_order_items_dataset.csv', count(*) FROM b_items
            UNION ALL SELECT 'order_reviews', 'olist_order_reviews_dataset.csv', count(*) FROM b_reviews
            UNION ALL SELECT 'customers', 'olist_customers_dataset.csv', count(*) FROM customer
            UNION ALL SELECT 'geolocation', 'olist_geolocation_dataset.csv', count(*) FROM supplier
            UNION ALL SELECT 'order_payments', 'olist_order_payments_dataset.csv', count(*) FROM orders
            UNION ALL SELECT 'products', 'olist_products_dataset.csv', count(*) FROM part
            UNION ALL SELECT 'product_category_name_translation', 'product_category_name_translation.csv', count(*)
                FROM nation)""",
    "table_refresh": """
        SELECT lower(order_status) AS order_status, 2::INT AS revision, count(*) AS n_rows,
               max(order_id) AS last_order_id
        FROM b_orders GROUP BY order_status""",
    "lpi_flatten": "SELECT * FROM b_observations",
    "lpi_load": "SELECT * FROM b_observations",
    "trade_flows_load": "SELECT * FROM b_trade",
    "trade_flows_select": """
        SELECT * FROM b_trade
        WHERE "reporterCode" = '7' AND "partnerCode" = '0' AND "cmdCode" = 'TOTAL' AND period = '1997'
          AND "flowCode" = 'X' AND "partner2Code" = '0' AND "typeCode" = 'C' AND "freqCode" = 'A'
          AND "clCode" = 'HS'""",
    "lpi_rejects": """
        SELECT (SELECT count(*) FROM b_observations) AS n_rows,
               (SELECT count(*) + count(*) FILTER (c_custkey % 2 = 0) FROM customer) AS n_rejects""",
    "trade_rejects": """
        SELECT (SELECT count(*) FROM b_trade) AS n_rows,
               (SELECT count(*) + count(*) FILTER (c_custkey % 2 = 0) FROM customer) AS n_rejects""",
    "one_layer_counts": """
        SELECT 'silver_orders' AS table_name, count(*) AS n_rows FROM m_orders
        UNION ALL SELECT 'silver_sellers', count(*) FROM m_sellers
        UNION ALL SELECT 'gold_supplier_risk', count(*) FROM m_risk""",
    "declared_sources": """
        SELECT 'sellers' AS table_name, count(*) AS n_rows FROM b_sellers
        UNION ALL SELECT 'orders' AS table_name, count(*) AS n_rows FROM b_orders
        UNION ALL SELECT 'order_items' AS table_name, count(*) AS n_rows FROM b_items
        UNION ALL SELECT 'order_reviews' AS table_name, count(*) AS n_rows FROM b_reviews
        UNION ALL SELECT 'customers', -1
        UNION ALL SELECT 'geolocation', -1
        UNION ALL SELECT 'order_payments', -1
        UNION ALL SELECT 'products', -1
        UNION ALL SELECT 'product_category_name_translation', -1
        UNION ALL SELECT 'comtrade_trade_flows', -1
        UNION ALL SELECT 'world_bank_lpi', -1""",
    "layer_row_counts": """
        SELECT 'sellers' AS table_name, count(*) AS n_rows FROM b_sellers
        UNION ALL SELECT 'orders', count(*) FROM b_orders
        UNION ALL SELECT 'order_items', count(*) FROM b_items
        UNION ALL SELECT 'order_reviews', count(*) FROM b_reviews
        UNION ALL SELECT 'silver_orders', count(*) FROM m_orders
        UNION ALL SELECT 'silver_sellers', count(*) FROM m_sellers
        UNION ALL SELECT 'gold_supplier_performance', count(*) FROM m_performance
        UNION ALL SELECT 'gold_supplier_risk', count(*) FROM m_risk
        UNION ALL SELECT 'gold_concentration_risk', count(*) FROM m_concentration
        UNION ALL SELECT 'gold_executive_summary', count(*) FROM m_summary""",
    "build_if_absent": """
        SELECT 1::BIGINT AS attempt, 6::BIGINT AS n_tables,
               (SELECT count(*) FROM m_orders) + (SELECT count(*) FROM m_sellers)
               + (SELECT count(*) FROM m_performance) + (SELECT count(*) FROM m_risk)
               + (SELECT count(*) FROM m_concentration) + (SELECT count(*) FROM m_summary) AS n_rows
        UNION ALL SELECT 2, 0, 0""",
}


def oracle(name: str) -> str:
    body = FINAL[name]
    ctes = ",\n".join(f"{cte} AS ({sql})" for cte, sql in RELATIONS.items())
    return f"WITH {ctes}\nSELECT * FROM ({body})"


ORACLES = {name: oracle(name) for name in FINAL}
