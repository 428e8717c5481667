"""The same queries as independent SQL for DuckDB.

``_CTES`` defines the feeds and tables in plain SQL; ``_SELECTS`` holds one statement per
query.  ``ORACLE`` prefixes each statement with the definitions it needs.
"""

import re

from stockmill import rules
from stockmill.sources import literals


def _quote(value):
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def _values(rows):
    return ", ".join("(" + ", ".join(_quote(v) for v in row) + ")" for row in rows)


def _keep_one(source, keys, rest):
    """One row per key, the smallest by the other columns with NULLs first."""
    order = ", ".join(f"{c} NULLS FIRST" for c in rest)
    return (f"SELECT * FROM {source} QUALIFY row_number() OVER "
            f"(PARTITION BY {', '.join(keys)} ORDER BY {order}) = 1")


_ORDER_REST = ["item_id", "supplier_id", "order_qty", "unit_price", "order_amount",
               "order_date", "expected_delivery_date", "status"]
_RECEIPT_REST = ["order_id", "item_id", "supplier_id", "receipt_qty", "receipt_date",
                 "lead_time_actual_days", "quality_status"]
_STOCK_KEY = ["item_id", "location_id", "snapshot_date"]
_STOCK_REST = ["inventory_qty", "inventory_value"]


def _draw(salt, *keys):
    key = " || ':' || ".join([f"'{salt}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"


def _whole(salt, low, high, *keys):
    return f"({low} + {_draw(salt, *keys)} % ({high} - {low} + 1))"


def _uniform(salt, low, high, *keys):
    low, high = f"CAST({low} AS DOUBLE)", f"CAST({high} AS DOUBLE)"
    return f"({low} + ({high} - {low}) * ({_draw(salt, *keys)} / CAST(1152921504606846976 AS DOUBLE)))"


_PROFILE_ROWS, _low = [], 0
for _p in rules.CATEGORY_PROFILES:
    _PROFILE_ROWS.append((*_p, _low))
    _low += _p[2]
_SLOW = [s for s in rules.SUPPLIERS if s[2] >= rules.LONG_LEAD_DAYS]


def _supplier(field):
    def pick(rows):
        listed = "[" + ", ".join(_quote(s[field]) for s in rows) + "]"
        return f"({listed})[{_draw('supplier', 'item_seq')} % {len(rows)} + 1]"

    return (f"CASE WHEN category = '{rules.GROWTH_CATEGORY}' THEN {pick(_SLOW)} "
            f"ELSE {pick(rules.SUPPLIERS)} END")


_PLACES = "list_sort([" + ", ".join(
    f"{{'o': {_draw(f'place{i}', 'item_seq', 'm')}, 'w': '{w}'}}"
    for i, w in enumerate(rules.WAREHOUSES)) + "])"
_STOCK_SEED = ("item_seq", "m", "location_id")

_BASIS = """printf('在庫回転率 %.2f（基準値比 %s%d%%）、滞留日数 %d日（%s %s%d日）', turnover_rate,
    CASE WHEN round((turnover_rate - 1) * 100) >= 0 THEN '+' ELSE '' END,
    CAST(round((turnover_rate - 1) * 100) AS BIGINT), days_on_hand,
    CASE WHEN days_on_hand > 60 THEN '閾値超' ELSE '閾値未満' END,
    CASE WHEN days_on_hand >= 60 THEN '+' ELSE '' END, days_on_hand - 60)"""
_PRIORITY = """CASE WHEN turnover_rate < 1.0 AND days_on_hand > 60 THEN 'HIGH'
    WHEN turnover_rate BETWEEN 1.0 AND 1.5 AND days_on_hand BETWEEN 30 AND 60 THEN 'MEDIUM'
    ELSE 'LOW' END"""

_CTES = {
    "item_master": """
        SELECT p_partkey AS item_id, p_name AS item_name, p_type AS category,
               'type ' || p_type AS category_name, p_retailprice AS unit_price,
               p_partkey % (SELECT count(*) FROM supplier) AS primary_supplier_id,
               7 + (p_partkey % (SELECT count(*) FROM supplier)) % 39 AS lead_time_days,
               CAST(CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 21 ELSE 30 END
                    AS BIGINT) AS safety_stock_days,
               50 + (p_partkey * 7) % 451 AS reorder_point_qty,
               DATE '2025-01-01' AS created_at
        FROM part""",
    "order_lines": """
        SELECT l_orderkey * 10 + l_linenumber AS order_id, l_orderkey,
               l_orderkey + l_linenumber AS mixed, l_partkey AS item_id, l_suppkey AS supplier_id,
               CAST(l_quantity * 20 AS BIGINT) AS order_qty, p_retailprice AS unit_price,
               round(l_quantity * 20 * p_retailprice, 2) AS order_amount,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(7 + l_suppkey % 39 AS INT) AS promised_days,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'in_transit'
                    ELSE 'pending' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "raw_orders": """
        SELECT order_id, item_id, supplier_id, order_qty, unit_price, order_amount, order_date,
               order_date + promised_days AS expected_delivery_date, status
        FROM order_lines""",
    "landed_orders": """
        SELECT order_id, item_id, supplier_id,
               CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE order_qty END AS order_qty, unit_price,
               CASE WHEN l_orderkey % 83 = 0 THEN -order_amount ELSE order_amount END
                   AS order_amount,
               CASE WHEN l_orderkey % 89 <> 0 THEN order_date END AS order_date,
               order_date + promised_days AS expected_delivery_date, status
        FROM order_lines""",
    "raw_receipts": """
        SELECT order_id AS receipt_id, order_id, item_id, supplier_id,
               CAST(trunc(order_qty * (95 + mixed % 11) / 100) AS BIGINT) AS receipt_qty,
               order_date + CAST(promised_days + mixed % 10 - 2 AS INT) AS receipt_date,
               promised_days + mixed % 10 - 2 AS lead_time_actual_days,
               CASE WHEN l_orderkey % 5 = 0 THEN 'inspection_required' ELSE 'passed' END
                   AS quality_status
        FROM order_lines WHERE status = 'delivered'""",
    "raw_inventory": """
        SELECT item_id, location_id, inventory_qty,
               round(inventory_qty * p_retailprice, 2) AS inventory_value, snapshot_date
        FROM (SELECT l_partkey AS item_id, n_regionkey AS location_id,
                     CAST(sum(l_quantity) * 20 AS BIGINT) AS inventory_qty,
                     last_day(l_shipdate) AS snapshot_date
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey
              GROUP BY l_partkey, n_regionkey, last_day(l_shipdate))
        JOIN part ON item_id = p_partkey""",
    "raw_demand": """
        SELECT item_id, month, f AS forecast_qty, a AS actual_qty, f - a AS gap_qty,
               round((f - a) / CAST(greatest(a, 1) AS DOUBLE) * 100, 1) AS gap_rate_pct
        FROM (SELECT l_partkey AS item_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
                     CAST(20 * sum(l_quantity) AS BIGINT) AS f,
                     CAST(20 * sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)
                          AS BIGINT) AS a
              FROM lineitem GROUP BY 1, 2)""",
    "held": """
        SELECT l_partkey AS item_id, n_regionkey AS location,
               CAST(20 * sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT)
                   AS current_stock,
               CAST(20 * sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT)
                   AS required_qty
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "positions": """
        SELECT item_id, item_name, location, current_stock, required_qty, lead_time_days,
               CASE WHEN current_stock < required_qty THEN '不足'
                    WHEN current_stock > 2 * required_qty THEN '過剰' ELSE '適正' END AS status,
               category, category_name
        FROM held JOIN item_master USING (item_id)""",
    "shortage_rows": f"""
        SELECT * FROM (VALUES {_values(literals.SHORTAGE_ROWS)})
        AS v(item_id, item_name, location, current_stock, required_qty, lead_time_days, status,
             category, category_name)""",
    "all_positions": """
        SELECT CAST(item_id AS VARCHAR) AS item_id, item_name,
               CAST(location AS VARCHAR) AS location, current_stock, required_qty,
               lead_time_days, status, category, category_name, 'pipeline' AS source
        FROM positions
        UNION ALL
        SELECT item_id, item_name, location, current_stock, required_qty, lead_time_days, status,
               category, category_name, 'manual' FROM shortage_rows""",
    "orders_clean": _keep_one("raw_orders", ["order_id"], _ORDER_REST),
    "orders_gated": """
        SELECT * FROM landed_orders WHERE order_qty > 0 AND order_amount > 0""",
    "orders_silver": _keep_one("orders_gated", ["order_id"], _ORDER_REST),
    "inventory": _keep_one("raw_inventory", _STOCK_KEY, _STOCK_REST)
                 .replace("QUALIFY", "WHERE inventory_qty >= 0 AND inventory_value >= 0 QUALIFY"),
    "receipts": _keep_one("raw_receipts", ["receipt_id"], _RECEIPT_REST)
                .replace("QUALIFY", "WHERE receipt_qty > 0 QUALIFY"),
    "monthly": """
        SELECT item_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS month,
               avg(inventory_qty) AS avg_inventory_qty, avg(inventory_value) AS avg_inventory_value,
               max(inventory_qty) AS max_inventory_qty, min(inventory_qty) AS min_inventory_qty
        FROM inventory GROUP BY 1, 2""",
    "summary": """
        SELECT m.*, item_name, category, category_name, unit_price,
               round(12.0 / (avg_inventory_qty / 100 + 1), 2) AS turnover_rate,
               CAST(trunc(avg_inventory_qty / 10) AS BIGINT) AS days_on_hand
        FROM monthly m JOIN item_master USING (item_id)""",
    "analysis": """
        SELECT category, category_name, month, avg(turnover_rate) AS avg_turnover_rate,
               sum(avg_inventory_value) AS total_inventory_value,
               count(DISTINCT item_id) AS item_count, avg(days_on_hand) AS avg_days_on_hand
        FROM summary GROUP BY 1, 2, 3""",
    "alerts": """
        SELECT item_id, item_name, category, category_name, month, avg_inventory_qty,
               avg_inventory_value, turnover_rate, days_on_hand
        FROM summary WHERE turnover_rate < 4.0""",
    "overstock_rows": f"""
        SELECT item_id, item_name, category, category_name, DATE '2026-02-01' AS month,
               CAST(qty AS DOUBLE) AS avg_inventory_qty,
               CAST(value AS DOUBLE) AS avg_inventory_value,
               CAST(price AS DOUBLE) AS unit_price, turnover_rate,
               CAST(days AS BIGINT) AS days_on_hand, recommended_action
        FROM (VALUES {_values(literals.OVERSTOCK_ROWS)})
        AS v(item_id, item_name, category, category_name, qty, value, price, turnover_rate, days,
             recommended_action)""",
    "overstock": """
        SELECT CAST(item_id AS VARCHAR) AS item_id, item_name, category, category_name, month,
               avg_inventory_qty, avg_inventory_value, turnover_rate, days_on_hand,
               'pipeline' AS source, CAST(NULL AS DOUBLE) AS unit_price,
               CAST(NULL AS VARCHAR) AS recommended_action FROM alerts
        UNION ALL
        SELECT item_id, item_name, category, category_name, month, avg_inventory_qty,
               avg_inventory_value, turnover_rate, days_on_hand, 'manual', unit_price,
               recommended_action FROM overstock_rows""",
    "newest_summary": """
        SELECT * FROM summary WHERE month = (SELECT max(month) FROM summary)""",
    "top_suppliers": """
        SELECT supplier_id, avg(lead_time_actual_days) AS avg_lead_time FROM receipts
        GROUP BY supplier_id ORDER BY avg_lead_time DESC, supplier_id LIMIT 15""",
    "safety": """
        SELECT item_id, safety_stock_days * avg_actual / 30 AS safety_stock_qty
        FROM item_master JOIN (SELECT item_id, avg(actual_qty) AS avg_actual FROM raw_demand
                               GROUP BY item_id) USING (item_id)""",
    "shorts": """
        SELECT *, required_qty - current_stock AS shortage_qty,
               CAST(sum(required_qty - current_stock)
                    OVER (PARTITION BY item_id ORDER BY location) AS BIGINT) AS hi
        FROM positions WHERE current_stock < required_qty""",
    "surpluses": """
        SELECT item_id, location, current_stock - required_qty AS surplus_qty,
               CAST(sum(current_stock - required_qty) OVER
                    (PARTITION BY item_id ORDER BY current_stock - required_qty DESC, location
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi
        FROM positions WHERE current_stock > required_qty""",
    "transfers": """
        SELECT s.item_id, s.item_name, u.location AS source_location,
               s.location AS target_location,
               least(s.hi, u.hi) - greatest(s.hi - s.shortage_qty, u.hi - u.surplus_qty)
                   AS transfer_qty,
               u.hi - least(s.hi, u.hi) AS source_left, s.hi - least(s.hi, u.hi) AS target_left,
               s.shortage_qty, s.lead_time_days
        FROM shorts s JOIN surpluses u ON s.item_id = u.item_id
         AND s.hi - s.shortage_qty < u.hi AND u.hi - u.surplus_qty < s.hi""",
    "uncovered": """
        SELECT s.item_id, s.item_name, s.location, s.current_stock, s.required_qty,
               s.lead_time_days, coalesce(moved, 0) AS covered_qty,
               s.shortage_qty - coalesce(moved, 0) AS order_qty
        FROM shorts s LEFT JOIN (
            SELECT item_id, target_location, CAST(sum(transfer_qty) AS BIGINT) AS moved
            FROM transfers GROUP BY 1, 2) t
          ON s.item_id = t.item_id AND s.location = t.target_location
        WHERE s.shortage_qty > coalesce(moved, 0)""",
    "proposals": f"""
        SELECT sha256(CAST(item_id AS VARCHAR) || '|' || strftime(month, '%Y-%m-%d'))
                   AS proposal_id,
               item_id, item_name, category, current_stock,
               greatest(required_qty - current_stock, reorder_point_qty) AS recommended_order_qty,
               CASE WHEN emergency THEN '現在庫が安全在庫水準を大幅に下回る'
                    WHEN required_qty > current_stock THEN '必要量に対し在庫が不足'
                    ELSE '在庫回転率が基準値を下回る' END || ' [' || {_BASIS} || ']' AS reason,
               CASE WHEN emergency THEN 'HIGH' ELSE priority END AS priority,
               'PENDING' AS status, 'ai-agent' AS created_by
        FROM (SELECT *, current_stock <= safety_stock_qty * 0.2 AS emergency,
                     {_PRIORITY} AS priority
              FROM item_master
              JOIN (SELECT item_id, month, turnover_rate, days_on_hand FROM summary
                    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY month DESC) = 1)
                  USING (item_id)
              JOIN (SELECT item_id, CAST(sum(current_stock) AS BIGINT) AS current_stock,
                           CAST(sum(required_qty) AS BIGINT) AS required_qty
                    FROM positions GROUP BY item_id) USING (item_id)
              JOIN safety USING (item_id))
        WHERE required_qty > current_stock OR emergency OR priority <> 'LOW'""",
    "profiles": f"""
        SELECT * FROM (VALUES {_values(_PROFILE_ROWS)})
        AS v(category, name, items, price_low, price_high, lot_low, lot_high, stock_low,
             stock_high, noise_low, noise_high, forecast_low, forecast_high, actual_low,
             actual_high, first_place)""",
    "made_items": f"""
        SELECT item_seq, printf('ITM-%04d', item_seq + 1) AS item_id,
               name || '_' || chr(CAST(65 + (place // 26) % 26 AS INT))
                    || printf('%02d', place % 26 + 1) AS item_name,
               category, name AS category_name,
               {_whole('price', 'price_low', 'price_high', 'item_seq')} AS unit_price,
               {_supplier(0)} AS primary_supplier_id,
               CAST({_supplier(2)} AS BIGINT) AS lead_time_days,
               CAST(([7, 14, 21, 30])[{_draw('safety', 'item_seq')} % 4 + 1] AS BIGINT)
                   AS safety_stock_days,
               {_whole('reorder', 50, 500, 'item_seq')} AS reorder_point_qty,
               DATE '2025-03-01' - CAST({_whole('created', 30, 365, 'item_seq')} AS INT)
                   AS created_at
        FROM (SELECT p_partkey AS item_seq, p_partkey % 500 - first_place AS place, p.*
              FROM part JOIN profiles p
                ON p_partkey % 500 >= first_place AND p_partkey % 500 < first_place + items)""",
    "made_orders": f"""
        SELECT printf('ORD-%06d', order_seq + 1) AS order_id, item_id,
               primary_supplier_id AS supplier_id, order_qty, unit_price,
               order_qty * unit_price AS order_amount, order_date,
               order_date + CAST(lead_time_days AS INT) AS expected_delivery_date, status
        FROM (SELECT o.*, i.*, {_whole('lot', 'lot_low', 'lot_high', 'order_seq')} AS order_qty
              FROM (SELECT o_orderkey AS order_seq,
                           {_draw('item', 'o_orderkey')} % (SELECT count(*) FROM part)
                               AS picked_seq,
                           DATE '2025-03-01' + CAST({_draw('day', 'o_orderkey')} % 365 AS INT)
                               AS order_date,
                           (['delivered', 'delivered', 'delivered', 'in_transit', 'pending'])
                               [{_draw('status', 'o_orderkey')} % 5 + 1] AS status
                    FROM orders) o
              JOIN made_items i ON i.item_seq = o.picked_seq
              JOIN profiles USING (category))""",
    "made_months": """SELECT *, CAST(unnest(range(12)) AS INT) AS m FROM made_items""",
}

_DETAIL = ("item_id, item_name, category, round(avg_inventory_qty, 2) AS avg_inventory_qty, "
           "round(avg_inventory_value, 2) AS avg_inventory_value, turnover_rate, days_on_hand")
_ROUNDED = "REPLACE (round(avg_inventory_qty, 2) AS avg_inventory_qty, " \
           "round(avg_inventory_value, 2) AS avg_inventory_value)"
_STOCK_TEXT = """CAST(item_id AS VARCHAR) AS item_id, CAST(location_id AS VARCHAR) AS location_id,
    inventory_qty, inventory_value, snapshot_date"""

_SELECTS = {
    # sources
    "ingest_orders_stream": """
        SELECT * REPLACE (CAST(order_id AS VARCHAR) AS order_id, CAST(item_id AS VARCHAR) AS item_id,
                          CAST(supplier_id AS VARCHAR) AS supplier_id) FROM landed_orders""",
    "ingest_inventory_stream": f"SELECT {_STOCK_TEXT} FROM raw_inventory",
    "ingest_receipts_stream": """
        SELECT * REPLACE (CAST(receipt_id AS VARCHAR) AS receipt_id,
                          CAST(order_id AS VARCHAR) AS order_id, CAST(item_id AS VARCHAR) AS item_id,
                          CAST(supplier_id AS VARCHAR) AS supplier_id) FROM raw_receipts""",
    "ingest_demand_stream": """
        SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM raw_demand""",
    "ingest_item_master": """
        SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id,
                          CAST(primary_supplier_id AS VARCHAR) AS primary_supplier_id)
        FROM item_master""",
    "read_literal_rows": """
        SELECT table_name, source, count(*) AS row_count, round(sum(qty), 2) AS total_qty,
               CAST(sum(days) AS BIGINT) AS total_days
        FROM (SELECT 'overstock' AS table_name, source, avg_inventory_qty AS qty,
                     days_on_hand AS days FROM overstock
              UNION ALL
              SELECT 'shortage', source, CAST(current_stock AS DOUBLE), lead_time_days
              FROM all_positions)
        GROUP BY 1, 2""",
    # sinks
    "write_streaming_table": """
        SELECT 'bronze' AS layer, count(*) AS row_count, count(DISTINCT receipt_id) AS key_count
        FROM raw_receipts
        UNION ALL SELECT 'silver', count(*), count(DISTINCT receipt_id) FROM receipts""",
    "write_materialized_view": """
        SELECT 'inventory_summary' AS table_name, count(*) AS row_count,
               round(sum(avg_inventory_value), 2) AS total_value FROM summary
        UNION ALL SELECT 'turnover_analysis', count(*), round(sum(total_inventory_value), 2)
        FROM analysis
        UNION ALL SELECT 'overstock_alert', count(*), round(sum(avg_inventory_value), 2)
        FROM alerts""",
    "create_or_replace_typed_table": f"SELECT * EXCLUDE (source) {_ROUNDED} FROM overstock",
    "append_order_proposals": """
        SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM proposals""",
    "export_csv": "SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM raw_demand",
    # quality
    "expect_warn": """
        SELECT 'orders' AS dataset, 'valid_date' AS expectation, 'warn' AS severity,
               count(*) AS total_rows, count(*) FILTER (order_date IS NULL) AS violations
        FROM landed_orders
        UNION ALL SELECT 'inventory', 'has_item', 'warn', count(*),
               count(*) FILTER (item_id IS NULL) FROM raw_inventory
        UNION ALL SELECT 'overstock_alert', 'has_alert_items', 'warn', count(*),
               count(*) FILTER (NOT turnover_rate < 4.0) FROM alerts""",
    "expect_or_drop": "SELECT * FROM orders_gated",
    "expect_or_fail": "SELECT * FROM raw_receipts WHERE receipt_id IS NOT NULL",
    "quality_pass_rate": """
        SELECT dataset, count(*) AS total_rows, count(*) FILTER (ok) AS passed_rows,
               round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100, 2) AS pass_rate_pct
        FROM (SELECT 'orders' AS dataset, coalesce(order_id IS NOT NULL AND order_qty > 0
                     AND order_amount > 0 AND order_date IS NOT NULL, FALSE) AS ok
              FROM landed_orders
              UNION ALL SELECT 'inventory', coalesce(inventory_qty >= 0 AND inventory_value >= 0
                     AND item_id IS NOT NULL, FALSE) FROM raw_inventory
              UNION ALL SELECT 'receipts', coalesce(receipt_id IS NOT NULL AND receipt_qty > 0,
                     FALSE) FROM raw_receipts)
        GROUP BY dataset""",
    "layer_row_counts": """
        SELECT layer, count(*) AS table_count, CAST(sum(n) AS BIGINT) AS row_count
        FROM (SELECT 'bronze' AS layer, count(*) AS n FROM landed_orders
              UNION ALL SELECT 'bronze', count(*) FROM raw_inventory
              UNION ALL SELECT 'bronze', count(*) FROM raw_receipts
              UNION ALL SELECT 'bronze', count(*) FROM raw_demand
              UNION ALL SELECT 'bronze', count(*) FROM item_master
              UNION ALL SELECT 'silver', count(*) FROM orders_silver
              UNION ALL SELECT 'silver', count(*) FROM inventory
              UNION ALL SELECT 'silver', count(*) FROM receipts
              UNION ALL SELECT 'gold', count(*) FROM summary
              UNION ALL SELECT 'gold', count(*) FROM analysis
              UNION ALL SELECT 'gold', count(*) FROM alerts)
        GROUP BY layer""",
    # silver, projections, filters
    "silver_orders": "SELECT * FROM orders_silver",
    "silver_inventory": "SELECT * FROM inventory",
    "silver_receipts": "SELECT * FROM receipts",
    "month_key": """
        SELECT item_id, location_id, snapshot_date,
               CAST(date_trunc('month', snapshot_date) AS DATE) AS month FROM inventory""",
    "turnover_rate": """
        SELECT item_id, month, round(avg_inventory_qty, 4) AS avg_inventory_qty,
               round(12.0 / (avg_inventory_qty / 100 + 1), 2) AS turnover_rate FROM monthly""",
    "days_on_hand": """
        SELECT item_id, month, round(avg_inventory_qty, 4) AS avg_inventory_qty,
               CAST(trunc(avg_inventory_qty / 10) AS BIGINT) AS days_on_hand FROM monthly""",
    "project_item_columns": """
        SELECT item_id, item_name, category, category_name, unit_price FROM item_master""",
    "order_amount": """
        SELECT order_id, item_id, order_qty, unit_price,
               round(order_qty * unit_price, 2) AS order_amount FROM raw_orders""",
    "inventory_value": """
        SELECT item_id, location_id, snapshot_date,
               round(inventory_qty * p_retailprice, 2) AS inventory_value
        FROM raw_inventory JOIN part ON item_id = p_partkey""",
    "expected_delivery_date": """
        SELECT order_id, item_id, order_date, lead_time_days,
               order_date + CAST(lead_time_days AS INT) AS expected_delivery_date
        FROM raw_orders JOIN item_master USING (item_id)""",
    "expected_delivery_spread": """
        SELECT order_id, item_id, order_date, lead_time_days,
               order_date + CAST(lead_time_days AS INT) AS expected_delivery_date
        FROM raw_orders JOIN item_master USING (item_id)""",
    "lead_time_actual_days": """
        SELECT receipt_id, order_date, receipt_date,
               date_diff('day', order_date, receipt_date) AS lead_time_actual_days
        FROM receipts JOIN (SELECT order_id, order_date FROM orders_clean) USING (order_id)""",
    "receipt_delay": """
        SELECT receipt_id, order_id, r.item_id, r.supplier_id,
               date_diff('day', expected_delivery_date, receipt_date) AS delay_days,
               round(receipt_qty / CAST(order_qty AS DOUBLE), 10) AS fill_rate
        FROM receipts r JOIN orders_clean o USING (order_id)""",
    "demand_gap": """
        SELECT item_id, month, forecast_qty, actual_qty, forecast_qty - actual_qty AS gap_qty,
               round((forecast_qty - actual_qty) / CAST(greatest(actual_qty, 1) AS DOUBLE) * 100, 1)
                   AS gap_rate_pct FROM raw_demand""",
    "net_position": """
        SELECT item_id, location, current_stock, required_qty,
               current_stock - required_qty AS net_position FROM positions""",
    "format_money": """
        SELECT item_id, location_id, snapshot_date,
               format('{:,}', CAST(inventory_value AS BIGINT)) AS value_text FROM inventory""",
    "parse_number_text": """
        SELECT '¥' || format('{:,}', CAST(inventory_value AS BIGINT)) AS cell,
               inventory_value AS number_value, CAST(NULL AS VARCHAR) AS text_value FROM inventory
        UNION ALL
        SELECT CAST(CAST(gap_rate_pct AS DECIMAL(18, 1)) AS VARCHAR) || '％', gap_rate_pct, NULL
        FROM raw_demand
        UNION ALL SELECT item_name, NULL, item_name FROM item_master""",
    "overstock_alert": f"SELECT * {_ROUNDED} FROM alerts",
    "latest_month_filter": f"SELECT * {_ROUNDED} FROM newest_summary",
    "newest_month_stored": f"SELECT * {_ROUNDED} FROM newest_summary",
    "ingest_new_columns": """
        SELECT CAST(receipt_id AS VARCHAR) AS receipt_id, receipt_qty, lead_time_actual_days,
               CASE WHEN lead_time_actual_days % 2 = 1
                    THEN 'dock ' || (lead_time_actual_days % 9) END AS dock
        FROM raw_receipts""",
    "versioned_tables": """
        SELECT table_name, column_name, data_type, comment, layer, CAST(2 AS BIGINT) AS version,
               CASE table_name WHEN 'overstock_entries' THEN (SELECT count(*) FROM overstock)
                    ELSE (SELECT count(*) FROM summary) END AS row_count
        FROM (VALUES
          ('overstock_entries', 'manual', 'item_id', 'string', 'item key'),
          ('overstock_entries', 'manual', 'item_name', 'string', 'item name'),
          ('overstock_entries', 'manual', 'category', 'string', 'category code'),
          ('overstock_entries', 'manual', 'category_name', 'string', 'category name'),
          ('overstock_entries', 'manual', 'month', 'date', 'snapshot month'),
          ('overstock_entries', 'manual', 'avg_inventory_qty', 'double', 'average stock quantity'),
          ('overstock_entries', 'manual', 'avg_inventory_value', 'double', 'average stock value'),
          ('overstock_entries', 'manual', 'unit_price', 'double', 'price per unit'),
          ('overstock_entries', 'manual', 'turnover_rate', 'double', 'stock turnover'),
          ('overstock_entries', 'manual', 'days_on_hand', 'bigint', 'average days on hand'),
          ('overstock_entries', 'manual', 'recommended_action', 'string', 'recommended action'),
          ('inventory_summary', 'gold', 'item_id', 'bigint', NULL),
          ('inventory_summary', 'gold', 'month', 'date', NULL),
          ('inventory_summary', 'gold', 'avg_inventory_qty', 'double', NULL),
          ('inventory_summary', 'gold', 'avg_inventory_value', 'double', NULL),
          ('inventory_summary', 'gold', 'max_inventory_qty', 'bigint', NULL),
          ('inventory_summary', 'gold', 'min_inventory_qty', 'bigint', NULL),
          ('inventory_summary', 'gold', 'item_name', 'string', NULL),
          ('inventory_summary', 'gold', 'category', 'string', NULL),
          ('inventory_summary', 'gold', 'category_name', 'string', NULL),
          ('inventory_summary', 'gold', 'unit_price', 'double', NULL),
          ('inventory_summary', 'gold', 'turnover_rate', 'double', NULL),
          ('inventory_summary', 'gold', 'days_on_hand', 'bigint', NULL)
        ) AS v(table_name, layer, column_name, data_type, comment)""",
    "distinct_item_rollup": """
        SELECT 'month' AS scope, month, CAST(NULL AS VARCHAR) AS category,
               count(DISTINCT item_id) AS item_count,
               round(sum(avg_inventory_value), 2) AS total_value FROM summary GROUP BY month
        UNION ALL SELECT 'category', NULL, category, count(DISTINCT item_id),
               round(sum(avg_inventory_value), 2) FROM summary GROUP BY category
        UNION ALL SELECT 'month and category', month, category, count(DISTINCT item_id),
               round(sum(avg_inventory_value), 2) FROM summary GROUP BY month, category
        UNION ALL SELECT 'long held', NULL, NULL, count(DISTINCT item_id),
               round(sum(avg_inventory_value), 2) FROM alerts WHERE days_on_hand >= 90""",
    # duplicates
    "dedupe_orders": "SELECT * FROM orders_clean",
    "dedupe_inventory": "SELECT DISTINCT * FROM raw_inventory",
    "dedupe_receipts": _keep_one("raw_receipts", ["receipt_id"], _RECEIPT_REST),
    # joins
    "inventory_summary": f"SELECT * {_ROUNDED} FROM summary",
    "latest_stock_by_category": """
        SELECT category, category_name, CAST(sum(inventory_qty) AS BIGINT) AS total_qty,
               round(sum(inventory_value), 2) AS total_value,
               count(DISTINCT item_id) AS item_count
        FROM inventory JOIN item_master USING (item_id)
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory) GROUP BY 1, 2""",
    "forecast_gap_by_category": """
        SELECT category, category_name, round(avg(gap_rate_pct), 2) AS avg_gap_rate_pct
        FROM raw_demand JOIN item_master USING (item_id) GROUP BY 1, 2""",
    "receipts_from_orders": """
        SELECT r.*, order_qty, order_date, expected_delivery_date, status
        FROM receipts r JOIN orders_clean o USING (order_id)""",
    "supplier_leadtime_named": """
        SELECT supplier_id, s_name AS supplier_name,
               round(avg(lead_time_actual_days), 10) AS avg_lead_time
        FROM receipts JOIN supplier ON supplier_id = s_suppkey GROUP BY 1, 2""",
    "demand_gap_with_value": """
        SELECT item_id, month, category, forecast_qty, actual_qty, gap_rate_pct,
               round(avg_inventory_value, 2) AS inventory_value
        FROM raw_demand JOIN summary USING (item_id, month)""",
    "colocated_summary": f"SELECT * {_ROUNDED} FROM summary",
    "colocated_item_turnover": """
        SELECT item_id, item_name, category, count(*) AS month_count,
               round(avg(turnover_rate), 8) AS avg_turnover_rate,
               round(avg(avg_inventory_value), 2) AS avg_inventory_value
        FROM summary GROUP BY 1, 2, 3""",
    "colocated_demand_gap": """
        SELECT item_id, month, category, forecast_qty, actual_qty, gap_rate_pct,
               round(avg_inventory_value, 2) AS inventory_value
        FROM raw_demand JOIN summary USING (item_id, month)""",
    "surplus_candidates": """
        SELECT s.item_id, s.location AS short_location, s.shortage_qty,
               count(*) AS surplus_locations, CAST(sum(u.surplus_qty) AS BIGINT) AS surplus_qty,
               arg_min(u.location, u.hi) AS best_location,
               max(u.surplus_qty) AS best_surplus_qty
        FROM shorts s JOIN surpluses u ON s.item_id = u.item_id AND s.location <> u.location
        GROUP BY 1, 2, 3""",
    # aggregations
    "monthly_item_stock": f"SELECT * {_ROUNDED} FROM monthly",
    "turnover_analysis": """
        SELECT * REPLACE (round(avg_turnover_rate, 10) AS avg_turnover_rate,
                          round(total_inventory_value, 2) AS total_inventory_value,
                          round(avg_days_on_hand, 10) AS avg_days_on_hand) FROM analysis""",
    "inventory_kpi": """
        SELECT round(sum(avg_inventory_value), 2) AS total_value,
               count(DISTINCT item_id) AS total_items FROM newest_summary""",
    "turnover_kpi": "SELECT round(avg(avg_turnover_rate), 8) AS avg_turnover FROM analysis",
    "overstock_kpi": """
        SELECT count(DISTINCT item_id) AS overstock_count FROM alerts WHERE days_on_hand >= 90""",
    "inventory_trend": """
        SELECT month, category, round(sum(avg_inventory_value), 2) AS avg_inventory_value
        FROM summary GROUP BY 1, 2""",
    "category_breakdown": """
        SELECT category, round(sum(avg_inventory_value), 2) AS total_value,
               count(DISTINCT item_id) AS item_count FROM newest_summary GROUP BY 1""",
    "overstock_category_summary": """
        SELECT category_name, count(*) AS item_rows,
               round(sum(avg_inventory_value), 2) AS total_value,
               round(avg(turnover_rate), 2) AS avg_turnover,
               round(avg(days_on_hand), 0) AS avg_days FROM overstock GROUP BY 1""",
    "widget_inventory_trend": """
        SELECT CAST(date_trunc('month', month) AS DATE) AS month, category,
               round(sum(avg_inventory_value), 2) AS sum_inventory_value
        FROM summary GROUP BY 1, 2""",
    "widget_turnover_trend": """
        SELECT CAST(date_trunc('month', month) AS DATE) AS month, category,
               round(avg(avg_turnover_rate), 10) AS avg_turnover_rate FROM analysis GROUP BY 1, 2""",
    "widget_category_value": """
        SELECT category, round(sum(avg_inventory_value), 2) AS sum_total_value
        FROM newest_summary GROUP BY 1""",
    "widget_supplier_leadtime": """
        SELECT supplier_id, round(avg(avg_lead_time), 10) AS avg_lead_time
        FROM top_suppliers GROUP BY 1""",
    "widget_counters": """
        SELECT (SELECT round(sum(avg_inventory_value), 2) FROM newest_summary) AS total_value,
               (SELECT round(avg(avg_turnover_rate), 8) FROM analysis) AS avg_turnover,
               (SELECT count(DISTINCT item_id) FROM alerts WHERE days_on_hand >= 90)
                   AS overstock_count""",
    "forecast_accuracy_by_category": """
        SELECT category, category_name, round(avg(forecast_qty), 2) AS avg_forecast_qty,
               round(avg(actual_qty), 2) AS avg_actual_qty,
               round((sum(forecast_qty) - sum(actual_qty)) * 100.0
                     / CAST(nullif(sum(actual_qty), 0) AS DOUBLE), 2) AS gap_rate_pct
        FROM raw_demand JOIN item_master USING (item_id) GROUP BY 1, 2""",
    "report_totals": f"""
        SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id), 'detail' AS row_kind
        FROM (SELECT {_DETAIL} FROM alerts)
        UNION ALL
        SELECT '合 計', NULL, '—', round(sum(avg_inventory_qty), 2),
               round(sum(avg_inventory_value), 2), round(sum(turnover_rate), 2),
               CAST(sum(days_on_hand) AS BIGINT), 'total' FROM alerts""",
    # shares and comparisons
    "category_share": """
        SELECT category, category_name, round(v, 2) AS total_value,
               round(v * 100 / sum(v) OVER (), 1) AS share_pct
        FROM (SELECT category, category_name, sum(avg_inventory_value) AS v
              FROM newest_summary GROUP BY 1, 2)""",
    "overstock_concentration": """
        SELECT a.category, count(DISTINCT a.item_id) AS item_count,
               round(count(DISTINCT a.item_id) * 100.0 / sum(count(DISTINCT a.item_id)) OVER (), 1)
                   AS item_share_pct,
               round(avg(a.days_on_hand), 10) AS avg_days,
               round((SELECT avg(b.days_on_hand) FROM alerts b WHERE b.category <> a.category), 10)
                   AS avg_days_rest
        FROM alerts a GROUP BY a.category""",
    "leadtime_vs_rest": """
        SELECT category, round(own, 10) AS avg_lead_time, round(rest, 10) AS avg_lead_time_rest,
               round(own / rest * 100 - 100, 8) AS diff_pct
        FROM (SELECT category, sum(days) / CAST(sum(n) AS DOUBLE) AS own,
                     (sum(sum(days)) OVER () - sum(days))
                         / CAST(sum(sum(n)) OVER () - sum(n) AS DOUBLE) AS rest
              FROM (SELECT category, lead_time_actual_days AS days, 1 AS n
                    FROM receipts JOIN item_master USING (item_id)) GROUP BY category)""",
    "month_over_month": """
        SELECT month, round(v, 2) AS total_value, round(p, 2) AS previous_value,
               round(v / p * 100 - 100, 2) AS change_pct
        FROM (SELECT a.month, a.v, b.v AS p
              FROM (SELECT month, sum(avg_inventory_value) AS v FROM summary GROUP BY month) a
              LEFT JOIN (SELECT month, sum(avg_inventory_value) AS v FROM summary
                         GROUP BY month) b ON b.month = a.month - INTERVAL 1 MONTH)""",
    "turnover_verdict": """
        SELECT *, CASE WHEN avg_turnover >= 1.5 THEN '良好' ELSE '要改善' END AS verdict
        FROM (SELECT category, category_name, round(avg(avg_turnover_rate), 2) AS avg_turnover
              FROM analysis GROUP BY 1, 2)""",
    # sorted reports
    "overstock_alerts": """
        SELECT item_id, item_name, category, turnover_rate, days_on_hand,
               round(avg_inventory_value, 2) AS avg_inventory_value
        FROM alerts WHERE days_on_hand >= 60
        ORDER BY days_on_hand DESC, item_id, month LIMIT 20""",
    "supplier_leadtime": """
        SELECT supplier_id, round(avg_lead_time, 10) AS avg_lead_time FROM top_suppliers""",
    "turnover_trend": """
        SELECT month, category, round(avg_turnover_rate, 10) AS avg_turnover_rate FROM analysis""",
    "overstock_listing": """
        SELECT item_id, item_name, category_name,
               format('{:,}', CAST(round_even(avg_inventory_value, 0) AS BIGINT))
                   AS inventory_value_text,
               turnover_rate, days_on_hand, recommended_action FROM overstock""",
    "shortage_listing": """
        SELECT item_id, item_name, location, current_stock, required_qty,
               current_stock - required_qty AS net_position, lead_time_days, status
        FROM all_positions""",
    "overstock_top10": """
        SELECT item_id, item_name, category, month, turnover_rate, days_on_hand FROM alerts
        ORDER BY turnover_rate, item_id, month LIMIT 10""",
    "all_overstock": f"SELECT * {_ROUNDED} FROM overstock",
    # action rules
    "proposal_priority": f"""
        SELECT item_id, month, turnover_rate, days_on_hand, {_PRIORITY} AS priority FROM summary""",
    "emergency_order_trigger": """
        SELECT item_id, location, current_stock, round(safety_stock_qty, 2) AS safety_stock_qty,
               round(current_stock * 100 / nullif(safety_stock_qty, 0), 2) AS stock_share_pct,
               'HIGH' AS priority
        FROM positions JOIN safety USING (item_id)
        WHERE current_stock <= safety_stock_qty * 0.2""",
    "forecast_review_flag": """
        SELECT item_id, month, forecast_qty, actual_qty, gap_rate_pct FROM raw_demand
        WHERE gap_rate_pct > 30""",
    "leadtime_feasibility": """
        SELECT item_id, location, lead_time_days, lead_time_days <= 7 AS feasible FROM positions""",
    "replenishment_choice": """
        SELECT s.item_id, s.location, s.shortage_qty, s.lead_time_days,
               coalesce(u.q, 0) AS surplus_qty,
               CASE WHEN s.lead_time_days > 7 OR u.q > 0 THEN 'transfer' ELSE 'order' END AS choice,
               u.q IS NOT NULL AS has_source
        FROM shorts s LEFT JOIN (SELECT item_id, CAST(sum(surplus_qty) AS BIGINT) AS q
                                 FROM surpluses GROUP BY 1) u ON s.item_id = u.item_id""",
    "transfer_plan": "SELECT * FROM transfers",
    "emergency_order_request": """
        SELECT *, printf('緊急手配: %s を %d個発注するための依頼書です。希望納期: %s。理由: %s', item_name,
                         order_qty, strftime(desired_delivery_date, '%Y/%m/%d'), reason) AS summary
        FROM (SELECT DATE '2025-01-01' AS request_date, item_id, item_name, order_qty,
                     DATE '2025-01-08' AS desired_delivery_date, location AS delivery_location,
                     CASE WHEN lead_time_days > 7 THEN '特急' ELSE '通常' END AS priority,
                     printf('必要量 %d個 に対し現在庫 %d個、転用 %d個 を差し引き %d個 不足', required_qty,
                            current_stock, covered_qty, order_qty) AS reason
              FROM uncovered)""",
    "transfer_request": """
        SELECT *, printf('[%d] から [%d] へ %s を %d個 転用するための依頼書です。理由: %s',
                         source_location, target_location, item_name, transfer_qty, reason)
                  AS summary
        FROM (SELECT DATE '2025-01-01' AS request_date, item_id, item_name, source_location,
                     target_location, transfer_qty, DATE '2025-01-08' AS desired_delivery_date,
                     printf('%d で %d個 の不足、サプライヤーリードタイム %d日', target_location,
                            shortage_qty, lead_time_days) AS reason
              FROM transfers)""",
    "order_proposals": "SELECT * FROM proposals",
    "stored_proposals": """
        SELECT * REPLACE (CAST(item_id AS VARCHAR) AS item_id) FROM proposals""",
    "stored_requests": """
        SELECT 'transfer' AS kind, CAST(item_id AS VARCHAR) AS item_id,
               CAST(source_location AS VARCHAR) AS source_location,
               CAST(target_location AS VARCHAR) AS target_location, transfer_qty AS qty,
               printf('[%d] から [%d] へ %s を %d個 転用するための依頼書です。理由: %d で %d個 の不足、サプライヤーリードタイム %d日',
                      source_location, target_location, item_name, transfer_qty,
                      target_location, shortage_qty, lead_time_days) AS summary
        FROM transfers
        UNION ALL
        SELECT 'order', CAST(item_id AS VARCHAR), NULL, CAST(location AS VARCHAR), order_qty,
               printf('緊急手配: %s を %d個発注するための依頼書です。希望納期: 2025/01/08。理由: 必要量 %d個 に対し現在庫 %d個、転用 %d個 を差し引き %d個 不足',
                      item_name, order_qty, required_qty, current_stock, covered_qty, order_qty)
        FROM uncovered""",
    "stored_overstock": f"SELECT * {_ROUNDED} FROM overstock",
    "quantitative_basis": f"""
        SELECT item_id, month, {_BASIS} AS quantitative_basis FROM summary""",
    "critical_flag": """
        SELECT item_id, month, turnover_rate, days_on_hand,
               turnover_rate < 1.5 OR days_on_hand >= 300 AS critical FROM summary""",
    "stock_status": """
        SELECT item_id, location, current_stock, required_qty,
               current_stock - required_qty AS net_position, status AS stock_status
        FROM positions""",
    # generated data
    "gen_item_master": "SELECT * FROM made_items",
    "gen_orders": "SELECT * FROM made_orders",
    "gen_inventory": f"""
        SELECT item_id, location_id, inventory_qty, inventory_qty * unit_price AS inventory_value,
               last_day(DATE '2025-03-01' + to_months(m)) AS snapshot_date
        FROM (SELECT *, CAST(trunc({_whole('base', 'stock_low', 'stock_high', *_STOCK_SEED)}
                     * CASE WHEN category = 'B' THEN 1 + m * CAST(0.05 AS DOUBLE) ELSE 1 END
                     * {_uniform('noise', 'noise_low', 'noise_high', *_STOCK_SEED)}) AS BIGINT)
                     AS inventory_qty
              FROM (SELECT *, unnest(list_transform({_PLACES}[1:
                           {_whole('places', 1, 4, 'item_seq', 'm')}], lambda x: x.w)) AS location_id
                    FROM made_months
                    WHERE {_uniform('stocked', 0.0, 1.0, 'item_seq', 'm')} < CAST(0.7 AS DOUBLE))
              JOIN profiles USING (category))""",
    "gen_receipts": f"""
        SELECT *, date_diff('day', order_date_, receipt_date) AS lead_time_actual_days,
               CASE WHEN {_draw('check', 'order_id')} % 5 = 4 THEN 'inspection_required'
                    ELSE 'passed' END AS quality_status
        FROM (SELECT 'RCV' || substr(order_id, 4) AS receipt_id, order_id, item_id, supplier_id,
                     CAST(trunc(order_qty * {_uniform('received', 0.95, 1.05, 'order_id')})
                          AS BIGINT) AS receipt_qty,
                     expected_delivery_date + CAST({_whole('delay', -2, 7, 'order_id')} AS INT)
                         AS receipt_date, order_date AS order_date_
              FROM made_orders WHERE status = 'delivered')""".replace(
                  "SELECT *, date_diff", "SELECT * EXCLUDE (order_date_), date_diff"),
    "gen_demand": f"""
        SELECT *, forecast_qty - actual_qty AS gap_qty,
               round((forecast_qty - actual_qty) / CAST(greatest(actual_qty, 1) AS DOUBLE) * 100, 1)
                   AS gap_rate_pct
        FROM (SELECT item_id, CAST(DATE '2025-03-01' + to_months(m) AS DATE) AS month,
                     CAST(trunc(base * {_uniform('forecast', 'forecast_low', 'forecast_high',
                                                 'item_seq', 'm')}) AS BIGINT) AS forecast_qty,
                     CAST(trunc(base * {_uniform('actual', 'actual_low', 'actual_high',
                                                 'item_seq', 'm')}) AS BIGINT) AS actual_qty
              FROM (SELECT *, {_whole('demand', 50, 500, 'item_seq', 'm')} AS base
                    FROM made_months JOIN profiles USING (category)
                    WHERE {_uniform('tracked', 0.0, 1.0, 'item_seq')} < CAST(0.84 AS DOUBLE)))""",
    "sample_n": f"""
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        ORDER BY {_draw('sample42', 'o_orderkey')}, o_orderkey LIMIT 350""",
    # streams
    "stream_available_now": """
        SELECT CAST(location_id AS VARCHAR) AS location_id, count(*) AS row_count,
               CAST(sum(inventory_qty) AS BIGINT) AS total_qty FROM raw_inventory GROUP BY 1""",
    "stream_dedupe": f"SELECT {_STOCK_TEXT} FROM inventory",
    "stream_least_copy": f"SELECT {_STOCK_TEXT} FROM raw_inventory",
    "stream_quality_gate": """
        SELECT 'total_rows' AS measure, count(*) AS row_count FROM landed_orders
        UNION ALL SELECT 'valid_qty', count(*) FROM landed_orders WHERE NOT order_qty > 0
        UNION ALL SELECT 'valid_amount', count(*) FROM landed_orders WHERE NOT order_amount > 0
        UNION ALL SELECT 'valid_date', count(*) FROM landed_orders WHERE order_date IS NULL
        UNION ALL SELECT 'silver_rows', count(DISTINCT order_id) FROM orders_gated""",
    "stream_to_gold": f"""
        SELECT * {_ROUNDED[:-1]}, CAST(item_id AS VARCHAR) AS item_id) FROM summary""",
    "incremental_gold": f"""
        SELECT * {_ROUNDED[:-1]}, CAST(item_id AS VARCHAR) AS item_id) FROM summary""",
    "stream_resume": f"""
        SELECT {_STOCK_TEXT}, CASE WHEN snapshot_date >= DATE '2000-01-01' THEN 2 ELSE 1 END
               AS ingest_run FROM raw_inventory""",
}


def _needed(sql, found):
    """Names of the definitions a statement uses, each after those it builds on."""
    for name in _CTES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            for inner in _needed(_CTES[name], []):
                if inner not in found:
                    found.append(inner)
            found.append(name)
    return found


def _statement(select):
    parts = [f"{name} AS ({_CTES[name]})" for name in _needed(select, [])]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


ORACLE = {name: _statement(select) for name, select in _SELECTS.items()}
