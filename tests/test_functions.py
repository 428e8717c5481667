"""Worked examples for single column expressions."""

import pytest
from pyspark.sql import functions as F

from stockmill.functions import stock, text
from stockmill.operators import actions, analytics


def one(spark, schema, row, **columns):
    df = spark.createDataFrame([row], schema)
    return df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


@pytest.mark.parametrize("qty, turnover, days", [(200, 4.0, 20), (700, 1.5, 70), (599, 1.72, 59)])
def test_turnover_and_days(spark, qty, turnover, days):
    got = one(spark, "q double", (float(qty),),
              t=stock.turnover_rate("q"), d=stock.days_on_hand("q"))
    assert got == {"t": turnover, "d": days}


@pytest.mark.parametrize("turnover, days, priority", [
    (0.31, 72, "HIGH"), (1.2, 45, "MEDIUM"), (1.6, 25, "LOW"), (1.2, 85, "LOW"),
    (1.0, 30, "MEDIUM"), (1.5, 60, "MEDIUM"), (0.99, 60, "LOW"), (0.99, 61, "HIGH"),
])
def test_priority(spark, turnover, days, priority):
    got = one(spark, "turnover_rate double, days_on_hand long", (turnover, days),
              p=stock.proposal_priority())
    assert got["p"] == priority


@pytest.mark.parametrize("turnover, days, parts", [
    (0.31, 72, ("0.31", "-69%", "72日", "閾値超 +12日")),
    (1.6, 25, ("1.60", "+60%", "25日", "閾値未満 -35日")),
])
def test_quantitative_basis(spark, turnover, days, parts):
    got = one(spark, "turnover_rate double, days_on_hand long", (turnover, days),
              b=stock.quantitative_basis())
    assert all(p in got["b"] for p in parts)


def test_demand_gap(spark):
    got = one(spark, "forecast_qty long, actual_qty long", (10, 0),
              g=stock.gap_qty(), r=stock.gap_rate_pct())
    assert got == {"g": 10, "r": 1000.0}


@pytest.mark.parametrize("turnover, days, critical",
                         [(1.8, 550, True), (2.8, 370, True), (3.1, 130, False), (1.4, 10, True)])
def test_critical_flag(spark, turnover, days, critical):
    got = one(spark, "turnover_rate double, days_on_hand long", (turnover, days),
              c=stock.critical_flag())
    assert got["c"] is critical


@pytest.mark.parametrize("cell, number, kept", [
    ("¥1,200", 1200.0, None), ("3.5", 3.5, None), ("52％", 52.0, None), ("52%", 52.0, None),
    ("abc", None, "abc"), (None, None, ""), ("", None, ""), ("1.5d", None, "1.5d"),
    ("-7", -7.0, None), ("1e5", None, "1e5"), ("1.5e2", 150.0, None), ("nan", None, "nan"),
])
def test_parse_number(spark, cell, number, kept):
    got = one(spark, "c string", (cell,), n=text.parse_number("c"), t=text.parse_text("c"))
    assert got == {"n": number, "t": kept}


def test_format_money(spark):
    assert one(spark, "m double", (14800000.0,), t=text.format_money("m"))["t"] == "14,800,000"


def test_stock_status_labels(spark):
    from stockmill.sources.literals import shortage_entries

    got = {(r.item_id, r.location): (r.net_position, r.stock_status)
           for r in actions.stock_status(shortage_entries(spark)).collect()}
    assert got[("ITM-S0001", "東京倉庫")] == (-400, "不足")
    assert got[("ITM-S0001", "大阪倉庫")] == (550, "過剰")
    assert sorted(s for _, s in got.values()).count("適正") == 4


def test_share_of_total(spark):
    df = spark.createDataFrame(
        [("B", 1178.5), ("A", 385.0), ("C", 412.0), ("D", 278.0)], "category string, v double")
    got = {r.category: r.share_pct for r in analytics.share_of_total(df, "v").collect()}
    assert got == {"B": 52.3, "A": 17.1, "C": 18.3, "D": 12.3}


def test_leadtime_feasibility(spark):
    df = spark.createDataFrame([("a", "x", 45), ("a", "y", 7)],
                               "item_id string, location string, lead_time_days long")
    got = {r.location: r.feasible for r in actions.leadtime_feasibility(df).collect()}
    assert got == {"x": False, "y": True}


def test_emergency_trigger(spark):
    positions = spark.createDataFrame(
        [("a", "x", 180), ("a", "y", 200)], "item_id string, location string, current_stock long")
    items = spark.createDataFrame([("a", 30)], "item_id string, safety_stock_days long")
    demand = spark.createDataFrame([("a", 950)], "item_id string, actual_qty long")
    rows = actions.emergency_orders(positions, items, demand).collect()
    assert [(r.location, round(r.stock_share_pct, 1), r.priority) for r in rows] == \
        [("x", 18.9, "HIGH")]


def test_forecast_review_is_strict(spark):
    df = spark.createDataFrame([("a", 30.0), ("b", 30.1), ("c", -50.0)],
                               "item_id string, gap_rate_pct double")
    df = df.withColumns({"month": F.current_date(), "forecast_qty": F.lit(1),
                         "actual_qty": F.lit(1)})
    assert [r.item_id for r in actions.forecast_review(df).collect()] == ["b"]


def test_order_proposal_fields(spark):
    from datetime import date

    summary = spark.createDataFrame(
        [("a", date(2025, 1, 1), 3.0, 10), ("a", date(2025, 2, 1), 0.31, 72)],
        "item_id string, month date, turnover_rate double, days_on_hand long")
    positions = spark.createDataFrame(
        [("a", "x", 100, 500), ("a", "y", 50, 50)],
        "item_id string, location string, current_stock long, required_qty long")
    items = spark.createDataFrame(
        [("a", "motor", "A", 90, 7)],
        "item_id string, item_name string, category string, reorder_point_qty long, "
        "safety_stock_days long")
    demand = spark.createDataFrame([("a", 300)], "item_id string, actual_qty long")
    (row,) = actions.order_proposals(summary, positions, items, demand).collect()
    assert (row.current_stock, row.recommended_order_qty) == (150, 400)
    assert (row.priority, row.status, row.created_by) == ("HIGH", "PENDING", "ai-agent")
    assert len(row.proposal_id) == 64 and row.reason.endswith("+12日）]")
