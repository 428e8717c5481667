"""Inventory action rules: what to order, move or review."""

from pyspark.sql import functions as F

from stockmill import rules
from stockmill.functions import stock
from stockmill.operators.transfers import uncovered_shortages

# Wording of reasons and request forms
_REASON_EMERGENCY = "現在庫が安全在庫水準を大幅に下回る"
_REASON_SHORT = "必要量に対し在庫が不足"
_REASON_TURNOVER = "在庫回転率が基準値を下回る"
_TRANSFER_REASON = "%s で %d個 の不足、サプライヤーリードタイム %d日"
_TRANSFER_SUMMARY = "[%s] から [%s] へ %s を %d個 転用するための依頼書です。理由: %s"
_ORDER_REASON = "必要量 %d個 に対し現在庫 %d個、転用 %d個 を差し引き %d個 不足"
_ORDER_SUMMARY = "緊急手配: %s を %d個発注するための依頼書です。希望納期: %s。理由: %s"


def proposal_priority(summary):
    return summary.select(
        "item_id", "month", "turnover_rate", "days_on_hand",
        stock.proposal_priority().alias("priority"),
    )


def quantitative_basis(summary):
    return summary.select(
        "item_id", "month", stock.quantitative_basis().alias("quantitative_basis")
    )


def critical_flag(summary):
    return summary.select(
        "item_id", "month", "turnover_rate", "days_on_hand",
        stock.critical_flag().alias("critical"),
    )


def stock_status(positions):
    return positions.select(
        "item_id", "location", "current_stock", "required_qty",
        stock.net_position().alias("net_position"),
        stock.stock_status().alias("stock_status"),
    )


def safety_stock(items, demand):
    """Safety stock per item: its days of average monthly demand."""
    monthly = demand.groupBy("item_id").agg(F.avg("actual_qty").alias("avg_actual"))
    qty = F.col("safety_stock_days") * F.col("avg_actual") / rules.DAYS_PER_MONTH
    return items.join(monthly, "item_id").select("item_id", qty.alias("safety_stock_qty"))


def emergency_orders(positions, items, demand, share=rules.EMERGENCY_SHARE):
    """Positions at or below the given share of safety stock; always HIGH."""
    return (
        positions.join(safety_stock(items, demand), "item_id")
        .filter(F.col("current_stock") <= F.col("safety_stock_qty") * share)
        .select(
            "item_id", "location", "current_stock", "safety_stock_qty",
            F.try_divide(F.col("current_stock") * 100, F.col("safety_stock_qty"))
            .alias("stock_share_pct"),
            F.lit(rules.PRIORITY_HIGH).alias("priority"),
        )
    )


def forecast_review(demand, max_gap_pct=rules.FORECAST_GAP_PCT):
    """Item months whose forecast overshoots so far that the order plan needs review."""
    return demand.filter(F.col("gap_rate_pct") > max_gap_pct).select(
        "item_id", "month", "forecast_qty", "actual_qty", "gap_rate_pct"
    )


def leadtime_feasibility(positions, days_until_need=rules.DAYS_UNTIL_NEED):
    return positions.select(
        "item_id", "location", "lead_time_days",
        (F.col("lead_time_days") <= days_until_need).alias("feasible"),
    )


def surplus_candidates(positions):
    """For each short position, the stock other locations of the item could give.

    Surplus is summed per item first and met by each shortage once, so the result grows
    with the shortages and not with the pairs of locations.
    """
    net = positions.withColumn("net", stock.net_position())
    surplus = (
        net.filter(F.col("net") > 0)
        .groupBy("item_id")
        .agg(
            F.count(F.lit(1)).alias("surplus_locations"),
            F.sum("net").alias("surplus_qty"),
            F.min(F.struct((-F.col("net")).alias("n"), F.col("location"))).alias("best"),
        )
    )
    return (
        net.filter(F.col("net") < 0)
        .join(surplus, "item_id")
        .select(
            "item_id", F.col("location").alias("short_location"),
            (-F.col("net")).alias("shortage_qty"),
            "surplus_locations", "surplus_qty",
            F.col("best.location").alias("best_location"),
            (-F.col("best.n")).alias("best_surplus_qty"),
        )
    )


def replenishment_choice(positions, days_until_need=rules.DAYS_UNTIL_NEED):
    """Transfer when the supplier is too slow or another location holds surplus.

    ``has_source`` tells whether any stock can be moved: a late supplier makes the choice a
    transfer even where none can, and such a position has to be ordered after all.
    """
    net = positions.withColumn("net", stock.net_position())
    surplus = net.filter(F.col("net") > 0).groupBy("item_id").agg(
        F.sum("net").alias("surplus_qty")
    )
    late = F.col("lead_time_days") > days_until_need
    return (
        net.filter(F.col("net") < 0)
        .join(surplus, "item_id", "left")
        .select(
            "item_id", "location", (-F.col("net")).alias("shortage_qty"), "lead_time_days",
            F.coalesce("surplus_qty", F.lit(0)).alias("surplus_qty"),
            F.when(late | F.col("surplus_qty").isNotNull(), "transfer").otherwise("order")
            .alias("choice"),
            F.col("surplus_qty").isNotNull().alias("has_source"),
        )
    )


def transfer_requests(plan, request_date, days_until_need=rules.DAYS_UNTIL_NEED):
    """Request form rows for a transfer plan."""
    reason = F.format_string(
        _TRANSFER_REASON, F.col("target_location").cast("string"), "shortage_qty", "lead_time_days"
    )
    summary = F.format_string(
        _TRANSFER_SUMMARY, F.col("source_location").cast("string"),
        F.col("target_location").cast("string"), "item_name", "transfer_qty", "reason",
    )
    return plan.withColumn("reason", reason).select(
        F.lit(request_date).cast("date").alias("request_date"),
        "item_id", "item_name", "source_location", "target_location", "transfer_qty",
        F.date_add(F.lit(request_date).cast("date"), days_until_need)
        .alias("desired_delivery_date"),
        "reason", summary.alias("summary"),
    )


def emergency_order_requests(positions, request_date,
                             days_until_need=rules.DAYS_UNTIL_NEED):
    """Order form rows for what transfers cannot cover."""
    due = F.date_add(F.lit(request_date).cast("date"), days_until_need)
    reason = F.format_string(
        _ORDER_REASON, "required_qty", "current_stock", "covered_qty", "order_qty"
    )
    summary = F.format_string(
        _ORDER_SUMMARY, "item_name", "order_qty",
        F.date_format("desired_delivery_date", "yyyy/MM/dd"), "reason",
    )
    return (
        uncovered_shortages(positions)
        .withColumns({"desired_delivery_date": due, "reason": reason})
        .select(
            F.lit(request_date).cast("date").alias("request_date"),
            "item_id", "item_name", "order_qty", "desired_delivery_date",
            F.col("location").alias("delivery_location"),
            F.when(F.col("lead_time_days") > days_until_need, rules.URGENT)
            .otherwise(rules.NORMAL).alias("priority"),
            "reason", summary.alias("summary"),
        )
    )


def order_proposals(summary, positions, items, demand):
    """One proposal per item that is short, nearly out of stock or slow in its newest month.

    The id is a SHA-256 of item and month, so writing the same proposal twice is visible.
    """
    newest = (
        summary.groupBy("item_id")
        .agg(F.max("month").alias("month"),
             F.max_by("turnover_rate", "month").alias("turnover_rate"),
             F.max_by("days_on_hand", "month").alias("days_on_hand"))
    )
    held = positions.groupBy("item_id").agg(
        F.sum("current_stock").alias("current_stock"),
        F.sum("required_qty").alias("required_qty"),
    )
    rows = (
        items.select("item_id", "item_name", "category", "reorder_point_qty")
        .join(newest, "item_id")
        .join(held, "item_id")
        .join(safety_stock(items, demand), "item_id")
    )
    emergency = F.col("current_stock") <= F.col("safety_stock_qty") * rules.EMERGENCY_SHARE
    short = F.col("required_qty") > F.col("current_stock")
    priority = F.when(emergency, rules.PRIORITY_HIGH).otherwise(stock.proposal_priority())
    reason = (
        F.when(emergency, _REASON_EMERGENCY).when(short, _REASON_SHORT).otherwise(_REASON_TURNOVER)
    )
    return (
        rows.withColumn("priority", priority)
        .filter(short | (F.col("priority") != rules.PRIORITY_LOW))
        .select(
            F.sha2(F.concat_ws("|", F.col("item_id").cast("string"),
                               F.date_format("month", "yyyy-MM-dd")), 256).alias("proposal_id"),
            "item_id", "item_name", "category", "current_stock",
            F.greatest(F.col("required_qty") - F.col("current_stock"),
                       F.col("reorder_point_qty")).alias("recommended_order_qty"),
            F.concat(reason, F.lit(" ["), stock.quantitative_basis(), F.lit("]")).alias("reason"),
            "priority",
            F.lit(rules.PROPOSAL_STATUS).alias("status"),
            F.lit(rules.PROPOSAL_AUTHOR).alias("created_by"),
        )
    )
