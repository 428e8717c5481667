"""Shares, comparisons, lead times and forecast accuracy.

Facts are aggregated to the join key before they meet a dimension, and windows without
partition keys only see rows that are already aggregated to categories or months.
"""

from pyspark.sql import Window, functions as F

from stockmill.functions import stock
from stockmill.operators.marts import newest_of


def _over_all(column):
    """Sum over all rows of an aggregated table."""
    return F.sum(column).over(Window.partitionBy())


def latest_stock_by_category(inventory, items):
    """True stock of the newest snapshot: quantity, value and items per category."""
    per_item = inventory.groupBy("item_id", "snapshot_date").agg(
        F.sum("inventory_qty").alias("qty"), F.sum("inventory_value").alias("value"))
    return newest_of(
        per_item.join(items.select("item_id", "category", "category_name"), "item_id")
        .groupBy("snapshot_date", "category", "category_name")
        .agg(
            F.sum("qty").alias("total_qty"),
            F.sum("value").alias("total_value"),
            F.count_distinct("item_id").alias("item_count"),
        ), "snapshot_date")


def forecast_gap_by_category(demand, items):
    """Mean gap rate per category, over all item months."""
    per_item = demand.groupBy("item_id").agg(
        F.sum("gap_rate_pct").alias("gap_sum"), F.count("gap_rate_pct").alias("gap_rows")
    )
    return (
        per_item.join(items.select("item_id", "category", "category_name"), "item_id")
        .groupBy("category", "category_name")
        .agg((F.sum("gap_sum") / F.sum("gap_rows")).alias("avg_gap_rate_pct"))
    )


def forecast_accuracy_by_category(demand, items):
    per_item = demand.groupBy("item_id").agg(
        F.sum("forecast_qty").alias("f"), F.sum("actual_qty").alias("a"),
        F.count(F.lit(1)).alias("n"),
    )
    per_category = (
        per_item.join(items.select("item_id", "category", "category_name"), "item_id")
        .groupBy("category", "category_name")
        .agg(F.sum("f").alias("f"), F.sum("a").alias("a"), F.sum("n").alias("n"))
    )
    return per_category.select(
        "category", "category_name",
        (F.col("f") / F.col("n")).alias("avg_forecast_qty"),
        (F.col("a") / F.col("n")).alias("avg_actual_qty"),
        F.try_divide((F.col("f") - F.col("a")) * 100.0, F.col("a")).alias("gap_rate_pct"),
    )


def receipts_with_orders(receipts, orders):
    """Receipts joined back to their orders; both sides hold one row per order."""
    return receipts.join(
        orders.select("order_id", "order_qty", "order_date", "expected_delivery_date", "status"),
        "order_id",
    )


def receipt_delay(receipts, orders):
    """Days late against the promise, and received against ordered quantity."""
    return receipts_with_orders(receipts, orders).select(
        "receipt_id", "order_id", "item_id", "supplier_id",
        stock.days_between("receipt_date", "expected_delivery_date").alias("delay_days"),
        (F.col("receipt_qty") / F.col("order_qty")).alias("fill_rate"),
    )


def supplier_leadtime_named(receipts, suppliers):
    return (
        receipts.groupBy("supplier_id")
        .agg(F.avg("lead_time_actual_days").alias("avg_lead_time"))
        .join(suppliers, "supplier_id")
        .select("supplier_id", "supplier_name", "avg_lead_time")
    )


def demand_gap_with_value(demand, summary):
    """Forecast, actual, gap rate and stock value per item and month."""
    return demand.join(
        summary.select("item_id", "month", "category", "avg_inventory_value"),
        ["item_id", "month"],
    ).select(
        "item_id", "month", "category", "forecast_qty", "actual_qty", "gap_rate_pct",
        F.col("avg_inventory_value").alias("inventory_value"),
    )


def category_share(summary):
    """Category value as percent of the total, newest month."""
    per_category = newest_of(summary.groupBy("month", "category", "category_name").agg(
        F.sum("avg_inventory_value").alias("total_value")))
    return share_of_total(per_category, "total_value")


def share_of_total(per_group, value, share="share_pct"):
    return per_group.withColumn(
        share, F.round(F.col(value) * 100 / _over_all(value), 1)
    )


def overstock_concentration(alerts):
    """Overstock items per category in percent, and average days against the rest."""
    per_category = alerts.groupBy("category").agg(
        F.count_distinct("item_id").alias("item_count"),
        F.sum("days_on_hand").alias("days"),
        F.count(F.lit(1)).alias("rows"),
    )
    rest_days = _over_all("days") - F.col("days")
    rest_rows = _over_all("rows") - F.col("rows")
    return per_category.select(
        "category", "item_count",
        F.round(F.col("item_count") * 100 / _over_all("item_count"), 1)
        .alias("item_share_pct"),
        (F.col("days") / F.col("rows")).alias("avg_days"),
        F.try_divide(rest_days, rest_rows).alias("avg_days_rest"),
    )


def leadtime_vs_rest(receipts, items):
    """Average lead time per category against all other categories."""
    per_item = receipts.groupBy("item_id").agg(
        F.sum("lead_time_actual_days").alias("days"),
        F.count("lead_time_actual_days").alias("rows"),
    )
    per_category = (
        per_item.join(items.select("item_id", "category"), "item_id")
        .groupBy("category")
        .agg(F.sum("days").alias("days"), F.sum("rows").alias("rows"))
    )
    rest = F.try_divide(
        _over_all("days") - F.col("days"), _over_all("rows") - F.col("rows")
    )
    return per_category.select(
        "category",
        (F.col("days") / F.col("rows")).alias("avg_lead_time"),
        rest.alias("avg_lead_time_rest"),
    ).withColumn(
        "diff_pct", F.try_divide(F.col("avg_lead_time"), F.col("avg_lead_time_rest")) * 100 - 100
    )


def month_over_month(summary):
    """Total value per month and its change on the calendar month before; NULL without one."""
    monthly = summary.groupBy("month").agg(F.sum("avg_inventory_value").alias("total_value"))
    line = Window.orderBy("month")  # one row per month
    before = F.when(F.lag("month").over(line) == F.add_months("month", -1),
                    F.lag("total_value").over(line))
    return monthly.withColumn("previous_value", before).withColumn(
        "change_pct", F.try_divide(F.col("total_value"), F.col("previous_value")) * 100 - 100
    )


def turnover_by_category(analysis):
    """Mean turnover per category with a verdict."""
    return (
        analysis.groupBy("category", "category_name")
        .agg(F.round(F.avg("avg_turnover_rate"), 2).alias("avg_turnover"))
        .withColumn("verdict", stock.turnover_verdict("avg_turnover"))
    )
