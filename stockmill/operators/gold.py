"""Monthly stock, turnover and overstock tables."""

from pyspark.sql import functions as F

from stockmill import rules
from stockmill.functions import stock

ITEM_COLUMNS = ["item_id", "item_name", "category", "category_name", "unit_price"]
ALERT_COLUMNS = [
    "item_id", "item_name", "category", "category_name", "month",
    "avg_inventory_qty", "avg_inventory_value", "turnover_rate", "days_on_hand",
]


def monthly_item_stock(inventory):
    """Average, highest and lowest stock over locations, per item and month."""
    return (
        inventory.groupBy("item_id", stock.month_key("snapshot_date").alias("month"))
        .agg(
            F.avg("inventory_qty").alias("avg_inventory_qty"),
            F.avg("inventory_value").alias("avg_inventory_value"),
            F.max("inventory_qty").alias("max_inventory_qty"),
            F.min("inventory_qty").alias("min_inventory_qty"),
        )
    )


def project_item_columns(items):
    return items.select(*ITEM_COLUMNS)


def inventory_summary(inventory, items):
    """Monthly stock with item attributes, turnover and days on hand.

    The aggregate runs before the join: an item that fills a third of the snapshots
    meets the join as one row per month.
    """
    return (
        monthly_item_stock(inventory)
        .join(project_item_columns(items), "item_id")
        .withColumns({
            "turnover_rate": stock.turnover_rate("avg_inventory_qty"),
            "days_on_hand": stock.days_on_hand("avg_inventory_qty"),
        })
    )


def turnover_analysis(summary):
    return summary.groupBy("category", "category_name", "month").agg(
        F.avg("turnover_rate").alias("avg_turnover_rate"),
        F.sum("avg_inventory_value").alias("total_inventory_value"),
        F.count_distinct("item_id").alias("item_count"),
        F.avg("days_on_hand").alias("avg_days_on_hand"),
    )


def overstock_alert(summary, max_turnover=rules.OVERSTOCK_TURNOVER):
    return summary.filter(F.col("turnover_rate") < max_turnover).select(*ALERT_COLUMNS)


def all_overstock(alerts, entries):
    """Computed alerts and hand-entered overstock rows as one list."""
    return alerts.withColumn("source", F.lit("pipeline")).unionByName(
        entries.withColumn("source", F.lit("manual")), allowMissingColumns=True
    )
