"""Filling the landing folders with generated feeds."""

from pyspark.sql import functions as F

from stockmill.operators import datagen
from stockmill.operators.analytics import forecast_gap_by_category, latest_stock_by_category
from stockmill.sources.landing import land

# Default sizes
ITEMS = 500
ORDERS = 10_000


def generated_feeds(spark, items=ITEMS, orders=ORDERS):
    """All five feeds as lazy DataFrames."""
    made = datagen.gen_item_master(spark.range(items).withColumnRenamed("id", "item_seq"))
    placed = datagen.gen_orders(
        spark.range(orders).withColumnRenamed("id", "order_seq"), made, F.lit(items)
    )
    return {
        "item_master": made,
        "orders": placed,
        "inventory": datagen.gen_inventory(made),
        "receipts": datagen.gen_receipts(placed),
        "demand": datagen.gen_demand(made),
    }


def generate_landing(spark, root, items=ITEMS, orders=ORDERS):
    feeds = generated_feeds(spark, items, orders)
    for feed, rows in feeds.items():
        land(rows, root, feed)
    return feeds


def feed_summaries(feeds):
    """What a dry run shows: newest stock and mean forecast gap per category."""
    items = feeds["item_master"]
    return (
        latest_stock_by_category(feeds["inventory"], items),
        forecast_gap_by_category(feeds["demand"], items),
    )
