"""Inventory feeds derived from the star-schema test tables.

Each method returns a lazy DataFrame; keys keep the tables' integer types.
"""

from functools import cached_property

from pyspark.sql import functions as F

from stockmill import rules
from stockmill.functions import stock

# Quantity scale, and faults added to the order landing feed
QTY_SCALE = 20
ZERO_QTY_EVERY, NO_DATE_EVERY, NEGATIVE_AMOUNT_EVERY = 97, 89, 83
REDELIVERED_EVERY = 10
#: Order lines whose stock rows one task holds, on average.
LINES_PER_TASK = 250_000
CREATED_AT = "2025-01-01"
_SAFETY_DAYS = (7, 14, 21)
_LAST_SAFETY_DAYS = 30


class Feeds:
    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.sf_dir = sf_dir
        self._schemas = {}

    def table(self, name):
        """A star-schema table; its file footer is read once."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    @cached_property
    def supplier_count(self):
        """Number of suppliers, as a scalar subquery."""
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def suppliers(self):
        return self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name")
        )

    def _located(self, lines):
        """Order lines with the location (region) of their supplier.

        The dimensions join one after the other: a join of the two would hide from the
        planner how small they are.
        """
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        return (
            lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def prices(self):
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("unit_price")
        )

    @cached_property
    def item_master(self):
        key = F.col("p_partkey")
        supplier = key % self.supplier_count
        safety = F.lit(_LAST_SAFETY_DAYS)
        for rest, days in reversed(list(enumerate(_SAFETY_DAYS))):
            safety = F.when(key % 4 == rest, days).otherwise(safety)
        return self.table("part").select(
            key.alias("item_id"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("type "), F.col("p_type")).alias("category_name"),
            F.col("p_retailprice").alias("unit_price"),
            supplier.alias("primary_supplier_id"),
            (supplier % 39 + 7).alias("lead_time_days"),
            safety.cast("bigint").alias("safety_stock_days"),
            (key * 7 % 451 + 50).alias("reorder_point_qty"),
            F.lit(CREATED_AT).cast("date").alias("created_at"),
        )

    @cached_property
    def dated_lines(self):
        """Order lines with the date and status of their order, before any item join."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_orderdate").cast("date").alias("order_date"), "o_orderstatus",
        )
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
        )
        return (
            lines.join(orders, "l_orderkey")
            .withColumnRenamed("l_partkey", "item_id")
            .withColumn("order_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        )

    @cached_property
    def _order_lines(self):
        return (
            self.dated_lines.join(self.prices, "item_id")
            .withColumns({
                "order_qty": (F.col("l_quantity") * QTY_SCALE).cast("bigint"),
                "promised_days": F.col("l_suppkey") % 39 + 7,
                "status": F.when(F.col("o_orderstatus") == "F", rules.DELIVERED)
                .when(F.col("o_orderstatus") == "O", rules.IN_TRANSIT)
                .otherwise(rules.PENDING),
            })
            .withColumn("order_amount", stock.line_value("order_qty", "unit_price"))
        )

    @cached_property
    def raw_orders(self):
        return self._order_lines.select(
            "order_id", "item_id", F.col("l_suppkey").alias("supplier_id"), "order_qty",
            "unit_price", "order_amount", "order_date",
            stock.due_date("order_date", "promised_days").alias("expected_delivery_date"),
            "status",
        )

    @cached_property
    def landed_orders(self):
        """Order feed with faults for the quality rules to find."""
        line = self._order_lines
        order = F.col("l_orderkey")
        qty = F.when(order % ZERO_QTY_EVERY == 0, F.lit(0)).otherwise(F.col("order_qty"))
        amount = F.when(order % NEGATIVE_AMOUNT_EVERY == 0, -F.col("order_amount")).otherwise(
            F.col("order_amount"))
        return line.select(
            "order_id", "item_id", F.col("l_suppkey").alias("supplier_id"),
            qty.cast("bigint").alias("order_qty"), "unit_price", amount.alias("order_amount"),
            F.when(order % NO_DATE_EVERY != 0, F.col("order_date")).alias("order_date"),
            stock.due_date("order_date", "promised_days").alias("expected_delivery_date"),
            "status",
        )

    @cached_property
    def raw_receipts(self):
        mixed = F.col("l_orderkey") + F.col("l_linenumber")
        return (
            self._order_lines.filter(F.col("status") == rules.DELIVERED)
            .withColumn("taken_days", F.col("promised_days") + mixed % 10 - 2)
            .withColumn("receipt_date", stock.due_date("order_date", "taken_days"))
            .select(
                F.col("order_id").alias("receipt_id"), "order_id", "item_id",
                F.col("l_suppkey").alias("supplier_id"),
                (F.col("order_qty") * (mixed % 11 + 95) / 100).cast("bigint").alias("receipt_qty"),
                "receipt_date",
                stock.days_between("receipt_date", "order_date").alias("lead_time_actual_days"),
                F.when(F.col("l_orderkey") % 5 == 0, "inspection_required").otherwise("passed")
                .alias("quality_status"),
            )
        )

    @cached_property
    def _stock_sums(self):
        """Quantity per item, location and month's end, before any item join."""
        lines = self.table("lineitem").select(
            "l_partkey", "l_suppkey", "l_quantity",
            F.last_day(F.col("l_shipdate").cast("date")).alias("snapshot_date"),
        )
        return (
            self._located(lines)
            .groupBy(F.col("l_partkey").alias("item_id"),
                     F.col("n_regionkey").alias("location_id"), "snapshot_date")
            .agg((F.sum("l_quantity") * QTY_SCALE).cast("bigint").alias("inventory_qty"))
        )

    def _valued(self, sums, prices):
        return sums.join(prices, "item_id").select(
            "item_id", "location_id", "inventory_qty",
            stock.line_value("inventory_qty", "unit_price").alias("inventory_value"),
            "snapshot_date")

    @cached_property
    def raw_inventory(self):
        return self._valued(self._stock_sums, self.prices)

    @cached_property
    def line_count(self):
        """Number of order lines, from the file footers."""
        return self.table("lineitem").count()

    @cached_property
    def inventory_by_item(self):
        """``raw_inventory`` dealt out by item, in more tasks for more order lines.

        The price join, the dedupe and the groupings by item and date all use this one deal, so
        what a task sorts and groups does not grow with the tables.  Sums come before it: an item
        that fills a third of the lines has one row per location and month.
        """
        tasks = -(-self.line_count // LINES_PER_TASK) or 1
        return self._valued(self._stock_sums.repartition(tasks, "item_id"),
                            self.prices.repartition(tasks, "item_id"))

    @cached_property
    def redelivered_inventory(self):
        """The inventory rows that arrive a second time."""
        return self.raw_inventory.filter(F.col("item_id") % REDELIVERED_EVERY == 0)

    @cached_property
    def raw_demand(self):
        qty = F.col("l_quantity")
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("item_id"),
                     stock.month_key(F.col("l_shipdate").cast("date")).alias("month"))
            .agg(
                (F.sum(qty) * QTY_SCALE).cast("bigint").alias("forecast_qty"),
                (F.sum(F.when(F.col("l_linestatus") == "F", qty).otherwise(0.0)) * QTY_SCALE)
                .cast("bigint").alias("actual_qty"),
            )
            .withColumns({"gap_qty": stock.gap_qty(), "gap_rate_pct": stock.gap_rate_pct()})
        )

    @cached_property
    def stock_position(self):
        """Stock and requirement per item and location, with item attributes."""
        def held(status):
            flagged = F.when(F.col("l_linestatus") == status, F.col("l_quantity")).otherwise(0.0)
            return (F.sum(flagged) * QTY_SCALE).cast("bigint")

        lines = self.table("lineitem").select(
            "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
        return (
            self._located(lines)
            .groupBy(F.col("l_partkey").alias("item_id"), F.col("n_regionkey").alias("location"))
            .agg(held("F").alias("current_stock"), held("O").alias("required_qty"))
            .join(self.item_master.select("item_id", "item_name", "category", "category_name",
                                          "lead_time_days"), "item_id")
            .withColumn("status", stock.stock_status())
        )
