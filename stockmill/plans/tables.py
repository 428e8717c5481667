"""The tables that queries read, built on demand from the feeds."""

from functools import cached_property

from stockmill.operators import gold
from stockmill.operators.silver import silver_inventory, silver_orders, silver_receipts
from stockmill.operators.transfers import transfer_plan
from stockmill.sources import literals
from stockmill.sources.feeds import Feeds


class Tables:
    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.feeds = Feeds(spark, sf_dir)

    @cached_property
    def items(self):
        return self.feeds.item_master

    @cached_property
    def inventory(self):
        return silver_inventory(self.feeds.inventory_by_item)

    @cached_property
    def orders(self):
        """Silver orders of the clean feed."""
        return silver_orders(self.feeds.raw_orders)

    @cached_property
    def landed_orders(self):
        """Silver orders of the landing feed, which has faults."""
        return silver_orders(self.feeds.landed_orders)

    @cached_property
    def receipts(self):
        return silver_receipts(self.feeds.raw_receipts)

    @cached_property
    def demand(self):
        return self.feeds.raw_demand

    @cached_property
    def positions(self):
        return self.feeds.stock_position

    @cached_property
    def summary(self):
        return gold.inventory_summary(self.inventory, self.items)

    @cached_property
    def analysis(self):
        return gold.turnover_analysis(self.summary)

    @cached_property
    def alerts(self):
        return gold.overstock_alert(self.summary)

    @cached_property
    def overstock(self):
        """Alerts and hand-entered rows; ids become text to fit both."""
        alerts = self.alerts.withColumn("item_id", self.alerts.item_id.cast("string"))
        return gold.all_overstock(alerts, literals.overstock_entries(self.spark))

    @cached_property
    def all_positions(self):
        """Stock positions and hand-entered rows."""
        held = self.positions
        held = held.withColumns({c: held[c].cast("string") for c in ("item_id", "location")})
        return held.unionByName(literals.shortage_entries(self.spark))

    @cached_property
    def transfers(self):
        return transfer_plan(self.positions)

    def gold_tables(self):
        return {
            "inventory_summary": self.summary,
            "turnover_analysis": self.analysis,
            "overstock_alert": self.alerts,
        }

    def layers(self):
        """(layer, table name, DataFrame) of every table."""
        feeds = self.feeds
        return [
            ("bronze", "raw_orders", feeds.landed_orders),
            ("bronze", "raw_inventory", feeds.raw_inventory),
            ("bronze", "raw_receipts", feeds.raw_receipts),
            ("bronze", "raw_demand", feeds.raw_demand),
            ("bronze", "item_master", feeds.item_master),
            ("silver", "orders", self.landed_orders),
            ("silver", "inventory", self.inventory),
            ("silver", "receipts", self.receipts),
            *[("gold", name, df) for name, df in self.gold_tables().items()],
        ]
