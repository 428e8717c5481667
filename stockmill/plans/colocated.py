"""Monthly tables side by side in buckets: joins of items, stock and demand without a shuffle.

``item_master`` and ``inventory_sums`` lie in the same buckets of the item; ``inventory_summary``
and ``demand`` in the same buckets of item and month.  Making the summary from the sums, and
joining demand to it, reads matching buckets side by side.
"""

from pyspark.sql import functions as F

from stockmill.operators import analytics, colocated, gold, versions
from stockmill.plans import incremental
from stockmill.schemas import FEEDS

ITEM, ITEM_MONTH = ["item_id"], ["item_id", "month"]


def store_sums(sums, items, database, path, buckets=None):
    """Bucket the sums per item and month (``incremental.month_sums``) and the item master."""
    count = buckets or colocated.bucket_count(sums.count())
    colocated.write(sums, f"{database}.inventory_sums", f"{path}/inventory_sums", ITEM, count)
    colocated.write(items, f"{database}.item_master", f"{path}/item_master", ITEM, count)


def inventory_summary(spark, database):
    """The inventory summary of the bucketed sums and items."""
    return incremental.summary_of(
        spark.table(f"{database}.inventory_sums"), spark.table(f"{database}.item_master"))


def turnover_by_item(spark, database):
    """Months, mean turnover and mean value of each item; grouping by item moves no rows either."""
    return inventory_summary(spark, database).groupBy("item_id", "item_name", "category").agg(
        F.count(F.lit(1)).alias("month_count"),
        F.avg("turnover_rate").alias("avg_turnover_rate"),
        F.avg("avg_inventory_value").alias("avg_inventory_value"))


def store_summary(summary, demand, database, path, buckets=None):
    """Bucket summary and demand, both with one row per item and month."""
    count = buckets or colocated.bucket_count(summary.count())
    colocated.write(summary, f"{database}.inventory_summary", f"{path}/inventory_summary",
                    ITEM_MONTH, count)
    colocated.write(demand, f"{database}.demand", f"{path}/demand", ITEM_MONTH, count)


def demand_gap_with_value(spark, database):
    """Demand and stock value per item and month, from the bucketed tables."""
    return analytics.demand_gap_with_value(
        spark.table(f"{database}.demand"), spark.table(f"{database}.inventory_summary"))


def store_layers(spark, out, database, buckets=None):
    """Bucket the stored tables of a pipeline; returns the names that show them.

    The number of buckets follows from the rows that the manifest of the sums names.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    sums = f"{out}/gold/{incremental.SUMS}"
    count = buckets or colocated.bucket_count(versions.row_count(spark, sums))
    path = f"{out}/buckets"

    def stored(layer, feed):
        rows = spark.read.schema(FEEDS[feed]).parquet(f"{out}/{layer}/{feed}")
        return rows.select(*FEEDS[feed].names)

    items = gold.project_item_columns(stored("bronze", "item_master"))
    store_sums(versions.read(spark, sums), items, database, path, count)
    store_summary(incremental.read_gold(spark, out, "inventory_summary"),
                  stored("bronze", "demand"), database, path, count)
    names = [f"{database}.{n}" for n in ("inventory_sums", "item_master", "inventory_summary",
                                         "demand")]
    for name in names:
        colocated.drop_old(spark, name)
    return names
