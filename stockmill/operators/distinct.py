"""Exact distinct counts that roll up.

Items get dense numbers; a number is a bit in one of the bitmaps of 32,768 bits.  Bitmaps are
stored per month, category and class of stock; ``or`` joins them over any grouping, so distinct
counts of months, categories and ranges of them come from the stored bitmaps alone.
"""

from pyspark.sql import Window, functions as F

from stockmill import rules

_CELLS = 64


def numbered(ids, column="item_id"):
    """Distinct ids with dense numbers from 0 on; counted in cells, so no task numbers all."""
    known = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn(
        "_cell", F.pmod(F.xxhash64(column), F.lit(_CELLS)))
    upto = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "_cell", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy(column)
    return known.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, "_cell").select(
        column, (F.col("_before") + F.col("_rank")).alias("item_number"))


def item_bitmaps(summary, numbers, min_days=rules.KPI_DAYS,
                 max_turnover=rules.OVERSTOCK_TURNOVER):
    """Bitmaps and value per month, category and whether stock is held too long.

    Rows move to their group before bitmaps are made: a task upstream holds a few items of every
    bitmap, so bitmaps combined there would be 4 KB for a handful of rows each.  A group holds
    one row per item, 32,768 at most.
    """
    number = F.col("item_number")
    long_held = F.coalesce((F.col("turnover_rate") < max_turnover)
                           & (F.col("days_on_hand") >= min_days), F.lit(False))
    group = ["month", "category", "long_held", "bucket"]
    return summary.join(numbers, "item_id").select(
        "month", "category", long_held.alias("long_held"),
        F.bitmap_bucket_number(number).alias("bucket"),
        F.bitmap_bit_position(number).alias("position"), "avg_inventory_value",
    ).repartition(*group).groupBy(*group).agg(
        F.bitmap_construct_agg("position").alias("items"),
        F.sum("avg_inventory_value").alias("total_value"))


def distinct_items(bitmaps, *by):
    """Value and distinct items per group of stored bitmaps."""
    merged = bitmaps.groupBy(*by, "bucket").agg(
        F.bitmap_or_agg("items").alias("items"), F.sum("total_value").alias("total_value"))
    return merged.groupBy(*by).agg(
        F.sum("total_value").alias("total_value"),
        F.coalesce(F.sum(F.bitmap_count("items")), F.lit(0)).alias("item_count"))
