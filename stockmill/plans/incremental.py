"""Gold tables kept up to date by what has changed.

New silver rows become sums and counts per item and month, which are added to the stored ones of
the months they fall in; no other month is read or written.  The gold tables of those months
are then made from the sums.  A month's gold notes the folder of sums it was made from, so a run
that is cut short is finished by the next one, and no batch counts twice.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from stockmill.functions import stock
from stockmill.operators import gold, versions
from stockmill.schemas import FEEDS
from stockmill.streaming import tables

SUMS = "inventory_sums"
KEY = ["item_id", "month"]


def month_sums(inventory):
    """Mergeable measures per item and month."""
    return inventory.groupBy("item_id", stock.month_key("snapshot_date").alias("month")).agg(
        F.count("inventory_qty").alias("qty_count"), F.sum("inventory_qty").alias("qty_sum"),
        F.count("inventory_value").alias("value_count"),
        F.sum("inventory_value").alias("value_sum"),
        F.max("inventory_qty").alias("max_inventory_qty"),
        F.min("inventory_qty").alias("min_inventory_qty"))


def merged(sums, more):
    """Two tables of measures as one."""
    return sums.unionByName(more).groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in ("qty_count", "qty_sum", "value_count", "value_sum")],
        F.max("max_inventory_qty").alias("max_inventory_qty"),
        F.min("min_inventory_qty").alias("min_inventory_qty"))


def summary_of(sums, items):
    """The inventory summary from measures; equal to ``gold.inventory_summary`` of the rows."""
    monthly = sums.select(
        *KEY, (F.col("qty_sum") / F.nullif("qty_count", F.lit(0))).alias("avg_inventory_qty"),
        (F.col("value_sum") / F.nullif("value_count", F.lit(0))).alias("avg_inventory_value"),
        "max_inventory_qty", "min_inventory_qty")
    return monthly.join(gold.project_item_columns(items), "item_id").withColumns({
        "turnover_rate": stock.turnover_rate("avg_inventory_qty"),
        "days_on_hand": stock.days_on_hand("avg_inventory_qty"),
    })


def add_batch(batch, number, path):
    """Add the rows of a stream's batch to the stored sums, once."""
    spark = batch.sparkSession
    base = versions.manifest(spark, path)
    if base["notes"].get("batch", -1) >= number:
        return
    # the months come from one column of the batch's files: the sums are made once and kept nowhere
    months = [r.month for r in batch.select(
        stock.month_key("snapshot_date").cast("string").alias("month")).distinct().collect()]
    touched = ["none" if m is None else m for m in months]
    held = [m for m in touched if m in base["parts"]]
    more = month_sums(batch)
    sums = merged(versions.read(spark, path, parts=held), more) if held else more
    versions.write(sums, path, "month", touched, base, "gold", notes={"batch": number})


def update_gold(spark, items, out, max_files=None):
    """Take new silver inventory into the gold tables; returns the months that were made anew.

    Where an item has changed, all months are made anew, still from the sums.
    """
    sums_path, silver = f"{out}/gold/{SUMS}", f"{out}/silver/inventory"
    stream = tables.read_table_stream(spark, silver, FEEDS["inventory"], max_files)
    stream.writeStream.foreachBatch(lambda batch, n: add_batch(batch, n, sums_path)).option(
        "checkpointLocation", f"{out}/checkpoints/gold").trigger(
        availableNow=True).start().awaitTermination()
    sums = versions.manifest(spark, sums_path)
    seen = items.agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.xxhash64(*gold.ITEM_COLUMNS).cast("decimal(38,0)")).cast("string").alias("h")).first()
    made_of = {part: f"{p['folder']} {seen.n} {seen.h}" for part, p in sums["parts"].items()}
    path = f"{out}/gold/inventory_summary"

    def bring(name, make):
        """Make the parts of one gold table anew whose sums or items have changed."""
        base = versions.manifest(spark, f"{out}/gold/{name}")
        done = base["notes"].get("made_of", {})
        parts = [p for p in made_of if done.get(p) != made_of[p]]
        if parts or not base["version"]:
            versions.write(make(parts) if sums["version"] else make_empty(spark, items, name),
                           f"{out}/gold/{name}", "month", parts, base, "gold",
                           notes={"made_of": made_of})
        return parts

    changed = set(bring("inventory_summary", lambda parts: summary_of(
        versions.read(spark, sums_path, parts=parts), items)))
    with ThreadPoolExecutor(2) as pool:  # both read the stored summary only
        made = [pool.submit(bring, "turnover_analysis", lambda parts: gold.turnover_analysis(
                    versions.read(spark, path, parts=parts))),
                pool.submit(bring, "overstock_alert", lambda parts: gold.overstock_alert(
                    versions.read(spark, path, parts=parts)))]
    for table in made:
        changed.update(table.result())
    return sorted(changed)


def make_empty(spark, items, name):
    """A gold table before any stock has come."""
    none = spark.createDataFrame([], FEEDS["inventory"])
    summary = gold.inventory_summary(none, items)
    return {"inventory_summary": lambda: summary, "overstock_alert": lambda:
            gold.overstock_alert(summary), "turnover_analysis": lambda:
            gold.turnover_analysis(summary)}[name]()


def read_gold(spark, out, name):
    return versions.read(spark, f"{out}/gold/{name}")
