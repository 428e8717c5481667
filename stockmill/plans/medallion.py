"""The whole pipeline: landing folders to bronze, silver and gold tables."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from stockmill.operators import gold, quality, versions
from stockmill.operators.dedupe import KEYS
from stockmill.operators.sinks import register_table, write_materialized_view
from stockmill.operators.silver import typed
from stockmill.plans import incremental
from stockmill.schemas import FEEDS
from stockmill.session import exists
from stockmill.sources.landing import CORRUPT, EXTRA, feed_path, landing_path, read_item_master
from stockmill.streaming import tables

STREAMED = ("orders", "inventory", "receipts", "demand")
_SCHEMA_LOG = "column string, data_type string"
GOLD = ("inventory_summary", "turnover_analysis", "overstock_alert")


def ingest_bronze(spark, feed, landing, out, max_files=None):
    """Take new files of one feed into its bronze table; returns the table's path."""
    path = f"{out}/bronze/{feed}"
    tables.ingest_files(spark, feed_path(landing, feed), FEEDS[feed], path,
                        f"{out}/checkpoints/bronze_{feed}", f"{out}/checkpoints/headers_{feed}",
                        max_files)
    return path


def promote_column(spark, out, feed, column, data_type):
    """Note in the feed's schema log that a column it did not know is one from now on."""
    spark.createDataFrame([(column, data_type)], _SCHEMA_LOG).withColumn(
        "noted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{out}/schema_log/{feed}")


def read_bronze(spark, out, feed):
    """Bronze rows with the columns that the schema log has promoted; the latest type holds.

    Rows that came before the promotion have their values too, as nothing is left out.
    """
    log = f"{out}/schema_log/{feed}"
    promoted = {}
    if exists(spark, log):
        for r in spark.read.parquet(log).orderBy("noted_at").collect():
            promoted[r.column] = r.data_type
    schema = StructType([*FEEDS[feed].fields,
                         StructField(EXTRA, MapType(StringType(), StringType()))])
    rows = spark.read.schema(schema).parquet(f"{out}/bronze/{feed}")
    return rows.select(*FEEDS[feed].names, *[
        rows[EXTRA][name].try_cast(kind).alias(name) for name, kind in promoted.items()])


def refresh_items(spark, landing, out):
    """Replace the bronze item master by the landed one; returns it without malformed text."""
    items = write_materialized_view(
        read_item_master(spark, landing, keep_malformed=True), f"{out}/bronze/item_master")
    return items.drop(CORRUPT, EXTRA)


def refresh_silver(spark, table, out, max_files=None, **dedupe_options):
    """Take new bronze rows of one table into silver and store the rule counts per batch;
    returns the finished query."""
    source, checkpoint = f"{out}/bronze/{table}", f"{out}/checkpoints/silver_{table}"
    bronze = tables.read_table_stream(spark, source, FEEDS[table], max_files)
    query = tables.write_streaming_table(
        tables.silver_stream(bronze, table, **dedupe_options), f"{out}/silver/{table}", checkpoint)
    tables.count_batches(spark, table, source, FEEDS[table], checkpoint, f"{out}/rule_counts")
    return query


def read_layer(spark, out, layer, table):
    rows = spark.read.schema(FEEDS[table]).parquet(f"{out}/{layer}/{table}")
    return rows.select(*FEEDS[table].names)


def rebuild_gold(spark, items, out):
    """Recompute the gold tables whole; the later two read the stored summary."""
    inventory = read_layer(spark, out, "silver", "inventory")

    def replace(name, df):
        versions.write(df, f"{out}/gold/{name}", "month", layer="gold", notes={"made_of": {}})
        return incremental.read_gold(spark, out, name)

    summary = replace("inventory_summary", gold.inventory_summary(inventory, items))
    with ThreadPoolExecutor(2) as pool:
        made = [pool.submit(replace, "turnover_analysis", gold.turnover_analysis(summary)),
                pool.submit(replace, "overstock_alert", gold.overstock_alert(summary))]
    for table in made:
        table.result()
    return gold_tables(spark, out)


def gold_tables(spark, out):
    """The gold tables by name; the rule counts of the alerts are stored anew."""
    found = {name: incremental.read_gold(spark, out, name) for name in GOLD}
    rules = quality.EXPECTATIONS["overstock_alert"]
    tables.store_counts(
        quality.violation_counts(found["overstock_alert"], "overstock_alert", rules).select(
            "dataset", F.lit(0).cast("bigint").alias("batch"),
            F.col("expectation").alias("measure"), F.col("violations").alias("row_count")),
        f"{out}/rule_counts", "overstock_alert")
    return found


def run_pipeline(spark, out, landing=None, max_files=None, watermarks=None):
    """One update: new files through bronze and silver, then the months of gold they touch.

    ``watermarks`` maps a silver table to the (column, delay) that bounds its dedupe state.
    Feeds do not depend on each other, so their streams run side by side: a feed with little to
    do leaves no core idle.  When one fails, the others finish first; the next update goes on.
    """
    landing = landing or landing_path(spark)

    def take(feed):
        ingest_bronze(spark, feed, landing, out, max_files)
        if feed in KEYS:
            refresh_silver(spark, feed, out, max_files, watermark=(watermarks or {}).get(feed))

    with ThreadPoolExecutor(len(STREAMED) + 1) as pool:
        items = pool.submit(refresh_items, spark, landing, out)
        feeds = [pool.submit(take, feed) for feed in STREAMED]
    for feed in feeds:
        feed.result()
    incremental.update_gold(spark, items.result(), out, max_files)
    return gold_tables(spark, out)


def stored_tables(out):
    """(layer, table name, folder) of every table the pipeline stores."""
    found = [("bronze", f"raw_{feed}", f"{out}/bronze/{feed}") for feed in STREAMED]
    found.append(("bronze", "item_master", f"{out}/bronze/item_master"))
    found += [("silver", table, f"{out}/silver/{table}") for table in KEYS]
    found += [("gold", table, f"{out}/gold/{table}") for table in GOLD]
    return found


def register_layers(spark, out, database):
    """Name all stored tables in the catalog, tagged with their layer.

    A gold table is a view of its newest version's folders, to be named anew after an update.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for layer, name, path in stored_tables(out):
        if layer == "gold":
            versions.register_view(spark, f"{database}.{name}", path)
        else:
            register_table(spark, f"{database}.{name}", path, layer=layer)


def health(spark, out):
    """Tables and rows per layer, and the share of bronze rows that pass their rules.

    Rows of gold tables are known from their manifests; others are counted in footers.
    """
    stored = [(layer, name, spark.read.parquet(path)) for layer, name, path in stored_tables(out)
              if layer != "gold"]
    known = spark.createDataFrame(
        [("gold", len(GOLD), sum(versions.row_count(spark, f"{out}/gold/{n}") for n in GOLD))],
        "layer string, table_count bigint, row_count bigint")
    rates = [
        quality.pass_rate(typed(read_layer(spark, out, "bronze", table), table), table,
                          quality.EXPECTATIONS[table])
        for table in KEYS
    ]
    return (quality.layer_row_counts(stored).unionByName(known),
            reduce(lambda a, b: a.unionByName(b), rates))
