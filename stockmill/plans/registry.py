"""Every query by name: a function of (spark, folder of tables)."""

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from stockmill.functions import stock, text
from stockmill.operators import (
    actions, analytics, datagen, distinct, gold, marts, quality, report, sinks, skew, versions,
)
from stockmill.operators.colocated import bucket_count
from stockmill.operators.dedupe import KEYS, dedupe
from stockmill.operators.silver import typed
from stockmill.plans import colocated, incremental, medallion, stored_actions
from stockmill.plans.tables import Tables
from stockmill.schemas import FEEDS, OVERSTOCK_ENTRIES, conform
from stockmill.session import new_dir
from stockmill.sources import landing, literals
from stockmill.streaming import tables as streams

REQUEST_DATE = "2025-01-01"
SECOND_ARRIVAL = "2000-01-01"
LATE_FROM = "2001-06-01"
SAMPLE_ROWS, SAMPLE_SEED = 350, 42
MIN_BUCKETS = 8

QUERIES = {}


def query(fn):
    def run(spark, sf_dir):
        return fn(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def rounded(df, places, *columns):
    """Round reported averages and sums, whose last bits depend on summing order."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- sources -------------------------------------------------------------------------

def _ingest(t, feed, rows):
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(rows, root, feed)
    medallion.ingest_bronze(t.spark, feed, root, out)
    return medallion.read_layer(t.spark, out, "bronze", feed)


@query
def ingest_orders_stream(t):
    return _ingest(t, "orders", t.feeds.landed_orders)


@query
def ingest_inventory_stream(t):
    return _ingest(t, "inventory", t.feeds.raw_inventory)


@query
def ingest_receipts_stream(t):
    return _ingest(t, "receipts", t.feeds.raw_receipts)


@query
def ingest_demand_stream(t):
    return _ingest(t, "demand", t.feeds.raw_demand)


@query
def ingest_item_master(t):
    root = new_dir(t.spark, "landing")
    landing.land(t.items, root, "item_master")
    return landing.read_item_master(t.spark, root)


@query
def ingest_new_columns(t):
    """Receipts with a column that the feed does not know, before and after it is promoted."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    receipts = t.feeds.raw_receipts
    dock = F.concat(F.lit("dock "), F.pmod("lead_time_actual_days", F.lit(9)).cast("string"))
    for part in (0, 1):
        rows = receipts.filter(F.pmod(F.col("lead_time_actual_days"), F.lit(2)) == part)
        if part:  # the column comes with the second delivery, in front of the others
            rows = rows.select(dock.alias("dock"), "*")
        rows.write.mode("append").option("header", True).csv(landing.feed_path(root, "receipts"))
        medallion.ingest_bronze(t.spark, "receipts", root, out)
    medallion.promote_column(t.spark, out, "receipts", "dock", "string")
    return medallion.read_bronze(t.spark, out, "receipts").select(
        "receipt_id", "receipt_qty", "lead_time_actual_days", "dock")


@query
def read_literal_rows(t):
    """Hand-entered rows beside the computed rows they extend."""
    over = t.overstock.select(
        F.lit("overstock").alias("table_name"), "source",
        F.col("avg_inventory_qty").alias("qty"), F.col("days_on_hand").alias("days"),
    )
    manual = F.col("item_id").startswith("ITM-")
    short = t.all_positions.select(
        F.lit("shortage").alias("table_name"),
        F.when(manual, "manual").otherwise("pipeline").alias("source"),
        F.col("current_stock").cast("double").alias("qty"), F.col("lead_time_days").alias("days"),
    )
    return rounded(
        over.unionByName(short).groupBy("table_name", "source").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("qty").alias("total_qty"),
            F.sum("days").alias("total_days"),
        ), 2, "total_qty")


# ---- sinks ---------------------------------------------------------------------------

@query
def write_streaming_table(t):
    """Bronze and silver receipts, written by streams and counted when read back."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(t.feeds.raw_receipts, root, "receipts")
    medallion.ingest_bronze(t.spark, "receipts", root, out)
    medallion.refresh_silver(t.spark, "receipts", out)

    def count(layer):
        return medallion.read_layer(t.spark, out, layer, "receipts").agg(
            F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("receipt_id").alias("key_count"),
        )

    return count("bronze").unionByName(count("silver"))


@query
def write_materialized_view(t):
    """The three gold tables, written and read back."""
    out = new_dir(t.spark, "gold")
    summary = sinks.write_materialized_view(
        t.summary, f"{out}/inventory_summary", cluster_by="month")
    analysis = sinks.write_materialized_view(
        gold.turnover_analysis(summary), f"{out}/turnover_analysis")
    alerts = sinks.write_materialized_view(
        gold.overstock_alert(summary), f"{out}/overstock_alert", cluster_by="month")

    def count(name, df, value):
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                      F.round(F.sum(value), 2).alias("total_value"))

    return (
        count("inventory_summary", summary, "avg_inventory_value")
        .unionByName(count("turnover_analysis", analysis, "total_inventory_value"))
        .unionByName(count("overstock_alert", alerts, "avg_inventory_value"))
    )


@query
def create_or_replace_typed_table(t):
    path = new_dir(t.spark, "overstock_entries")
    stored = sinks.create_or_replace_table(t.overstock, OVERSTOCK_ENTRIES, path)
    return rounded(stored, 2, "avg_inventory_qty", "avg_inventory_value")


@query
def versioned_tables(t):
    """What the manifests of stored tables say: types, comments, layer, version and rows."""
    out = new_dir(t.spark, "versions")
    tables = {"inventory_summary": (t.summary, "month", "gold"),
              "overstock_entries": (conform(t.overstock, OVERSTOCK_ENTRIES), None, "manual")}
    found = []
    for name, (df, part_by, layer) in tables.items():
        versions.write(df.limit(0), f"{out}/{name}", layer=layer)
        versions.write(df, f"{out}/{name}", part_by)
        found.append(versions.describe(t.spark, f"{out}/{name}").select(
            F.lit(name).alias("table_name"), "*",
            F.lit(versions.row_count(t.spark, f"{out}/{name}")).cast("bigint").alias("row_count")))
    return found[0].unionByName(found[1])


@query
def newest_month_stored(t):
    """The newest month of the stored summary: its manifest names the only folder to read."""
    path = new_dir(t.spark, "summary")
    versions.write(t.summary, path, "month", layer="gold")
    return _summary_rounded(versions.newest_part(t.spark, path))


@query
def append_order_proposals(t):
    path = new_dir(t.spark, "order_proposals")
    proposals = actions.order_proposals(t.summary, t.positions, t.items, t.demand)
    return sinks.append_order_proposals(proposals, path).drop("created_at")


@query
def export_csv(t):
    path = new_dir(t.spark, "export")
    sinks.export_csv(t.demand, path)
    return landing.read_csv(t.spark, path, FEEDS["demand"])


# ---- quality -------------------------------------------------------------------------

@query
def expect_warn(t):
    """Violations of the warn rules of all tables."""
    def counts(df, table):
        rules = [r for r in quality.EXPECTATIONS[table] if r.action == quality.WARN]
        return quality.violation_counts(df, table, rules)

    return (
        counts(t.feeds.landed_orders, "orders")
        .unionByName(counts(t.feeds.raw_inventory, "inventory"))
        .unionByName(counts(t.alerts, "overstock_alert"))
    )


@query
def expect_or_drop(t):
    return quality.expect_or_drop(
        typed(t.feeds.landed_orders, "orders"), quality.EXPECTATIONS["orders"]
    )


@query
def expect_or_fail(t):
    return quality.expect_or_fail(
        typed(t.feeds.raw_receipts, "receipts"), quality.EXPECTATIONS["receipts"]
    )


@query
def quality_pass_rate(t):
    def rate(df, table):
        return quality.pass_rate(df, table, quality.EXPECTATIONS[table])

    return (
        rate(t.feeds.landed_orders, "orders")
        .unionByName(rate(t.feeds.raw_inventory, "inventory"))
        .unionByName(rate(t.feeds.raw_receipts, "receipts"))
    )


@query
def layer_row_counts(t):
    return quality.layer_row_counts(t.layers())


# ---- silver, projections, filters ----------------------------------------------------

@query
def silver_orders(t):
    return t.landed_orders


@query
def silver_inventory(t):
    return t.inventory


@query
def silver_receipts(t):
    return t.receipts


@query
def month_key(t):
    return t.inventory.select(
        "item_id", "location_id", "snapshot_date", stock.month_key("snapshot_date").alias("month")
    )


@query
def turnover_rate(t):
    return rounded(
        gold.monthly_item_stock(t.inventory).select(
            "item_id", "month", "avg_inventory_qty",
            stock.turnover_rate("avg_inventory_qty").alias("turnover_rate"),
        ), 4, "avg_inventory_qty")


@query
def days_on_hand(t):
    return rounded(
        gold.monthly_item_stock(t.inventory).select(
            "item_id", "month", "avg_inventory_qty",
            stock.days_on_hand("avg_inventory_qty").alias("days_on_hand"),
        ), 4, "avg_inventory_qty")


@query
def project_item_columns(t):
    return gold.project_item_columns(t.items)


@query
def order_amount(t):
    return t.feeds.raw_orders.select(
        "order_id", "item_id", "order_qty", "unit_price",
        stock.line_value("order_qty", "unit_price").alias("order_amount"),
    )


@query
def inventory_value(t):
    return t.feeds.raw_inventory.select(
        "item_id", "location_id", "snapshot_date", "inventory_value")


@query
def expected_delivery_date(t):
    """Order date plus the lead time of the item's own supplier."""
    return t.feeds.dated_lines.join(t.items.select("item_id", "lead_time_days"), "item_id").select(
        "order_id", "item_id", "order_date", "lead_time_days",
        stock.due_date("order_date", "lead_time_days").alias("expected_delivery_date"),
    )


@query
def expected_delivery_spread(t):
    """As ``expected_delivery_date``, by the join that spreads frequent keys itself."""
    lead_times = t.items.select("item_id", "lead_time_days")
    return skew.join_spread(t.feeds.dated_lines, lead_times, "item_id").select(
        "order_id", "item_id", "order_date", "lead_time_days",
        stock.due_date("order_date", "lead_time_days").alias("expected_delivery_date"),
    )


@query
def lead_time_actual_days(t):
    return analytics.receipts_with_orders(t.receipts, t.orders).select(
        "receipt_id", "order_date", "receipt_date",
        stock.days_between("receipt_date", "order_date").alias("lead_time_actual_days"),
    )


@query
def receipt_delay(t):
    return rounded(analytics.receipt_delay(t.receipts, t.orders), 10, "fill_rate")


@query
def demand_gap(t):
    return t.demand.select(
        "item_id", "month", "forecast_qty", "actual_qty",
        stock.gap_qty().alias("gap_qty"), stock.gap_rate_pct().alias("gap_rate_pct"),
    )


@query
def net_position(t):
    return t.positions.select(
        "item_id", "location", "current_stock", "required_qty",
        stock.net_position().alias("net_position"),
    )


@query
def format_money(t):
    return t.inventory.select(
        "item_id", "location_id", "snapshot_date",
        text.format_money("inventory_value").alias("value_text"),
    )


@query
def parse_number_text(t):
    """Report cells of three kinds read back: money, percent and plain text."""
    money = t.inventory.select(
        F.concat(F.lit("¥"), text.format_money("inventory_value")).alias("cell"))
    percent = t.demand.select(
        F.concat(F.col("gap_rate_pct").cast("decimal(18,1)").cast("string"), F.lit("％"))
        .alias("cell"))
    names = t.items.select(F.col("item_name").alias("cell"))
    cells = money.unionByName(percent).unionByName(names)
    return cells.select(
        "cell", text.parse_number("cell").alias("number_value"),
        text.parse_text("cell").alias("text_value"),
    )


def _summary_rounded(df):
    return rounded(df, 2, "avg_inventory_qty", "avg_inventory_value")


@query
def overstock_alert(t):
    return _summary_rounded(t.alerts)


@query
def latest_month_filter(t):
    return _summary_rounded(marts.latest_month(t.summary))


# ---- duplicates ----------------------------------------------------------------------

@query
def dedupe_orders(t):
    return dedupe(t.feeds.raw_orders, KEYS["orders"])


@query
def dedupe_inventory(t):
    twice = t.feeds.raw_inventory.unionByName(t.feeds.redelivered_inventory)
    return dedupe(twice, KEYS["inventory"])


@query
def dedupe_receipts(t):
    return dedupe(t.feeds.raw_receipts, KEYS["receipts"])


# ---- joins ---------------------------------------------------------------------------

@query
def inventory_summary(t):
    return _summary_rounded(t.summary)


@query
def latest_stock_by_category(t):
    return rounded(analytics.latest_stock_by_category(t.inventory, t.items), 2, "total_value")


@query
def forecast_gap_by_category(t):
    return rounded(
        analytics.forecast_gap_by_category(t.demand, t.items), 2, "avg_gap_rate_pct")


@query
def receipts_from_orders(t):
    return analytics.receipts_with_orders(t.receipts, t.orders)


@query
def supplier_leadtime_named(t):
    return rounded(
        analytics.supplier_leadtime_named(t.receipts, t.feeds.suppliers), 10, "avg_lead_time")


@query
def demand_gap_with_value(t):
    return rounded(analytics.demand_gap_with_value(t.demand, t.summary), 2, "inventory_value")


@query
def surplus_candidates(t):
    return actions.surplus_candidates(t.positions)


# ---- aggregations --------------------------------------------------------------------

@query
def monthly_item_stock(t):
    return _summary_rounded(gold.monthly_item_stock(t.inventory))


@query
def turnover_analysis(t):
    df = rounded(t.analysis, 2, "total_inventory_value")
    return rounded(df, 10, "avg_turnover_rate", "avg_days_on_hand")


@query
def inventory_kpi(t):
    return rounded(marts.inventory_kpi(t.summary), 2, "total_value")


@query
def distinct_item_rollup(t):
    """Distinct items of each month, each category and all long-held stock, from bitmaps stored
    once per month and category."""
    path = new_dir(t.spark, "bitmaps")
    versions.write(distinct.item_bitmaps(t.summary, distinct.numbered(t.items)), path, "month")
    stored = versions.read(t.spark, path)
    month, category = F.lit(None).cast("date").alias("month"), F.lit(None).alias("category")

    def counts(scope, rows, *by):
        found = distinct.distinct_items(rows, *by)
        return found.select(
            F.lit(scope).alias("scope"), "month" if "month" in by else month,
            "category" if "category" in by else category.cast("string").alias("category"),
            "item_count", F.round("total_value", 2).alias("total_value"))

    return (counts("month", stored, "month").unionByName(counts("category", stored, "category"))
            .unionByName(counts("month and category", stored, "month", "category"))
            .unionByName(counts("long held", stored.filter("long_held"))))


@query
def turnover_kpi(t):
    return rounded(marts.turnover_kpi(t.analysis), 8, "avg_turnover")


@query
def overstock_kpi(t):
    return marts.overstock_kpi(t.alerts)


@query
def inventory_trend(t):
    return rounded(marts.inventory_trend(t.summary), 2, "avg_inventory_value")


@query
def category_breakdown(t):
    return rounded(marts.category_breakdown(t.summary), 2, "total_value")


@query
def overstock_category_summary(t):
    return rounded(marts.overstock_category_summary(t.overstock), 2, "total_value")


@query
def widget_inventory_trend(t):
    trend = marts.inventory_trend(t.summary, ordered=False)
    return rounded(marts.widget_inventory_trend(trend), 2, "sum_inventory_value")


@query
def widget_turnover_trend(t):
    trend = marts.turnover_trend(t.analysis, ordered=False)
    return rounded(marts.widget_turnover_trend(trend), 10, "avg_turnover_rate")


@query
def widget_category_value(t):
    breakdown = marts.category_breakdown(t.summary, ordered=False)
    return rounded(marts.widget_category_value(breakdown), 2, "sum_total_value")


@query
def widget_supplier_leadtime(t):
    leadtime = marts.supplier_leadtime(t.receipts)
    return rounded(marts.widget_supplier_leadtime(leadtime), 10, "avg_lead_time")


@query
def widget_counters(t):
    counters = marts.widget_counters(
        marts.inventory_kpi(t.summary), marts.turnover_kpi(t.analysis),
        marts.overstock_kpi(t.alerts),
    )
    return rounded(rounded(counters, 2, "total_value"), 8, "avg_turnover")


@query
def forecast_accuracy_by_category(t):
    return rounded(
        analytics.forecast_accuracy_by_category(t.demand, t.items), 2,
        "avg_forecast_qty", "avg_actual_qty", "gap_rate_pct")


@query
def report_totals(t):
    detail = t.alerts.select(
        "item_id", "item_name", "category", "avg_inventory_qty", "avg_inventory_value",
        "turnover_rate", "days_on_hand",
    )
    return rounded(report.report_totals(detail), 2,
                   "avg_inventory_qty", "avg_inventory_value", "turnover_rate")


# ---- shares and comparisons ----------------------------------------------------------

@query
def category_share(t):
    return rounded(analytics.category_share(t.summary), 2, "total_value")


@query
def overstock_concentration(t):
    return rounded(analytics.overstock_concentration(t.alerts), 10, "avg_days", "avg_days_rest")


@query
def leadtime_vs_rest(t):
    df = rounded(analytics.leadtime_vs_rest(t.receipts, t.items), 8, "diff_pct")
    return rounded(df, 10, "avg_lead_time", "avg_lead_time_rest")


@query
def month_over_month(t):
    return rounded(analytics.month_over_month(t.summary), 2,
                   "total_value", "previous_value", "change_pct")


@query
def turnover_verdict(t):
    return analytics.turnover_by_category(t.analysis)


# ---- sorted reports ------------------------------------------------------------------

@query
def overstock_alerts(t):
    return rounded(marts.overstock_alerts(t.alerts), 2, "avg_inventory_value")


@query
def supplier_leadtime(t):
    return rounded(marts.supplier_leadtime(t.receipts), 10, "avg_lead_time")


@query
def turnover_trend(t):
    return rounded(marts.turnover_trend(t.analysis), 10, "avg_turnover_rate")


@query
def overstock_listing(t):
    return marts.overstock_listing(t.overstock)


@query
def shortage_listing(t):
    return marts.shortage_listing(t.all_positions)


@query
def overstock_top10(t):
    return marts.overstock_worst(t.alerts)


@query
def all_overstock(t):
    return _summary_rounded(t.overstock)


# ---- action rules --------------------------------------------------------------------

@query
def proposal_priority(t):
    return actions.proposal_priority(t.summary)


@query
def emergency_order_trigger(t):
    return rounded(actions.emergency_orders(t.positions, t.items, t.demand), 2,
                   "safety_stock_qty", "stock_share_pct")


@query
def forecast_review_flag(t):
    return actions.forecast_review(t.demand)


@query
def leadtime_feasibility(t):
    return actions.leadtime_feasibility(t.positions)


@query
def replenishment_choice(t):
    return actions.replenishment_choice(t.positions)


@query
def transfer_plan(t):
    return t.transfers


@query
def emergency_order_request(t):
    return actions.emergency_order_requests(t.positions, REQUEST_DATE)


@query
def transfer_request(t):
    return actions.transfer_requests(t.transfers, REQUEST_DATE)


@query
def order_proposals(t):
    return actions.order_proposals(t.summary, t.positions, t.items, t.demand)


@query
def quantitative_basis(t):
    return actions.quantitative_basis(t.summary)


@query
def critical_flag(t):
    return actions.critical_flag(t.summary)


@query
def stock_status(t):
    return actions.stock_status(t.positions)


# ---- generated data, keyed by the tables ---------------------------------------------

def _generated_items(t):
    return datagen.gen_item_master(
        t.feeds.table("part").select(F.col("p_partkey").alias("item_seq")))


def _generated_orders(t):
    keys = t.feeds.table("orders").select(F.col("o_orderkey").alias("order_seq"))
    item_count = t.feeds.table("part").agg(F.count(F.lit(1))).scalar()
    return datagen.gen_orders(keys, _generated_items(t), item_count)


@query
def gen_item_master(t):
    return _generated_items(t)


@query
def gen_orders(t):
    return _generated_orders(t)


@query
def gen_inventory(t):
    return datagen.gen_inventory(_generated_items(t))


@query
def gen_receipts(t):
    return datagen.gen_receipts(_generated_orders(t))


@query
def gen_demand(t):
    return datagen.gen_demand(_generated_items(t))


@query
def sample_n(t):
    orders = t.feeds.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return datagen.sample_n(orders, SAMPLE_ROWS, SAMPLE_SEED, "o_orderkey")


# ---- stored actions ------------------------------------------------------------------

def _action_tables(t):
    """A folder of stored tables that the action tables are made from; its writes do not depend on
    each other, so they run side by side."""
    out = new_dir(t.spark, "tables")

    def feed(name, rows):
        conform(rows, FEEDS[name]).write.parquet(f"{out}/bronze/{name}")

    def summary():
        versions.write(t.summary.withColumn("item_id", F.col("item_id").cast("string")),
                       f"{out}/gold/inventory_summary", "month", layer="gold")

    with ThreadPoolExecutor(4) as pool:
        made = [pool.submit(summary), pool.submit(feed, "item_master", t.items),
                pool.submit(feed, "demand", t.demand),
                pool.submit(stored_actions.store_positions, t.spark, out, t.positions)]
    for table in made:
        table.result()
    return out


@query
def stored_proposals(t):
    """The proposal log of stored tables; a second run finds nothing to add."""
    out = _action_tables(t)
    for _ in range(2):
        log = stored_actions.add_proposals(t.spark, out)
    return log.drop("created_at")


@query
def stored_requests(t):
    """Transfer requests and emergency orders of stored positions."""
    out = new_dir(t.spark, "tables")
    stored_actions.store_positions(t.spark, out, t.positions)
    stored_actions.make_requests(t.spark, out, REQUEST_DATE)
    moves, orders = (versions.read(t.spark, f"{out}/gold/{name}")
                     for name in (stored_actions.TRANSFERS, stored_actions.ORDERS))
    return moves.select(
        F.lit("transfer").alias("kind"), "item_id", "source_location", "target_location",
        F.col("transfer_qty").alias("qty"), "summary").unionByName(
        orders.select(
            F.lit("order").alias("kind"), "item_id",
            F.lit(None).cast("string").alias("source_location"),
            F.col("delivery_location").alias("target_location"),
            F.col("order_qty").alias("qty"), "summary"))


@query
def stored_overstock(t):
    """The overstock list, first of early alerts, then of the months that came later too."""
    out = _action_tables(t)
    # of the stored summary, whose rows are computed once; its item ids are text already
    alerts = gold.overstock_alert(incremental.read_gold(t.spark, out, "inventory_summary"))
    versions.write(alerts.filter(F.col("month") < SECOND_ARRIVAL), f"{out}/gold/overstock_alert",
                   "month", layer="gold")
    stored_actions.update_overstock(t.spark, out)
    versions.write(alerts, f"{out}/gold/overstock_alert", "month")
    stored_actions.store_entries(t.spark, out, literals.overstock_entries(t.spark))
    stored_actions.update_overstock(t.spark, out)
    return _summary_rounded(versions.read(t.spark, f"{out}/gold/{stored_actions.OVERSTOCK}"))


# ---- bucketed tables -----------------------------------------------------------------

def _bucketed(t, store, read):
    """Rows read from bucketed tables in a database of their own, which goes from the catalog."""
    path = new_dir(t.spark, "buckets")
    database = f"stockmill_{path.rsplit('-', 1)[-1]}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{path}/catalog'")
    try:
        store(database, f"{path}/tables")
        return read(t.spark, database)
    finally:  # the tables are external: their folders stay, and the plan is made
        for table in t.spark.catalog.listTables(database):
            kind = "VIEW" if table.tableType == "VIEW" else "TABLE"
            t.spark.sql(f"DROP {kind} {database}.{table.name}")
        t.spark.sql(f"DROP DATABASE {database}")


def _sums(t):
    return incremental.month_sums(t.inventory)


def _buckets(t):
    """Buckets of the monthly tables, which have a row per order line at most."""
    return max(MIN_BUCKETS, bucket_count(t.feeds.line_count))


@query
def colocated_summary(t):
    """``inventory_summary`` by a join of sums and items that lie in the same buckets."""
    return _summary_rounded(_bucketed(
        t, lambda database, path: colocated.store_sums(
            _sums(t), t.items, database, path, _buckets(t)),
        colocated.inventory_summary))


@query
def colocated_item_turnover(t):
    """Means per item over its months: join and grouping use the same buckets."""
    return rounded(_bucketed(
        t, lambda database, path: colocated.store_sums(
            _sums(t), t.items, database, path, _buckets(t)),
        colocated.turnover_by_item), 8, "avg_turnover_rate").withColumn(
        "avg_inventory_value", F.round("avg_inventory_value", 2))


@query
def colocated_demand_gap(t):
    """``demand_gap_with_value`` by a join of demand and summary in the same buckets."""
    return rounded(_bucketed(
        t, lambda database, path: colocated.store_summary(
            t.summary, t.demand, database, path, _buckets(t)),
        colocated.demand_gap_with_value), 2, "inventory_value")


# ---- streams -------------------------------------------------------------------------

@query
def stream_available_now(t):
    """All files that have arrived, in several batches, then stop."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(t.feeds.raw_inventory, root, "inventory")
    medallion.ingest_bronze(t.spark, "inventory", root, out, max_files=4)
    return medallion.read_layer(t.spark, out, "bronze", "inventory").groupBy("location_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("inventory_qty").alias("total_qty"))


def _stream_inventory(t):
    """Silver inventory by streams; some rows are delivered twice, in different files."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(t.feeds.raw_inventory, root, "inventory")
    landing.land(t.feeds.redelivered_inventory, root, "inventory")
    medallion.ingest_bronze(t.spark, "inventory", root, out)
    medallion.refresh_silver(t.spark, "inventory", out)
    return root, out


@query
def stream_dedupe(t):
    _, out = _stream_inventory(t)
    return medallion.read_layer(t.spark, out, "silver", "inventory")


@query
def stream_least_copy(t):
    """Differing copies in either order of arrival; the stream keeps the least, as batch does."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    late = F.pmod(F.xxhash64("location_id", "snapshot_date"), F.lit(2)) == 0  # never NULL

    def copies(more):
        """All rows, with a greater quantity where ``more`` holds."""
        qty = F.col("inventory_qty")
        return t.feeds.raw_inventory.withColumn(
            "inventory_qty", F.when(more, qty + 5).otherwise(qty))

    end = t.spark.createDataFrame(
        [(None, None, 0, 0.0, datetime.date(2200, 1, 1))], FEEDS["inventory"])
    for part in (copies(~late), copies(late), end):
        landing.land(part, root, "inventory")
        medallion.ingest_bronze(t.spark, "inventory", root, out)
        bronze = streams.read_table_stream(t.spark, f"{out}/bronze/inventory", FEEDS["inventory"])
        streams.write_streaming_table(
            streams.dedupe_least(bronze, KEYS["inventory"], "snapshot_date", "36500 days"),
            f"{out}/rows", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/rows")


@query
def stream_quality_gate(t):
    """Violations seen by the stream, and the rows that reached silver."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(t.feeds.landed_orders, root, "orders")
    medallion.ingest_bronze(t.spark, "orders", root, out)
    medallion.refresh_silver(t.spark, "orders", out)
    counts = streams.rule_counts(t.spark, f"{out}/rule_counts").groupBy("measure").agg(
        F.sum("row_count").alias("row_count"))
    kept = medallion.read_layer(t.spark, out, "silver", "orders").agg(
        F.lit("silver_rows").alias("measure"), F.count(F.lit(1)).alias("row_count"))
    return counts.unionByName(kept)


@query
def stream_to_gold(t):
    """Streams fill silver; gold is recomputed from it."""
    root, out = _stream_inventory(t)
    landing.land(t.items, root, "item_master")
    items = landing.read_item_master(t.spark, root)
    return _summary_rounded(medallion.rebuild_gold(t.spark, items, out)["inventory_summary"])


@query
def incremental_gold(t):
    """Three deliveries, each taken through silver into the months of gold that it touches: odd
    months, even months, and late rows of the last months."""
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    landing.land(t.items, root, "item_master")
    items = landing.read_item_master(t.spark, root)
    late = (F.col("location_id") == 0) & (F.col("snapshot_date") >= LATE_FROM)
    odd = F.pmod(F.month("snapshot_date"), F.lit(2)) == 1
    for part in (odd & ~late, ~odd & ~late, late):
        landing.land(t.feeds.raw_inventory.filter(part), root, "inventory")
        medallion.ingest_bronze(t.spark, "inventory", root, out)
        medallion.refresh_silver(t.spark, "inventory", out)
        incremental.update_gold(t.spark, items, out)
    return _summary_rounded(incremental.read_gold(t.spark, out, "inventory_summary"))


@query
def stream_resume(t):
    """Two runs with one checkpoint: the second takes only the files that came later.

    Each run is one batch, which the folder of its rows names.
    """
    root, out = new_dir(t.spark, "landing"), new_dir(t.spark, "tables")
    later = F.col("snapshot_date") >= SECOND_ARRIVAL
    for arrived in (~later, later):
        landing.land(t.feeds.raw_inventory.filter(arrived), root, "inventory")
        bronze = medallion.ingest_bronze(t.spark, "inventory", root, out)
    return t.spark.read.parquet(bronze).select(
        *FEEDS["inventory"].names, (F.col("batch") + 1).alias("ingest_run"))
