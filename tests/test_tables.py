"""Sinks, generated data, reports and plan shapes."""

import pytest
from pyspark.sql import functions as F

from stockmill.operators import datagen, gold, marts, report, sinks
from stockmill.plans import generate
from stockmill.plans.registry import QUERIES
from stockmill.plans.tables import Tables
from stockmill.schemas import OVERSTOCK_ENTRIES
from stockmill.session import new_dir, shared_dir
from stockmill.sources.literals import overstock_entries


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_table_keeps_types_and_comments(spark, fresh):
    got = sinks.create_or_replace_table(
        overstock_entries(spark), OVERSTOCK_ENTRIES, fresh, name="overstock_entries_t",
        comment="hand-entered rows")
    assert got.count() == 18
    stored = {r.col_name: (r.data_type, r.comment)
              for r in spark.sql("DESCRIBE overstock_entries_t").collect()}
    assert stored["turnover_rate"] == ("double", "stock turnover")
    sinks.create_or_replace_table(overstock_entries(spark).limit(3), OVERSTOCK_ENTRIES, fresh,
                                  name="overstock_entries_t")
    assert spark.table("overstock_entries_t").count() == 3
    spark.sql("DROP TABLE overstock_entries_t")


def test_materialized_view_is_replaced_and_tagged(spark, fresh):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("month"))
    sinks.write_materialized_view(rows, fresh, name="view_t", comment="c", cluster_by="month")
    again = sinks.write_materialized_view(rows.filter("id < 40"), fresh, name="view_t")
    assert again.count() == 40 and spark.table("view_t").count() == 40
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES view_t").collect()}
    assert properties["quality"] == "gold"
    spark.sql("DROP TABLE view_t")


def test_proposal_log_appends(spark, fresh, sf_dir):
    t = Tables(spark, sf_dir)
    from stockmill.operators.actions import order_proposals

    rows = order_proposals(t.summary, t.positions, t.items, t.demand).cache()
    sinks.append_order_proposals(rows, fresh)
    log = sinks.append_order_proposals(rows, fresh)
    assert log.count() == 2 * rows.count()
    assert log.filter("created_at IS NULL").count() == 0
    assert rows.select("proposal_id").distinct().count() == rows.count()


def test_csv_export_has_a_header(spark, fresh):
    sinks.export_csv(overstock_entries(spark), fresh)
    back = spark.read.option("header", True).csv(fresh)
    assert back.columns == OVERSTOCK_ENTRIES.names and back.count() == 18


def test_report_totals(spark):
    df = spark.createDataFrame(
        [("a", "x", "g", 10.0, 2, None), ("b", "y", "h", 5.5, 3, "n")],
        "item_id string, item_name string, category string, avg_inventory_value double, "
        "days_on_hand long, note string")
    rows = report.report_totals(df).collect()
    total = [r for r in rows if r.row_kind == "total"]
    assert len(rows) == 3 and len(total) == 1
    assert tuple(total[0])[:6] == ("合 計", None, "—", 15.5, 5, "—")


def test_demo_category_summary(spark):
    got = {r.category_name: (r.item_rows, r.total_value)
           for r in marts.overstock_category_summary(overstock_entries(spark)).collect()}
    assert got["電子部品"][0] == 15 and got["機械部品"] == (2, 6_225_000.0)


def test_shares_sum_to_hundred(spark, sf_dir):
    rows = QUERIES["category_share"](spark, sf_dir).collect()
    assert abs(sum(r.share_pct for r in rows) - 100) < 0.5
    rows = QUERIES["overstock_concentration"](spark, sf_dir).collect()
    assert abs(sum(r.item_share_pct for r in rows) - 100) < 0.5


@pytest.fixture(scope="module")
def feeds(spark):
    return {k: v.cache() for k, v in generate.generated_feeds(spark).items()}


def test_generated_items(feeds):
    items = feeds["item_master"]
    got = {r.category: r["count"] for r in items.groupBy("category").count().collect()}
    assert got == {"A": 150, "B": 120, "C": 130, "D": 100}
    assert items.filter("category = 'B' AND lead_time_days < 30").count() == 0
    assert items.filter("unit_price NOT BETWEEN 50 AND 8000").count() == 0
    assert {r.safety_stock_days for r in items.select("safety_stock_days").distinct().collect()} \
        == {7, 14, 21, 30}
    assert items.select("item_id").distinct().count() == 500
    first = items.filter("item_id = 'ITM-0151'").first()
    assert (first.category, first.item_name) == ("B", "電子部品_A01")


def test_generated_orders_and_receipts(feeds):
    orders, receipts = feeds["orders"], feeds["receipts"]
    assert orders.count() == 10_000
    delivered = orders.filter("status = 'delivered'").count()
    assert 5800 < delivered < 6200 and receipts.count() == delivered
    late = receipts.join(orders, "order_id").select(
        F.date_diff("receipt_date", "expected_delivery_date").alias("d"),
        (F.col("receipt_qty") / F.col("order_qty")).alias("r"))
    low = late.agg(F.min("d"), F.max("d"), F.min("r"), F.max("r")).first()
    assert tuple(low)[:2] == (-2, 7) and low[2] > 0.9 and low[3] <= 1.05
    assert receipts.filter("quality_status = 'passed'").count() / delivered > 0.75


def test_generated_inventory_and_demand(feeds):
    stock, demand = feeds["inventory"], feeds["demand"]
    assert 9_000 < stock.count() < 12_000
    assert stock.select("snapshot_date").distinct().count() == 12
    assert stock.count() == stock.select("item_id", "location_id", "snapshot_date").distinct().count()
    assert 4_500 < demand.count() < 5_500
    newest, gaps = generate.feed_summaries(feeds)
    gap = {r.category: r.avg_gap_rate_pct for r in gaps.collect()}
    assert gap["B"] > 80 and max(gap["A"], gap["C"], gap["D"]) < 10
    assert newest.count() == 4


def test_generation_repeats(spark, feeds):
    again = generate.generated_feeds(spark)["orders"].repartition(3)
    assert again.exceptAll(feeds["orders"]).count() == 0


def test_sample_n(spark):
    rows = spark.range(1000)
    once = {r.id for r in datagen.sample_n(rows, 50, 1, "id").collect()}
    same = {r.id for r in datagen.sample_n(rows.repartition(9), 50, 1, "id").collect()}
    other = {r.id for r in datagen.sample_n(rows, 50, 2, "id").collect()}
    assert len(once) == 50 and once == same and once != other


def test_plans_stay_in_the_jvm(spark, sf_dir):
    lazy = [n for n in QUERIES if not n.startswith(("ingest", "write", "stream", "append",
                                                    "create", "export"))]
    for name in lazy:
        plan = physical(QUERIES[name](spark, sf_dir))
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = physical(QUERIES["overstock_alerts"](spark, sf_dir))
    scan = [line for line in plan.splitlines() if "l_partkey" in line and "ReadSchema" in line]
    assert scan and all("l_extendedprice" not in line for line in scan)


def test_filter_reaches_stored_summary(spark, sf_dir, fresh):
    t = Tables(spark, sf_dir)
    stored = sinks.write_materialized_view(t.summary, fresh, cluster_by="month")
    plan = physical(marts.overstock_kpi(gold.overstock_alert(stored)))
    assert "LessThan(turnover_rate,4.0)" in plan and "GreaterThanOrEqual(days_on_hand,90)" in plan


def test_item_with_a_third_of_all_snapshots(spark):
    """A hot item is combined before the shuffle and meets the join once per month."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").alias("item_id"),
        F.col("id").cast("string").alias("location_id"), (F.col("id") % 10).alias("inventory_qty"),
        F.lit(1.0).alias("inventory_value"), F.lit("2025-03-31").cast("date").alias("snapshot_date"))
    items = rows.select("item_id").distinct().withColumns(
        {"item_name": F.lit("n"), "category": F.lit("A"), "category_name": F.lit("a"),
         "unit_price": F.lit(1.0)})
    got = gold.inventory_summary(rows, items)
    assert got.count() == 20_001 and "partial_avg" in physical(got)
    assert got.filter("item_id = '0'").first().avg_inventory_qty == 4.5


class _Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})


def test_shared_dir_is_the_session_setting():
    assert shared_dir(_Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert new_dir(_Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn"))
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_failed_write_leaves_the_old_table(spark, fresh):
    path = f"{fresh}/t"
    sinks.write_materialized_view(spark.range(5), path)
    bad = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(
        F.raise_error(F.lit("stop")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_materialized_view(bad, path)
    assert spark.read.parquet(path).count() == 5
    doubled = spark.read.parquet(path).union(spark.read.parquet(path))
    assert sinks.write_materialized_view(doubled, path).count() == 10


def test_two_column_report(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "name string, total_qty long")
    total = report.report_totals(df).filter("row_kind = 'total'").first()
    assert total.total_qty == 5
