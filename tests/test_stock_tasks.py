"""Stock is worked on in tasks that do not grow with the tables."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from stockmill.operators import colocated as buckets, gold
from stockmill.operators.silver import silver_inventory
from stockmill.plans import incremental
from stockmill.plans.registry import QUERIES
from stockmill.plans.tables import Tables
from stockmill.schemas import FEEDS, conform
from stockmill.sources import feeds


def store(spark, folder, lines):
    """Tables of ``lines`` order lines: one item has a third of them, each tenth comes twice and
    some have no item, supplier, quantity or date."""
    rows = spark.range(lines).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 41 != 0, F.col("id") % (lines // 4))
        .alias("l_partkey"),
        F.when(F.col("id") % 43 != 0, F.col("id") % 5).alias("l_suppkey"),
        F.when(F.col("id") % 47 != 0, (F.col("id") % 50).cast("double")).alias("l_quantity"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
        F.when(F.col("id") % 53 != 0, F.date_add(
            F.lit(datetime.date(2000, 1, 1)), (F.col("id") % 700).cast("int"))).alias("l_shipdate"))
    rows.union(rows.where("l_quantity % 10 = 3")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(lines // 4).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"),
        F.concat(F.lit("kind "), F.col("id") % 3).alias("p_type"),
        (F.col("id") % 90 + 0.5).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    spark.range(5).select(F.col("id").alias("s_suppkey"), F.col("id").alias("s_nationkey"),
                          F.lit("s").alias("s_name")).write.parquet(f"{folder}/supplier.parquet")
    spark.range(5).select(F.col("id").alias("n_nationkey"), (F.col("id") % 2).alias("n_regionkey")
                          ).write.parquet(f"{folder}/nation.parquet")
    return Tables(spark, folder)


def largest_task(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_do_not_grow_with_the_tables(spark, fresh, monkeypatch):
    monkeypatch.setattr(feeds, "LINES_PER_TASK", 400, raising=False)
    few, many = (largest_task(store(spark, f"{fresh}/{n}", n).inventory) for n in (4_000, 32_000))
    assert few <= 800
    assert many <= 800


@pytest.mark.parametrize("name", [
    "colocated_summary", "colocated_item_turnover", "colocated_demand_gap"])
def test_buckets_do_not_grow_with_the_tables(spark, fresh, monkeypatch, name):
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 500)
    made = []
    monkeypatch.setattr(buckets, "write", lambda df, table, path, by, count, write=buckets.write: (
        made.append(buckets.largest_bucket(df, by, count).first().largest),
        write(df, table, path, by, count))[1])
    store(spark, fresh, 16_000)
    assert QUERIES[name](spark, fresh).count() > 0
    assert len(made) == 2
    assert max(made) <= 1_000


def test_rows_are_those_of_the_feed(spark, fresh):
    tables = store(spark, fresh, 3_000)
    want = silver_inventory(tables.feeds.raw_inventory).collect()
    assert want
    assert sorted(tables.inventory.collect(), key=repr) == sorted(want, key=repr)


def test_alerts_come_from_the_stored_summary(spark, fresh, monkeypatch):
    store(spark, fresh, 3_000)
    read = []

    def alert(summary, make=gold.overstock_alert):
        read.extend(summary.inputFiles())
        return make(summary)

    monkeypatch.setattr(gold, "overstock_alert", alert)
    assert QUERIES["stored_overstock"](spark, fresh).where("source = 'pipeline'").count() > 0
    assert read
    assert all("/gold/inventory_summary/" in f for f in read)


def test_analysis_and_alerts_are_made_side_by_side(spark, fresh, monkeypatch):
    tables, out = store(spark, f"{fresh}/in", 1_000), f"{fresh}/out"
    conform(tables.inventory, FEEDS["inventory"]).write.parquet(f"{out}/silver/inventory")
    items = conform(tables.items, FEEDS["item_master"])
    both = threading.Barrier(2, timeout=60)
    for name in ("turnover_analysis", "overstock_alert"):
        monkeypatch.setattr(gold, name, lambda summary, make=getattr(gold, name): (
            both.wait(), make(summary))[1])
    changed = incremental.update_gold(spark, items, out)
    monkeypatch.undo()
    assert changed
    for name in ("turnover_analysis", "overstock_alert"):
        want = getattr(gold, name)(incremental.read_gold(spark, out, "inventory_summary"))
        found = incremental.read_gold(spark, out, name)
        assert found.count() == want.count() > 0
