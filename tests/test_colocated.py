"""Bucketed tables: equal rows, no shuffle, replaced at once."""

import uuid

import pytest
from pyspark.sql import functions as F

from stockmill.operators import analytics, colocated as buckets, gold
from stockmill.plans import colocated, incremental

HOT = "7"


@pytest.fixture()
def database(spark, fresh):
    name = f"b_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh}/db'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield name
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture(scope="module")
def facts(spark):
    """Snapshots of 60 items over six months, a third of them of one item, and some odd ones."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, HOT).otherwise((F.col("id") % 60).cast("string")).alias(
            "item_id"),
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("location_id"),
        (F.col("id") % 97).alias("inventory_qty"), (F.col("id") % 89 * 1.5).alias(
            "inventory_value"),
        F.add_months(F.lit("2025-01-31").cast("date"), (F.col("id") / 7 % 6).cast("int")).alias(
            "snapshot_date"))
    odd = spark.createDataFrame([(None, "w", 5, 1.0, None), ("3", None, None, None, None)],
                                "item_id string, location_id string, inventory_qty bigint, "
                                "inventory_value double, snapshot_date date")
    return rows.union(odd)


@pytest.fixture(scope="module")
def items(spark):
    return spark.range(70).select(
        F.col("id").cast("string").alias("item_id"), F.lit("n").alias("item_name"),
        (F.col("id") % 3).cast("string").alias("category"), F.lit("c").alias("category_name"),
        F.lit(2.5).alias("unit_price"))


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                   for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_joins_move_no_rows(spark, fresh, database, facts, items):
    sums = incremental.month_sums(facts)
    colocated.store_sums(sums, items, database, fresh, 4)
    got, want = colocated.inventory_summary(spark, database), gold.inventory_summary(facts, items)
    assert rows_of(got) == rows_of(want)
    per_item = colocated.turnover_by_item(spark, database)
    assert per_item.agg(F.sum("month_count")).first()[0] == want.count()
    demand = want.select("item_id", "month", F.lit(10).alias("forecast_qty"),
                         F.lit(8).alias("actual_qty"), F.lit(25.0).alias("gap_rate_pct")).where(
        "item_id <> '9'")
    colocated.store_summary(want, demand, database, fresh, 4)
    gaps = colocated.demand_gap_with_value(spark, database)
    assert rows_of(gaps) == rows_of(analytics.demand_gap_with_value(demand, want))
    for df in (got, per_item, gaps):
        assert buckets.exchanges(df) == 0, df._jdf.queryExecution().executedPlan().toString()
    assert buckets.exchanges(want) > 0


def test_a_hot_item_fills_no_bucket(facts):
    def share(df):
        told = buckets.largest_bucket(df, colocated.ITEM, 4).first()
        return told.largest / told.median

    assert share(facts) > 2 and share(incremental.month_sums(facts)) < 2


def test_a_new_write_is_shown_at_once(spark, fresh, database, items):
    name = f"{database}.item_master"
    first = buckets.write(items, name, fresh, colocated.ITEM, 2, comment="the item's own")
    buckets.write(items.limit(3), name, fresh, colocated.ITEM, 4)
    assert spark.table(name).count() == 3
    assert first.count() == 70  # a reader of the version before still has it
    assert len(buckets.drop_old(spark, name)) == 1
    assert spark.table(name).count() == 3 and buckets.drop_old(spark, name) == []
    # a table may be computed from itself
    again = buckets.write(spark.table(name).union(items.where("item_id = '69'")), name, fresh,
                          colocated.ITEM, 4)
    assert again.count() == 4


def test_empty_tables(spark, fresh, database, facts, items):
    colocated.store_sums(incremental.month_sums(facts.limit(0)), items.limit(0), database, fresh)
    assert colocated.inventory_summary(spark, database).collect() == []


@pytest.mark.parametrize("rows, count", [
    (0, 1), (1, 1), (2_000_000, 1), (2_000_001, 2), (9_000_000, 8), (10 ** 12, 524_288)])
def test_bucket_counts_are_powers_of_two(rows, count):
    assert buckets.bucket_count(rows) == count
