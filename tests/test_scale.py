"""The plans beyond broadcast size, and with one key holding a third of the rows."""

import pytest
from pyspark.sql import functions as F

import compare
from stockmill.plans.oracle import ORACLE
from stockmill.plans.registry import QUERIES

CORE = ["inventory_summary", "silver_orders", "receipt_delay", "expected_delivery_date",
        "supplier_leadtime_named", "leadtime_vs_rest", "demand_gap_with_value",
        "emergency_order_trigger", "surplus_candidates", "replenishment_choice",
        "transfer_plan", "emergency_order_request", "order_proposals", "category_breakdown"]


@pytest.fixture()
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    """Test tables with one item, one supplier and one order line very frequent."""
    target = tmp_path_factory.mktemp("skewed")
    con = compare.connect(sf_dir)
    for name in compare.TABLES:
        rows = f"SELECT * FROM {name}"
        if name == "lineitem":
            rows += """ UNION ALL SELECT * REPLACE (CAST(7 AS BIGINT) AS l_partkey,
                                                    CAST(3 AS BIGINT) AS l_suppkey) FROM lineitem
                        UNION ALL SELECT l.* FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 1) l,
                                                  range(6000)"""
        con.execute(f"COPY ({rows}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.mark.parametrize("name", CORE)
def test_without_broadcast_on_skewed_tables(spark, skewed_dir, no_broadcast, name):
    df = QUERIES[name](spark, skewed_dir)
    actual = compare.spark_rows(df)
    expected = compare.sql_rows(compare.connect(skewed_dir), ORACLE[name])
    assert compare.difference(actual, expected) == ""
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_skewed_join_is_split(spark, no_broadcast):
    facts = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("item_id"),
        F.md5(F.col("id").cast("string")).alias("order_id"))
    items = spark.range(5000).select(F.col("id").alias("item_id"), F.lit(1).alias("lead"))
    df = facts.repartition(8).join(items, "item_id").select("order_id", "lead")
    assert len(df.collect()) == 400_000
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
