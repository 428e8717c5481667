from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation, functions as F

from stockmill.operators import quality
from stockmill.operators.dedupe import KEYS, dedupe
from stockmill.operators.silver import checked, silver_orders

ORDERS = ("order_id string, item_id string, supplier_id string, order_qty long, unit_price double,"
          "order_amount double, order_date date, expected_delivery_date date, status string")
DAY = date(2025, 3, 1)


def orders(spark, *rows):
    full = [(k, "i", "s", qty, 1.0, amount, day, DAY, "pending") for k, qty, amount, day in rows]
    return spark.createDataFrame(full, ORDERS)


def test_fail_rule_stops_the_job(spark):
    df = orders(spark, ("1", 1, 1.0, DAY), (None, 1, 1.0, DAY))
    with pytest.raises(PySparkException, match="pk_not_null"):
        silver_orders(df).count()


def test_fail_rule_survives_column_pruning(spark):
    df = orders(spark, (None, 1, 1.0, DAY))
    with pytest.raises(PySparkException, match="pk_not_null"):
        quality.expect_or_fail(df, quality.EXPECTATIONS["orders"]).select("item_id").collect()


def test_drop_warn_and_null(spark):
    df = orders(spark, ("1", 1, 1.0, DAY), ("2", 0, 1.0, DAY), ("3", None, 1.0, DAY),
                ("4", 1, -1.0, DAY), ("5", 1, 1.0, None))
    seen = Observation("orders")
    kept = {r.order_id for r in checked(df, "orders", seen).collect()}
    assert kept == {"1", "5"}
    assert seen.get == {"total_rows": 5, "valid_qty": 2, "valid_amount": 1, "valid_date": 1}


def test_violation_counts_and_pass_rate(spark):
    df = orders(spark, ("1", 1, 1.0, DAY), ("2", 0, 1.0, None), ("3", 1, 1.0, DAY),
                ("4", 1, 1.0, DAY))
    rules = quality.EXPECTATIONS["orders"]
    got = {r.expectation: r.violations for r in
           quality.violation_counts(df, "orders", rules).collect()}
    assert got == {"pk_not_null": 0, "valid_qty": 1, "valid_amount": 0, "valid_date": 1}
    assert quality.pass_rate(df, "orders", rules).first().pass_rate_pct == 75.0


def test_bad_copy_does_not_displace_good_one(spark):
    df = orders(spark, ("1", 0, 1.0, DAY), ("1", 5, 1.0, DAY))
    assert [r.order_qty for r in silver_orders(df).collect()] == [5]


def test_malformed_text_becomes_null(spark):
    df = orders(spark, ("1", 5, 1.0, DAY)).withColumns(
        {"order_date": F.lit("not a day"), "order_qty": F.lit("7")})
    row = silver_orders(df).first()
    assert (row.order_date, row.order_qty) == (None, 7)


def test_layer_row_counts(spark):
    a, b = spark.range(3), spark.range(4)
    got = {r.layer: (r.table_count, r.row_count)
           for r in quality.layer_row_counts([("x", "a", a), ("x", "b", b), ("y", "c", a)]).collect()}
    assert got == {"x": (2, 7), "y": (1, 3)}


def test_dedupe_is_idempotent_and_order_free(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 700).alias("k"), F.md5(F.col("id").cast("string")).alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("b"))
    once = dedupe(rows, ["k"])
    expect = sorted(once.collect())
    assert len(expect) == 700
    assert sorted(dedupe(once, ["k"]).collect()) == expect
    assert sorted(dedupe(rows.repartition(7, "a"), ["k"]).collect()) == expect


def test_dedupe_null_keys_count_as_one(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, v long")
    assert sorted(dedupe(df, ["k"]).collect(), key=str) == [("a", 3), (None, 1)]


def test_dedupe_hot_key_combines_before_the_shuffle(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("order_id"),
        F.col("id").alias("v"))
    df = dedupe(rows, KEYS["orders"])
    assert df.count() == 20001
    assert df.filter("order_id = -1").first().v == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
