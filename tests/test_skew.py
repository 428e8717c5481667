"""Salted joins and the stream that keeps the least copy."""

from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from stockmill.operators import skew
from stockmill.streaming import tables

DAY = "2025-03-31"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_key_with_a_third_of_all_rows_is_spread(spark, how):
    facts = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 100).alias("k"), "id")
    facts = facts.unionByName(spark.range(50).select(F.lit(None).cast("bigint").alias("k"), "id"))
    dimension = spark.range(0, 5000).select((F.col("id") + 100).alias("k"), F.lit("d").alias("v"))
    dimension = dimension.unionByName(spark.createDataFrame([(7, "x"), (7, "y"), (9, "z")],
                                                            "k bigint, v string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        joined = skew.join_spread(facts, dimension, "k", tasks=120, how=how)
        sizes = [r["count"] for r in
                 joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = facts.join(dimension, "k", how)
        plain_sizes = [r["count"] for r in
                       plain.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.exceptAll(plain.select(joined.columns)).count() == 0
        assert joined.count() == plain.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(plain_sizes) > 4 * median(plain_sizes)
    assert max(sizes) <= 2 * median(sizes)


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        skew.join_spread(spark.range(1), spark.range(1), "id", how="right")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_least_copy_in_any_order(spark, fresh, order):
    copies = [[("a", 1, "z"), ("b", 5, "m"), ("c", 2, None)],
              [("a", 1, "y"), ("b", 4, "n"), ("b", 4, "k")],
              [("a", 3, "a"), (None, 1, "q"), ("c", 2, "c")]]
    schema = "item string, qty int, note string, day date"
    got = []
    for turn in [*order, None]:
        rows = [("end", 0, "", date(2030, 1, 1))] if turn is None else [
            (*r, date(2025, 3, 31)) for r in copies[turn]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{fresh}/in")
        stream = tables.read_table_stream(spark, f"{fresh}/in", schema, 1)
        tables.write_streaming_table(
            tables.dedupe_least(stream, ["item", "day"], "day", "30 days"),
            f"{fresh}/t", f"{fresh}/c")
    got = {r.item: (r.qty, r.note) for r in spark.read.schema(schema).parquet(
        f"{fresh}/t").collect()}
    assert got == {"a": (1, "y"), "b": (4, "k"), "c": (2, None), None: (1, "q")}
    with pytest.raises(ValueError):
        tables.dedupe_least(stream, ["item"], "day", "30 days")
