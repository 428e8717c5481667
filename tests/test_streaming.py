import os
from datetime import date
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stockmill.operators.silver import silver_inventory
from stockmill.plans import generate, medallion
from stockmill.schemas import FEEDS
from stockmill.session import STATE_SETTINGS
from stockmill.sources import landing
from stockmill.streaming import tables

DAY = date(2025, 3, 31)


def stock_rows(spark, n, copies=1):
    return spark.range(n * copies).select(
        (F.col("id") % n).cast("string").alias("item_id"), F.lit("w").alias("location_id"),
        (F.col("id") % n).alias("inventory_qty"), F.lit(1.0).alias("inventory_value"),
        F.lit(DAY).alias("snapshot_date"))


def test_files_arrive_in_several_batches(spark, fresh):
    landing.land(stock_rows(spark, 90).repartition(6), fresh, "inventory")
    stream = tables.read_landing_stream(spark, fresh, "inventory", max_files=2)
    query = tables.write_streaming_table(stream, f"{fresh}/t", f"{fresh}/c")
    assert len([p for p in query.recentProgress if p.numInputRows > 0]) == 3
    assert spark.read.parquet(f"{fresh}/t").count() == 90


def test_second_run_takes_only_new_files(spark, fresh):
    out = f"{fresh}/out"
    landing.land(stock_rows(spark, 50), fresh, "inventory")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    assert medallion.read_layer(spark, out, "bronze", "inventory").count() == 50
    landing.land(stock_rows(spark, 7), fresh, "inventory")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    assert medallion.read_layer(spark, out, "bronze", "inventory").count() == 57


@pytest.mark.parametrize("options", [{}, {"collapse": False}, {"watermark": ("snapshot_date", "1 day")}])
def test_dedupe_across_batches(spark, fresh, options):
    rows = stock_rows(spark, 200, copies=3)
    landing.land(rows.repartition(5), fresh, "inventory")
    landing.land(rows.repartition(3), fresh, "inventory")
    stream = tables.read_landing_stream(spark, fresh, "inventory", max_files=3)
    unique = tables.dedupe_stream(stream, ["item_id", "location_id", "snapshot_date"], **options)
    tables.write_streaming_table(unique, f"{fresh}/t", f"{fresh}/c")
    assert spark.read.parquet(f"{fresh}/t").count() == 200


def test_hot_key_stream(spark, fresh):
    """One key holds a third of the rows; every other row must survive."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("item_id"),
        F.lit("w").alias("location_id"), F.lit(5).cast("long").alias("inventory_qty"),
        F.lit(1.0).alias("inventory_value"), F.lit(DAY).alias("snapshot_date"))
    landing.land(rows.repartition(6), fresh, "inventory")
    out = f"{fresh}/out"
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out, max_files=2)
    got = medallion.read_layer(spark, out, "silver", "inventory")
    assert got.count() == 6001
    assert got.filter("item_id = 'hot'").count() == 1


def test_copies_collapse_before_the_shuffle(spark):
    rows = spark.createDataFrame(
        [("a", None, 1), ("a", None, 2), (None, 1, 3), (None, 1, 4), ("b", 1, 5)],
        "k string, l int, v int").coalesce(1)
    got = sorted(tables.collapse_copies(rows, ["k", "l"]).collect(), key=str)
    assert [r.v for r in got] == [1, 5, 3]
    assert tables.collapse_copies(rows.filter("v > 9"), ["k", "l"]).count() == 0


def test_gate_counts_over_batches(spark, fresh):
    rows = stock_rows(spark, 100).withColumn(
        "inventory_qty", F.when(F.col("inventory_qty") < 10, -1).otherwise(F.col("inventory_qty")))
    landing.land(rows.repartition(4), fresh, "inventory")
    out = f"{fresh}/out"
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out, max_files=1)
    stored = tables.rule_counts(spark, f"{out}/rule_counts")
    assert stored.select("batch").distinct().count() == 4
    totals = {r.measure: r.n for r in
              stored.groupBy("measure").agg(F.sum("row_count").alias("n")).collect()}
    assert totals == {"total_rows": 100, "valid_qty": 10, "valid_value": 0, "has_item": 0}
    assert medallion.read_layer(spark, out, "silver", "inventory").count() == 90


def test_fail_rule_stops_the_stream(spark, fresh):
    bad = spark.createDataFrame([(None, "o", "i", "s", 1, DAY, 1, "passed")], FEEDS["receipts"])
    landing.land(bad, fresh, "receipts")
    out = f"{fresh}/out"
    medallion.ingest_bronze(spark, "receipts", fresh, out)
    with pytest.raises(PySparkException, match="pk_not_null"):
        medallion.refresh_silver(spark, "receipts", out)


def test_stream_equals_batch(spark, fresh):
    feeds = generate.generated_feeds(spark, items=40, orders=100)
    landing.land(feeds["inventory"], fresh, "inventory")
    landing.land(feeds["inventory"].limit(50), fresh, "inventory")
    out = f"{fresh}/out"
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out)
    bronze = medallion.read_layer(spark, out, "bronze", "inventory")
    stream = medallion.read_layer(spark, out, "silver", "inventory")
    assert sorted(stream.collect()) == sorted(silver_inventory(bronze).collect())


def test_whole_pipeline_on_generated_feeds(spark, fresh):
    spark.conf.set(landing.LANDING_PATH, f"{fresh}/landing")
    try:
        generate.generate_landing(spark, f"{fresh}/landing", items=60, orders=400)
        gold = medallion.run_pipeline(spark, f"{fresh}/out")
    finally:
        spark.conf.unset(landing.LANDING_PATH)
    summary = gold["inventory_summary"]
    assert summary.count() > 60
    assert summary.count() == summary.select("item_id", "month").distinct().count()
    assert gold["overstock_alert"].filter("turnover_rate >= 4.0").count() == 0
    assert medallion.read_layer(spark, f"{fresh}/out", "silver", "orders").count() == 400


def test_landing_path_default(spark):
    assert landing.landing_path(spark) == landing.DEFAULT_LANDING_PATH


def test_command_line(spark, fresh, capsys):
    from stockmill.__main__ import main

    main(["generate", "--landing", f"{fresh}/in", "--items", "30", "--orders", "60"], spark)
    main(["update", "--landing", f"{fresh}/in", "--out", f"{fresh}/out", "--database", "stock_t",
          "--watermark", "inventory:snapshot_date:400 days"], spark)
    main(["report", "--out", f"{fresh}/out"], spark)
    shown = capsys.readouterr().out
    assert "avg_gap_rate_pct" in shown and "overstock_count" in shown and "SUP-" in shown
    assert "pass_rate_pct" in shown and "bronze" in shown
    try:
        tags = {r.key: r.value
                for r in spark.sql("SHOW TBLPROPERTIES stock_t.raw_orders").collect()}
        assert tags["quality"] == "bronze"
        assert spark.table("stock_t.orders").count() == 60
        assert len(spark.catalog.listTables("stock_t")) == 11
    finally:
        spark.sql("DROP DATABASE stock_t CASCADE")


def test_malformed_rows_are_kept_and_judged(spark, fresh):
    lines = ["item_id,location_id,inventory_qty,inventory_value,snapshot_date",
             "a,w,5,1.5,2025-03-31", "b,w,many,1.5,2025-03-31", "c,w,7"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(
        f"{fresh}/inventory")
    out = f"{fresh}/out"
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out)
    bronze = {r.item_id: r for r in spark.read.parquet(f"{out}/bronze/inventory").collect()}
    assert bronze["a"]._corrupt_record is None
    assert bronze["b"].inventory_qty is None and "many" in bronze["b"]._corrupt_record
    assert bronze["c"].inventory_qty == 7 and bronze["c"].inventory_value is None
    silver = medallion.read_layer(spark, out, "silver", "inventory")
    assert [r.item_id for r in silver.collect()] == ["a"]


def write_lines(spark, path, *lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode(
        "append").text(path)


def test_columns_are_taken_by_header(spark, fresh):
    """Files with their columns in other orders, one column missing, one unknown."""
    folder, out = f"{fresh}/inventory", f"{fresh}/out"
    write_lines(spark, folder, "item_id,location_id,inventory_qty,inventory_value,snapshot_date",
                "a,TOKYO,5,1.5,2025-03-31")
    write_lines(spark, folder, "location_id,snapshot_date,item_id,inventory_value,inventory_qty",
                "OSAKA,2025-03-31,b,2.5,6", "KYOTO,bad date,c,2.5,6")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    write_lines(spark, folder, "colour,item_id,location_id,inventory_qty,snapshot_date",
                "red,d,NARA,7,2025-03-31")
    with pytest.warns(UserWarning, match="colour"):
        medallion.ingest_bronze(spark, "inventory", fresh, out)
    got = {r.item_id: r for r in spark.read.parquet(f"{out}/bronze/inventory").collect()}
    assert {k: (r.location_id, r.inventory_qty, r.inventory_value) for k, r in got.items()} == {
        "a": ("TOKYO", 5, 1.5), "b": ("OSAKA", 6, 2.5), "c": ("KYOTO", 6, 2.5),
        "d": ("NARA", 7, None)}
    assert got["c"].snapshot_date is None and "bad date" in got["c"]._corrupt_record
    batch = landing.read_csv(spark, folder, FEEDS["inventory"], keep_malformed=True).collect()
    assert sorted((r.item_id, r.location_id) for r in batch) == [
        ("a", "TOKYO"), ("b", "OSAKA"), ("c", "KYOTO"), ("d", "NARA")]
    assert sum(r._corrupt_record is not None for r in batch) == 1


def test_watermark_lets_old_keys_leave(spark, fresh):
    out = f"{fresh}/out"
    for day in ("2025-01-31", "2025-06-30", "2025-12-31"):
        landing.land(stock_rows(spark, 40).withColumn("snapshot_date", F.lit(day).cast("date")),
                     fresh, "inventory")
        medallion.ingest_bronze(spark, "inventory", fresh, out)
        done = medallion.refresh_silver(spark, "inventory", out,
                                        watermark=("snapshot_date", "31 days"))
    assert medallion.read_layer(spark, out, "silver", "inventory").count() == 120
    held = [s.numRowsTotal for p in done.recentProgress for s in p.stateOperators]
    assert held[-1] < 120


@pytest.mark.parametrize("seconds", [0, -3600, -30 * 86400])
def test_late_files_with_old_times_are_taken(spark, fresh, seconds):
    """Moved or copied files keep times equal to or older than those of files already taken."""
    out, header = f"{fresh}/out", "item_id,location_id,inventory_qty,inventory_value,snapshot_date"
    folder = Path(fresh, "inventory")
    folder.mkdir(parents=True)
    now = 1_750_000_000
    for run, name in enumerate(("first.csv", "late one%20.csv")):
        (folder / name).write_text(f"{header}\ni{run},w,5,1.5,2025-03-31\n")
        os.utime(folder / name, (now + run * seconds,) * 2)
        medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    got = spark.read.parquet(f"{out}/bronze/inventory").collect()
    assert sorted((r.item_id, r.inventory_qty) for r in got) == [("i0", 5), ("i1", 5)]
    assert spark.read.parquet(f"{out}/checkpoints/headers_inventory").count() == 2


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
ON_HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def plain_session(spark):
    """A session that has chosen nothing about state."""
    plain = spark.newSession()
    for key in STATE_SETTINGS:
        plain.conf.unset(key)
    return plain


def keep_new(session, path):
    """The keys that a deduplicating stream has let through, and whether its state is on disk."""
    stream = tables.read_table_stream(session, f"{path}/in", "k bigint, day date")
    query = tables.write_streaming_table(
        tables.dedupe_stream(stream, ["k"]), f"{path}/t", f"{path}/c")
    metrics = query.lastProgress.stateOperators[0].customMetrics
    return (sorted(r.k for r in session.read.parquet(f"{path}/t").collect()),
            any(m.startswith("rocksdb") for m in metrics))


def test_state_lies_on_disk_in_any_session(spark, fresh):
    spark.range(50).selectExpr("id AS k", "current_date() AS day").write.parquet(f"{fresh}/in")
    plain = plain_session(spark)
    assert keep_new(plain, fresh) == (list(range(50)), True)
    assert {k: plain.conf.get(k) for k in STATE_SETTINGS} == STATE_SETTINGS
    least = tables.write_streaming_table(tables.dedupe_least(tables.read_table_stream(
        plain_session(spark), f"{fresh}/in", "k bigint, day date"), ["k", "day"], "day", "9 days"),
        f"{fresh}/least", f"{fresh}/least_c")
    assert "rocksdbGetCount" in least.lastProgress.stateOperators[0].customMetrics


@pytest.mark.parametrize("key, value, on_disk", [(PROVIDER, ON_HEAP, False),
                                                 (CHANGELOG, "true", True)])
def test_old_checkpoints_and_own_choices_hold(spark, fresh, key, value, on_disk):
    """What a session chose holds; its checkpoint goes on where a later session chose nothing."""
    rows = spark.range(50).selectExpr("id AS k", "current_date() AS day")
    rows.write.parquet(f"{fresh}/in")
    first = plain_session(spark)
    first.conf.set(key, value)
    assert keep_new(first, fresh) == (list(range(50)), on_disk)
    assert first.conf.get(key) == value
    rows.selectExpr("k + 25 AS k", "day").write.mode("append").parquet(f"{fresh}/in")
    assert keep_new(plain_session(spark), fresh) == (list(range(75)), on_disk)
