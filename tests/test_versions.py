"""Versioned tables, incremental gold and mergeable distinct counts."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockmill.operators import distinct, gold, marts, versions
from stockmill.operators.silver import silver_inventory
from stockmill.plans import incremental, medallion
from stockmill.schemas import FEEDS, OVERSTOCK_ENTRIES, conform
from stockmill.sources import landing
from stockmill.sources.literals import overstock_entries
from stockmill.streaming import tables


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_follow_each_other(spark, fresh):
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("part"))
    versions.write(rows, fresh, "part", layer="gold", comment="numbers")
    versions.write(rows.where("part = 2").selectExpr("id + 1000 AS id", "part"), fresh, "part",
                   touched=["2", "3"])
    want = [i for i in range(100) if i % 4 < 2] + [i + 1000 for i in range(100) if i % 4 == 2]
    assert ids(versions.read(spark, fresh)) == sorted(want)
    assert ids(versions.read(spark, fresh, version=1)) == list(range(100))
    assert versions.row_count(spark, fresh) == 75
    newest = versions.newest_part(spark, fresh)
    assert ids(newest) == [i + 1000 for i in range(100) if i % 4 == 2]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "part=2" in plan and "part=0" not in plan
    assert versions.manifest(spark, fresh)["layer"] == "gold"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{fresh}/none")


def test_odd_part_names_and_empty_tables(spark, fresh):
    rows = spark.createDataFrame(
        [("a b", 1), ("x/y", 2), ("50%", 3), (None, 4), ("k=v:[1]", 5)], "part string, id int")
    versions.write(rows, fresh, "part")
    assert ids(versions.read(spark, fresh)) == [1, 2, 3, 4, 5]
    assert ids(versions.read(spark, fresh, parts=["x/y", "k=v:[1]"])) == [2, 5]
    versions.write(rows.limit(0), fresh, "part")
    assert versions.read(spark, fresh).count() == 0 and versions.row_count(spark, fresh) == 0


@pytest.mark.parametrize("part", ["2025-03-01", "a b", "x}y", "k=v:[1]", "50%", "é", None])
def test_a_part_written_alone_is_read_by_name(spark, fresh, part):
    rows = spark.createDataFrame([("0", 1), ("1", 2)], "part string, id int")
    versions.write(rows, fresh, "part")
    versions.write(spark.createDataFrame([(part, 3)], "part string, id int"), fresh, "part",
                   touched=["1"])
    name = part or "none"
    assert sorted(versions.manifest(spark, fresh)["parts"]) == sorted(["0", name])
    alone = versions.read(spark, fresh, parts=[name])
    assert [(r.part, r.id) for r in alone.collect()] == [(part, 3)]
    roots = versions._roots(versions.manifest(spark, fresh)["parts"].values())
    assert [r.rsplit("=", 1)[-1] for r in roots if "_part=0" not in r] == [
        versions._escaped(name).rsplit("=", 1)[-1]]
    assert ids(versions.read(spark, fresh)) == [1, 3]


def test_one_of_two_writers_wins(spark, fresh):
    versions.write(spark.range(3), fresh)
    base = versions.manifest(spark, fresh)

    def attempt(n):
        try:
            return versions.write(spark.range(n), fresh, base=base)["version"]
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, (10, 20, 30, 40)))
    assert sorted(x is None for x in got) == [False, True, True, True]
    assert versions.read(spark, fresh).count() == [10, 20, 30, 40][got.index(2)]


@pytest.mark.parametrize("step", ["_counted", "_create", "_clear"])
def test_a_writer_lost_at_any_step_leaves_a_table(spark, fresh, monkeypatch, step):
    versions.write(spark.range(5), fresh)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(versions, step, lost)
        versions.write(spark.range(9), fresh)
    assert versions.read(spark, fresh).count() == (9 if step == "_clear" else 5)
    versions.write(versions.read(spark, fresh).union(versions.read(spark, fresh)), fresh)
    assert versions.read(spark, fresh).count() == (18 if step == "_clear" else 10)


def test_old_versions_are_cleared(spark, fresh):
    rows = spark.range(40).select("id", (F.col("id") % 2).alias("part"))
    for n in range(6):
        versions.write(rows.where("part = 0").withColumn("id", F.col("id") + n), fresh, "part",
                       touched=["0"] if n else None)
    assert len([n for n in versions.names(spark, f"{fresh}/_log") if n.isdigit()]) == versions.KEPT
    assert versions.read(spark, fresh).count() == 20
    assert versions.read(spark, fresh, version=5).count() == 20


def test_types_comments_and_view(spark, fresh):
    df = conform(overstock_entries(spark), OVERSTOCK_ENTRIES)
    versions.write(df, fresh, "month", layer="gold")
    told = {r.column_name: (r.data_type, r.comment, r.layer) for r in
            versions.describe(spark, fresh).collect()}
    assert told["turnover_rate"] == ("double", "stock turnover", "gold")
    assert versions.read(spark, fresh).schema["turnover_rate"].metadata["comment"]
    versions.register_view(spark, "entries_v", fresh)
    try:
        assert spark.table("entries_v").count() == 18
    finally:
        spark.sql("DROP VIEW entries_v")


def items_of(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("item_id"), F.lit("n").alias("item_name"),
        (F.col("id") % 3).cast("string").alias("category"), F.lit("c").alias("category_name"),
        F.lit(2.5).alias("unit_price"))


def rounded_rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                   for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_ten_random_batches_equal_a_rebuild(spark, fresh):
    rng, items = random.Random(4), items_of(spark, 30)
    out, touched = f"{fresh}/out", []
    for batch in range(10):
        rows = [(str(rng.randrange(33)), str(rng.randrange(3)), rng.randrange(4000),
                 rng.random() * 100, rng.choice([None, *[f"2025-{m:02}-28" for m in range(1, 7)]]))
                for _ in range(rng.randrange(1, 25))]
        df = spark.createDataFrame(
            rows, "item_id string, location_id string, inventory_qty bigint, "
            "inventory_value double, day string").select(
            "item_id", "location_id", "inventory_qty", "inventory_value",
            F.col("day").cast("date").alias("snapshot_date"))
        df.coalesce(1).write.mode("append").parquet(f"{out}/silver/inventory")
        if batch % 3 == 2:
            touched.append(incremental.update_gold(spark, items, out, max_files=1))
    touched.append(incremental.update_gold(spark, items, out))
    assert incremental.update_gold(spark, items, out) == []
    silver = spark.read.schema(FEEDS["inventory"]).parquet(f"{out}/silver/inventory")
    want = gold.inventory_summary(silver, items)
    for name, df in (("inventory_summary", want), ("turnover_analysis",
                                                   gold.turnover_analysis(want)),
                     ("overstock_alert", gold.overstock_alert(want))):
        assert rounded_rows(incremental.read_gold(spark, out, name)) == rounded_rows(df), name
    changed = items.withColumn("unit_price", F.lit(3.0))
    assert len(incremental.update_gold(spark, changed, out)) == 7  # six months and none
    got = incremental.read_gold(spark, out, "inventory_summary")
    assert got.select("unit_price").distinct().collect()[0].unit_price == 3.0


def test_only_touched_months_are_read_and_written(spark, fresh):
    items, out = items_of(spark, 40), f"{fresh}/out"

    def deliver(month, n):
        spark.range(n).select(
            F.col("id").cast("string").alias("item_id"), F.lit("w").alias("location_id"),
            F.col("id").alias("inventory_qty"), F.lit(1.0).alias("inventory_value"),
            F.lit(month).cast("date").alias("snapshot_date")).coalesce(1).write.mode(
            "append").parquet(f"{out}/silver/inventory")
        return incremental.update_gold(spark, items, out)

    for month in range(1, 7):
        assert deliver(f"2025-{month:02}-28", 40) == [f"2025-{month:02}-01"]
    before = versions.manifest(spark, f"{out}/gold/inventory_summary")["parts"]
    assert deliver("2025-03-15", 5) == ["2025-03-01"]
    after = versions.manifest(spark, f"{out}/gold/inventory_summary")["parts"]
    assert [m for m in after if after[m] != before[m]] == ["2025-03-01"]
    row = incremental.read_gold(spark, out, "inventory_summary").where(
        "item_id = '4' AND month = '2025-03-01'").first()
    assert row.avg_inventory_qty == 4.0 and row.max_inventory_qty == 4


def test_a_batch_that_runs_again_counts_once(spark, fresh):
    rows = spark.createDataFrame([("1", "w", 10, 5.0)], "item_id string, location_id string, "
                                 "inventory_qty bigint, inventory_value double").withColumn(
        "snapshot_date", F.lit("2025-01-31").cast("date"))
    for number in (0, 1, 1, 0):
        incremental.add_batch(rows, number, fresh)
    assert [(r.qty_sum, r.qty_count) for r in versions.read(spark, fresh).collect()] == [(20, 2)]


def test_sums_of_a_batch_are_not_kept(spark, fresh, monkeypatch):
    """Sums go to the table as they are made; months, also a missing one, come from the rows."""
    kept, write = [], versions.write
    jvm = spark._jsc.sc()

    def watched(*args, **options):
        kept.append(jvm.getPersistentRDDs().size() - before)
        return write(*args, **options)

    monkeypatch.setattr(versions, "write", watched)
    for number in (0, 1):
        rows = spark.createDataFrame(
            [("a", "w", 4 + number, 1.0, None), ("a", "w", 2, 1.0, date(2025, 1 + number, 28))],
            FEEDS["inventory"])
        before = jvm.getPersistentRDDs().size()
        incremental.add_batch(rows, number, fresh)
    assert kept == [0, 0]
    got = {str(r.month): (r.qty_count, r.qty_sum) for r in versions.read(spark, fresh).collect()}
    assert got == {"None": (2, 9), "2025-01-01": (1, 2), "2025-02-01": (1, 2)}


def test_bitmaps_do_not_move_before_they_are_whole(spark):
    items = items_of(spark, 100)
    summary = items.select(
        "item_id", "category", F.date_add(F.lit("2025-01-01").cast("date"), F.length("item_id")
                                          ).alias("month"), F.lit(1.0).alias("turnover_rate"),
        F.hash("item_id").alias("days_on_hand"), F.lit(2.0).alias("avg_inventory_value"))
    bitmaps = distinct.item_bitmaps(summary.repartition(16, "item_id"), distinct.numbered(items))
    plan = bitmaps._jdf.queryExecution().executedPlan().toString()
    whole, part = (plan.index(f"[{p}bitmap_construct_agg") for p in ("", "partial_"))
    assert "Exchange" not in plan[whole:part], plan


def test_bitmaps_equal_count_distinct(spark):
    items = items_of(spark, 70_000)  # three bitmaps
    summary = items.crossJoin(spark.range(3)).where("hash(item_id, id) % 3 <> 0").select(
        "item_id", "category", F.add_months(F.lit("2025-01-01").cast("date"), F.col("id").cast(
            "int")).alias("month"), F.lit(1.0).alias("avg_inventory_value"),
        F.lit(2.0).alias("turnover_rate"), (F.hash("item_id") % 120).alias("days_on_hand"))
    numbers = distinct.numbered(items)
    assert numbers.agg(F.min("item_number"), F.max("item_number"),
                       F.count_distinct("item_number")).first()[:] == (0, 69_999, 70_000)
    bitmaps = distinct.item_bitmaps(summary, numbers).cache()
    for by in ([], ["month"], ["category"], ["month", "category"]):
        want = summary.groupBy(*by).agg(F.count_distinct("item_id").alias("item_count"))
        got = distinct.distinct_items(bitmaps, *by).select(*by, "item_count")
        assert rounded_rows(got) == rounded_rows(want)
    held = distinct.distinct_items(bitmaps.where("long_held")).first().item_count
    assert held == marts.overstock_kpi(summary).first().overstock_count


def test_pipeline_is_incremental(spark, fresh):
    """New stock of one month changes that month's gold alone."""
    rows = spark.range(60).select(
        (F.col("id") % 20).cast("string").alias("item_id"), F.lit("w").alias("location_id"),
        F.col("id").alias("inventory_qty"), F.lit(1.0).alias("inventory_value"),
        F.add_months(F.lit("2025-01-31").cast("date"), (F.col("id") % 3).cast("int")).alias(
            "snapshot_date"))
    out = f"{fresh}/out"
    landing.land(rows, fresh, "inventory")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out)
    items = items_of(spark, 20)
    assert len(incremental.update_gold(spark, items, out)) == 3
    landing.land(rows.where("id < 3").withColumn("location_id", F.lit("v")).where(
        "month(snapshot_date) = 2"), fresh, "inventory")
    medallion.ingest_bronze(spark, "inventory", fresh, out)
    medallion.refresh_silver(spark, "inventory", out)
    assert incremental.update_gold(spark, items, out) == ["2025-02-01"]
    bronze = medallion.read_layer(spark, out, "bronze", "inventory")
    want = gold.inventory_summary(silver_inventory(bronze), items)
    assert rounded_rows(incremental.read_gold(spark, out, "inventory_summary")) == rounded_rows(want)
    assert tables.rule_counts(spark, f"{out}/rule_counts").where(
        "measure = 'total_rows'").agg(F.sum("row_count")).first()[0] == bronze.count()
