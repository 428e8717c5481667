"""Action tables kept up to date from stored tables."""

from pyspark.sql import functions as F

from stockmill.__main__ import main
from stockmill.operators import gold, versions
from stockmill.plans import colocated, generate, incremental, medallion, stored_actions
from stockmill.schemas import STOCK_POSITION, conform
from stockmill.sources import literals

DAY = "2025-03-01"


def positions_of(items, more=0):
    """Two locations per item: one short, one with surplus of some."""
    held = items.select("item_id", "item_name", "category", "category_name", F.explode(F.array(
        F.lit("east"), F.lit("west"))).alias("location"))
    short = F.col("location") == "east"
    return conform(held.withColumns({
        "current_stock": F.when(short, 2 + more).otherwise(30), "lead_time_days": F.lit(9),
        "required_qty": F.when(short, 50).otherwise(10), "status": F.lit("x")}), STOCK_POSITION)


def test_stored_actions_follow_their_sources(spark, fresh):
    out, lands = f"{fresh}/out", f"{fresh}/landing"
    generate.generate_landing(spark, lands, 40, 200)
    tables = medallion.run_pipeline(spark, out, lands)
    items = medallion.read_layer(spark, out, "bronze", "item_master")
    stored_actions.store_positions(spark, out, positions_of(items))
    got = stored_actions.update_actions(spark, out, DAY)
    first = {name: df.count() for name, df in got.items()}
    n = items.count()
    assert first["transfer_requests"] == n and first["emergency_orders"] == n
    assert first["order_proposals"] > 0
    assert first["all_overstock"] == tables["overstock_alert"].count()
    moved = got["transfer_requests"].agg(F.sum("transfer_qty")).first()[0]
    ordered = got["emergency_orders"].agg(F.sum("order_qty")).first()[0]
    assert (moved, ordered) == (20 * n, 28 * n)
    # nothing has changed: nothing is written
    before = {name: versions.manifest(spark, f"{out}/gold/{name}")["version"]
              for name in ("transfer_requests", "emergency_orders", "all_overstock")}
    assert {name: df.count() for name, df in stored_actions.update_actions(
        spark, out, DAY).items()} == first
    assert before == {name: versions.manifest(spark, f"{out}/gold/{name}")["version"]
                      for name in before}
    # new positions change requests, hand-entered rows their own month alone
    stored_actions.store_positions(spark, out, positions_of(items, 8))
    assert stored_actions.make_requests(spark, out, DAY)
    assert stored_actions.action_tables(spark, out)["emergency_orders"].agg(
        F.sum("order_qty")).first()[0] == 20 * n
    entries = literals.overstock_entries(spark)
    stored_actions.store_entries(spark, out, entries)
    months = {str(r.month) for r in entries.select("month").distinct().collect()}
    assert set(stored_actions.update_overstock(spark, out)) == months
    assert stored_actions.update_overstock(spark, out) == []
    listed = stored_actions.action_tables(spark, out)["all_overstock"]
    want = gold.all_overstock(tables["overstock_alert"], entries)
    assert listed.exceptAll(want.select(listed.columns)).count() == 0
    assert listed.count() == want.count()
    # entries that are taken back go from the list
    stored_actions.store_entries(spark, out, entries.limit(0))
    assert set(stored_actions.update_overstock(spark, out)) == months
    assert stored_actions.action_tables(spark, out)["all_overstock"].count() == first[
        "all_overstock"]

    # the same tables in buckets, and from the command line
    database = f"s_{fresh.rsplit('-', 1)[-1]}"
    try:
        for name in colocated.store_layers(spark, out, database, 2):
            assert spark.table(name).count() > 0
        assert colocated.inventory_summary(spark, database).count() == tables[
            "inventory_summary"].count()
        colocated.store_layers(spark, out, database, 2)
        assert len(spark.catalog.listTables(database)) == 8
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    positions_of(items).write.option("header", True).csv(f"{fresh}/positions")
    main(["act", "--out", out, "--positions", f"{fresh}/positions", "--date", DAY], spark)
    assert incremental.read_gold(spark, out, "emergency_orders").agg(
        F.sum("order_qty")).first()[0] == ordered
