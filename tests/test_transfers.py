"""Transfer plans against a step-by-step allocation."""

import random

import pytest
from pyspark.sql import functions as F

from stockmill.operators import actions
from stockmill.operators.transfers import transfer_plan, uncovered_shortages
from stockmill.sources.literals import shortage_entries

SCHEMA = ("item_id int, item_name string, location int, current_stock long, required_qty long, "
          "lead_time_days long")


def allocate(rows):
    """Move stock one pair at a time: shortages by location, largest surplus first."""
    short = [[loc, need - have] for loc, have, need in sorted(rows) if need > have]
    over = sorted(([loc, have - need] for loc, have, need in rows if have > need),
                  key=lambda x: (-x[1], x[0]))
    moves = []
    while short and over:
        qty = min(short[0][1], over[0][1])
        moves.append((over[0][0], short[0][0], qty))
        for side in (short, over):
            side[0][1] -= qty
            if side[0][1] == 0:
                side.pop(0)
    return moves, [(loc, qty) for loc, qty in short]


def items(seed, count, places):
    rng = random.Random(seed)
    out = {}
    for item in range(count):
        locations = rng.sample(range(places * 2), rng.randint(1, places))
        out[item] = [(loc, rng.randint(0, 6), rng.randint(0, 6)) for loc in locations]
    return out


def frame(spark, data):
    rows = [(i, f"n{i}", loc, have, need, 9) for i, ps in data.items() for loc, have, need in ps]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_matches_stepwise_allocation(spark, seed):
    data = items(seed, 150, 12)
    df = frame(spark, data)
    moves, missing = {}, {}
    for r in transfer_plan(df).collect():
        moves.setdefault(r.item_id, set()).add(
            (r.source_location, r.target_location, r.transfer_qty))
    for r in uncovered_shortages(df).collect():
        missing.setdefault(r.item_id, set()).add((r.location, r.order_qty))
    for item, rows in data.items():
        want_moves, want_missing = allocate(rows)
        assert moves.get(item, set()) == set(want_moves)
        assert missing.get(item, set()) == set(want_missing)


def test_one_item_with_many_locations(spark):
    """Rows stay linear in the locations of an item that holds most positions."""
    n = 4000
    rows = spark.range(n).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).cast("int").alias("item_id"),
        F.lit("n").alias("item_name"), F.col("id").cast("int").alias("location"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 17 + 1).otherwise(0).alias("current_stock"),
        F.when(F.col("id") % 2 == 1, F.col("id") % 13 + 1).otherwise(0).alias("required_qty"),
        F.lit(9).cast("long").alias("lead_time_days"))
    plan = transfer_plan(rows).filter("item_id = 0").cache()
    hot = [(r.location, r.current_stock, r.required_qty)
           for r in rows.filter("item_id = 0").collect()]
    want, _ = allocate(hot)
    got = {(r.source_location, r.target_location, r.transfer_qty) for r in plan.collect()}
    assert got == set(want)
    assert len(want) < len(hot)


def test_demo_positions(spark):
    df = shortage_entries(spark)
    (move,) = transfer_plan(df).collect()
    assert (move.source_location, move.target_location) == ("大阪倉庫", "東京倉庫")
    assert (move.transfer_qty, move.source_left, move.target_left) == (400, 150, 0)
    assert uncovered_shortages(df).count() == 0
    (form,) = actions.transfer_requests(transfer_plan(df), "2026-03-13").collect()
    assert form.summary.startswith("[大阪倉庫] から [東京倉庫] へ 機械部品_特注モーターX を 400個 転用")
    assert str(form.desired_delivery_date) == "2026-03-20"
    choice = {r.item_id: r.choice for r in actions.replenishment_choice(df).collect()}
    assert choice == {"ITM-S0001": "transfer"}


def test_choice_and_order_form(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 0, 10, 3), (2, "b", 1, 0, 10, 30), (3, "c", 1, 0, 10, 3), (3, "c", 2, 4, 0, 3)],
        SCHEMA)
    choice = {r.item_id: r.choice for r in actions.replenishment_choice(df).collect()}
    assert choice == {1: "order", 2: "transfer", 3: "transfer"}
    forms = {r.item_id: r for r in actions.emergency_order_requests(df, "2025-01-01").collect()}
    assert {k: (r.order_qty, r.priority) for k, r in forms.items()} == \
        {1: (10, "通常"), 2: (10, "特急"), 3: (6, "通常")}
    assert "希望納期: 2025/01/08" in forms[1].summary


def test_surplus_candidates_one_row_per_shortage(spark):
    data = items(11, 60, 10)
    got = {(r.item_id, r.short_location): r
           for r in actions.surplus_candidates(frame(spark, data)).collect()}
    want = {}
    for item, rows in data.items():
        over = [(have - need, loc) for loc, have, need in rows if have > need]
        for loc, have, need in rows:
            if need > have and over:
                best = min(over, key=lambda x: (-x[0], x[1]))
                want[(item, loc)] = (need - have, len(over), sum(q for q, _ in over), best)
    assert {k: (r.shortage_qty, r.surplus_locations, r.surplus_qty,
                (r.best_surplus_qty, r.best_location)) for k, r in got.items()} == want


def test_sums_and_carried_values_across_buckets(spark):
    from stockmill.functions.ordered import carry_forward, running_sums

    rows = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("o"),
                                    F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    summed = running_sums(rows, "g", ["o"], {"s": "v"})
    assert {r.o: r.s for r in summed.collect()} == {
        o: sum(range(0, o + 1, 3)) for o in range(1000)}
    filled = carry_forward(rows, "g", ["o"], ["v"])
    assert {r.o: r.v for r in filled.collect()} == {o: o - o % 3 for o in range(1000)}


def test_plan_has_no_pairs(spark):
    df = spark.range(10).select(
        F.col("id").alias("item_id"), F.lit("n").alias("item_name"), F.lit(1).alias("location"),
        F.lit(1).cast("long").alias("current_stock"), F.col("id").alias("required_qty"),
        F.lit(1).cast("long").alias("lead_time_days")).repartition(5)
    plan = transfer_plan(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
